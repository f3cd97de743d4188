"""Language and toxicity: held-out accuracy and odd rows; the pipeline stage by stage."""

import os

import numpy as np
import pytest

import corpus_pipeline
from reelspark.llm import language_id, toxicity
from reelspark.llm.common import held_out, table
from tests.llm.data import documents, texts
from tests.llm.test_pairs import brute_components, brute_dedup

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs, held_out()).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    got = toxicity.score_documents(table(spark, SF, "documents"), labels, held_out()).filter("held_out").join(labels, "doc_id").collect()
    hits = sum(r["predicted"] == r["toxic"] == 1 for r in got)
    wrong = sum(r["predicted"] != r["toxic"] for r in got)
    assert 2 * hits / (2 * hits + wrong) > 0.7 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = texts(20) + [(300, "1234 !!"), (300, "1234 !!")]
    got = language_id.identify(documents(spark, rows), held_out()).collect()  # no language to learn
    assert len(got) == len(rows) and {(r["lang_pred"], r["score"], r["accepted"]) for r in got} == {("und", 0.0, False)}
    docs = documents(spark, rows).drop("lang").selectExpr("*", "if(doc_id % 2 = 0, 'aa', null) AS lang")
    got = language_id.identify(docs, held_out()).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 300)} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] == 202} == {"aa"}
    assert language_id.identify(docs.filter("false"), held_out()).collect() == []


def test_letters_of_all_planes_and_unknown_languages(spark):
    rows = [(k, " ".join(["der hund und die katze", "le chien et les chats", "the dog and the cats"][k % 3] for _ in range(1 + k % 7))) for k in range(300)]
    rows += [(301, chr(0x30000) * 3), (302, "zażółć gęślą jaźń " * 9), (303, "съешь ещё этих мягких булок " * 9)]
    docs = documents(spark, rows).drop("lang").selectExpr("*", "if(doc_id < 300, element_at(array('de', 'fr', 'en'), int(doc_id % 3) + 1), null) AS lang", "'mine' AS score")
    got = {r["doc_id"]: r for r in language_id.identify(docs, held_out()).collect()}
    assert got[301]["lang_pred"] != "und" and not any(got[k]["accepted"] for k in (302, 303))
    assert all(got[k]["accepted"] and got[k]["lang_pred"] == ["de", "fr", "en"][k % 3] for k in range(300))
    again = language_id.predict(docs, language_id.fit(docs)).collect()
    assert all(isinstance(r["score"], float) for r in again)


def brute_cosine(rows, model):
    """Nearest centroid of each text, from n-grams counted one by one."""
    out = []
    for t in rows:
        found = np.zeros((1, language_id.BUCKETS), np.int64)
        low = "".join(c if c.isalpha() else "\0" for c in t.lower())
        code = [0, *(ord(c) * (c != "\0") for c in low), 0]
        for i in range(1, len(code) - 1):
            a, b, c = code[i - 1 : i + 2]
            if b or c:
                found[0, (b * 0x9E3779B1 + c * 0x85EBCA77) % 2**32 * 0xC2B2AE3D % 2**32 >> (33 - language_id.BUCKETS.bit_length())] += 1
            if b:
                found[0, ((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**32 * 0x27D4EB2F + c * 0x165667B1) % 2**32 * 0x9E3779B1 % 2**32 >> (33 - language_id.BUCKETS.bit_length())] += 1
        weights = np.array([(1 + np.log(x)) * w if x else 0 for x, w in zip(found[0], model.idf, strict=True)])
        cosine = model.centroids @ (weights / (np.linalg.norm(weights) or 1))
        out.append((model.languages[model.language_of[int(cosine.argmax())]], float(cosine.max())))
    return out


def test_language_is_the_nearest_centroid_s(spark):
    rows = [(k, f"{'abc xyz' if k % 2 else 'mno pqr'} {'ü' * (k % 3)} {k} tail") for k in range(80)]
    docs = documents(spark, rows).drop("lang").selectExpr("*", "if(doc_id % 2 = 0, 'aa', 'bb') AS lang")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for (i, _), (lang, cosine) in zip(rows, brute_cosine([t for _, t in rows], model), strict=True):
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - min(cosine, 1)) < 1e-5


def test_toxicity_scores_like_plain_chains(spark):
    """A document's score from its words one by one."""
    import xxhash

    rows = [(k, f"some {'VILEWORD, vileword' if k % 3 == 0 else 'quiet'} stands here {k}" if k else "") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 200)] + [(1, 7), (2, None)], "doc_id long, toxic int")
    docs = documents(spark, rows).withColumnRenamed("node", "score")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    slot = lambda x: 1 + xxhash.xxh3_64_intdigest(x) % (toxicity.SLOTS - 1)
    for i, t in rows:
        words = [w.lower().strip(",") for w in t.split()]
        odds = [np.exp(model.bias + sum(model.weights[slot(x)] for x in ["=" + w, *(w[:n] for n in range(3, 8) if len(w) >= n)])) for w in words]
        back, ahead = [np.ones(2)], []
        for k, o in enumerate(odds):
            e = np.array([1.0, o])
            ahead.append(e if not k else e * (ahead[-1] @ model.stay))
            ahead[-1] = ahead[-1] / ahead[-1].sum()
        for o in odds[:0:-1]:
            back.append(model.stay @ (np.array([1.0, o]) * back[-1]))
        p = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back[::-1], strict=True)] if words else []
        evidence = [max(p, default=0), np.log1p(sum(p)), np.log1p(100 * sum(p) / max(len(p), 1)), 1]
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-np.dot(evidence, model.aggregate)))) < 1e-6


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, texts(20))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, empty, held_out()).collect()} == {0.0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(5, None), (None, 1), (6, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels, held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs.filter("false"), labels, held_out()).collect() == []


def test_forward_backward_is_exact():
    """Against the sum over all taggings of short chains."""
    rng = np.random.default_rng(1)
    offsets = np.array([0, 4, 4, 5, 11])
    odds, stay = rng.gamma(1, 2, 11), rng.gamma(1, 2, (2, 2))
    p, _, _ = toxicity.Chains(offsets).marginals(odds, stay)
    for a, b in zip(offsets, offsets[1:], strict=False):
        total, each = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            tags = [(code >> k) & 1 for k in range(b - a)]
            w = np.prod([odds[a + k] for k in range(b - a) if tags[k]]) * np.prod([stay[s, t] for s, t in zip(tags, tags[1:], strict=False)])
            total += w
            each += w * np.array(tags)
        assert np.allclose(p[a:b], each / total)


def test_spans_are_offsets_of_the_text(spark):
    rows = [(k, f"quiet words are here number {k} and more" if k % 2 else f"some {'VILEWORD,' if k % 4 else 'vileword'} stands here {k} today") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(400)], "doc_id long, toxic int")
    for r in toxicity.score_documents(documents(spark, rows), labels, held_out()).collect():
        text = rows[r["doc_id"]][1]
        assert r["predicted"] == int(r["doc_id"] % 2 == 0)
        assert all(0 <= s["start"] < s["end"] <= len(text) for s in r["spans"])
        if r["predicted"]:
            assert any("vileword" in text[s["start"] : s["end"]].lower() for s in r["spans"])


@needs_tables
def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    clean = stages["toxicity"](spark, docs, SF)
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    left = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert len(toxic - left) > 0.75 * len(toxic) and clean.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:300]
    some = docs.filter(docs["doc_id"].isin([i for i, _ in rows]))
    one = stages["near_duplicates"](spark, some, SF)
    assert {r["doc_id"] for r in one.collect()} == {i for (i, _, c) in brute_components(rows, 5, 4, 5) if i == c}
    cut = stages["repeated_passages"](spark, some, SF)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()} == {(i, t, len(t)) for i, _, _, t in brute_dedup(rows, 35)}
    odd = documents(spark, texts(10)).drop("n", "node")
    for name in ("near_duplicates", "repeated_passages"):
        assert stages[name](spark, odd, SF).columns == docs.columns
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.filter("false"), SF).collect() == [], name
