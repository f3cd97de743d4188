"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character bigrams and trigrams of its lower-cased letters (anything else parts words), weighted
(1 + log count) * idf and scaled to length one. idf counts every document that may be learned from. The labelled rows of
each language are clustered into ``clusters`` centroids by spherical k-means. A text gets the language of the centroid with the highest
cosine; that cosine is its score.

The centroids are fitted on a bounded sample: of each language at most ``per_language`` different rows of at most LONGEST characters, drawn by a hash, and at
most MOST_ROWS of all. With more than MOST_LANGUAGES languages fitting raises an error.

Distance-based rejection: texts of about the same number of n-grams are compared. A text whose cosine is below ``slack`` times
a low quantile (LOW) of the cosines that the labelled texts of its length class reach to their own language is rejected (accepted = false). A longer text is
never held to less than a shorter one; a class with fewer than FEW labelled texts is held to what the next shorter one is.

Defined results: null texts and texts without a letter are ``und`` with score 0, not accepted; so is every text where no row can
be learned from. Equal cosines go to the language that sorts first. Repeated rows are scored each by itself; null and repeated doc_id
do no harm. Extra columns are ignored by ``identify`` and kept by ``predict``, but for those named like a result, which the result replaces. The driver holds the
bounded sample, ``buckets`` counts and one row a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import wordhash

BUCKETS, CLUSTERS, PER_LANGUAGE, ROUNDS, SLACK = 4096, 3, 1200, 8, 0.6
MOST_ROWS, MOST_LANGUAGES, LONGEST = 20_000, 1_000, 32_768
LOW, FEW = 0.01, 30
#: Rows of dense counts at a time.
ROWS = 512
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def counts(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (rows x buckets) and the number of letters of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py() or ""
    # a line feed before each text and behind the last: nothing of a text depends on its neighbours
    code = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.append(np.repeat(np.arange(len(texts)), lengths + 1), len(texts) - 1)
    first = np.zeros(len(code), bool)
    first[np.cumsum(lengths + 1) - lengths - 1] = True  # each text's own line feed
    letter = _is_letter()[code]
    letters = np.bincount(owner[letter], minlength=len(texts))
    c = np.where(letter, code, np.uint32(0))
    pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    some = (letter[:-1] | letter[1:]) & ~first[:-1]
    out = np.bincount(owner[:-1][some] * buckets + ((pair * np.uint32(0xC2B2AE3D)) >> shift)[some], minlength=len(texts) * buckets)
    middle = letter[1:-1]
    triple = pair[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    out += np.bincount(owner[1:-1][middle] * buckets + ((triple * np.uint32(0x9E3779B1)) >> shift)[middle], minlength=len(texts) * buckets)
    return out.reshape(len(texts), buckets), letters


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # clusters of all languages, row by row
    language_of: np.ndarray
    floor: np.ndarray  # least accepted cosine for each length class

    def vectors(self, found: np.ndarray) -> np.ndarray:
        x = found.astype(np.float32)
        np.log1p(x - 1, out=x, where=x > 0)
        x = np.where(found > 0, 1 + x, 0).astype(np.float32) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)


def _length_class(found: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(found.sum(axis=1) + 1).astype(int), 31)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    mean = x.mean(axis=0)
    picked = [int(np.argmax(x @ mean))]
    best = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):  # far from those picked, but not the farthest: that is an outlier
        picked.append(int(np.argsort(best, kind="stable")[len(x) // 20]))
        best = np.maximum(best, x @ x[picked[-1]])
    centre = x[picked]
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def fit(learn: DataFrame, buckets: int = BUCKETS, clusters: int = CLUSTERS, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, slack: float = SLACK) -> Model | None:
    """learn: doc_id, text, lang. Null languages and texts without a letter teach nothing; None if nothing is left."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for part in wordhash.slices(batch, "text", rows=ROWS):
                found, letters = counts(part.column("text"), buckets)
                total[:buckets] += (found > 0).sum(axis=0)
                total[buckets] += (letters > 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1, dtype=np.int32)), pa.array(total)], ["bucket", "n"])

    learn = learn.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    df = np.zeros(buckets + 1)
    for r in learn.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    sizes = learn.groupBy("lang").count()  # one row a language
    names = sizes.limit(MOST_LANGUAGES + 1).count()
    if names > MOST_LANGUAGES:
        raise ValueError("there are more than MOST_LANGUAGES languages")
    most = max(1, min(per_language, MOST_ROWS // max(names, 1)))
    # doc_id only spreads the draw, so that a large group of copies is drawn in its share
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = learn.filter(F.length("text") <= LONGEST).withColumn("place", place).join(F.broadcast(sizes), "lang").filter(F.col("place") * F.col("count") < most)
    order = Window.partitionBy("lang").orderBy("place")
    chosen = drawn.dropDuplicates(["lang", "place"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("lang", "text")
    sample = chosen.toArrow().combine_chunks()
    model = Model(np.log((1 + df[buckets]) / (1 + df[:buckets])).astype(np.float32) + np.float32(1), [], np.zeros((0, buckets), np.float32), np.zeros(0, int), np.zeros(32))
    lang, texts = np.array(sample.column("lang").to_pylist(), dtype=object), sample.column("text")
    texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    reached: list[tuple[np.ndarray, np.ndarray]] = []
    for name in sorted(set(lang)):
        rows = np.flatnonzero(lang == name)
        kept = []
        for part in wordhash.slices(pa.RecordBatch.from_arrays([texts.take(pa.array(rows))], ["text"]), "text", rows=ROWS):
            found, letters = counts(part.column("text"), buckets)
            found = found[letters > 0]
            kept.append((model.vectors(found), _length_class(found)))
        x = np.concatenate([k[0] for k in kept])
        if not len(x):
            continue
        own = _kmeans(x, clusters, rounds)
        reached.append((np.concatenate([k[1] for k in kept]), (x @ own.T).max(axis=1)))
        model.centroids = np.concatenate([model.centroids, own.astype(np.float32)])
        model.language_of = np.concatenate([model.language_of, np.full(len(own), len(model.languages))])
        model.languages.append(name)
    if reached:
        length, cosine = (np.concatenate(x) for x in zip(*reached, strict=True))
        low = np.array([np.quantile(cosine[length == k], LOW) if (length == k).sum() >= FEW else 0.0 for k in range(32)])
        model.floor = slack * np.maximum.accumulate(low)
    return model if model.languages else None


def predict(docs: DataFrame, model: Model | None, buckets: int = BUCKETS) -> DataFrame:
    """docs: text and any other columns, which stay. Adds lang_pred, score, accepted in place of any columns of these names."""
    docs = docs.drop("lang_pred", "score", "accepted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text", rows=ROWS):
                found, letters = counts(part.column("text"), buckets)
                seen = letters > 0
                if model is None:
                    pick, score, ok = np.zeros(len(seen), int), np.zeros(len(seen)), np.zeros(len(seen), bool)
                    lang = ["und"] * len(seen)
                else:
                    cosine = model.vectors(found) @ model.centroids.T
                    pick = cosine.argmax(axis=1)
                    score = np.where(seen, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
                    ok = seen & (score >= model.floor[_length_class(found)])
                    lang = [model.languages[model.language_of[p]] if s else "und" for p, s in zip(pick, seen, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], [*names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs: doc_id, text, lang. Learn from rows that held_out leaves, predict all: doc_id, held_out, lang_pred, score, accepted."""
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(rows.filter("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
