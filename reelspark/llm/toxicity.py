"""Toxic spans by a linear-chain conditional random field.

Every word is tagged T (toxic) or O. A tag's weight is the sum of the weights of the word's features (the word without case and
outer punctuation, and its beginnings of 3 to 7 letters) and of the transition from the tag before. Forward-backward gives each word's
marginal of T. A document's score is a logistic function of its greatest marginal, the expected number of toxic words and their density;
offending spans are runs of words with a marginal of ``span_at`` or more, as character offsets.

Labelled tokens come from labelled documents: features found mostly in toxic documents mark words of toxic documents T; all words of
the others are O. The model is fitted on at most about ``per_label`` labelled documents of each label (weighted back to their true
share) of at most LONGEST characters and MOST_BYTES in all, drawn by a hash; one task holds these alone, in about 500 MB, and sends the weights to the
driver. Every text is then scored whole.

Defined results: null and empty texts have no words and get the score of a document without toxic words. Labels other than 0 and 1 (null included) teach
nothing; of several labels of one doc_id the greatest counts, and of several texts of one doc_id the first by hash teaches. Without any toxic or any
harmless label all scores are 0. Repeated rows are scored each by itself; null doc_id has no label. Extra columns are ignored by ``score_documents`` and
kept by ``tag``, but for those named like a result, which the result replaces. One text's words are held whole by a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import wordhash

PER_LABEL, SPAN_AT, PREDICT_AT = 1500, 0.5, 0.3
LONGEST = 200_000
#: Of the fit's texts, half for each label; the fit takes about 20 bytes of memory for each byte of text.
MOST_BYTES = 24_000_000
SLOTS = 1 << 17
TOGETHER = 6_000_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BEGINNINGS = (3, 4, 5, 6, 7)
_SAMPLE = pa.schema([("text", pa.string()), ("toxic", pa.int32())])


def features(words: list[str]) -> np.ndarray:
    """Feature slots of distinct words, one row each; slot 0 stands for none."""
    out = np.zeros((len(words), 1 + len(_BEGINNINGS)), np.int32)
    for i, w in enumerate(words):
        w = _EDGE.sub("", w.lower())
        if w:
            out[i, 0] = 1 + xxhash.xxh3_64_intdigest("=" + w) % (SLOTS - 1)
            for j, n in enumerate(_BEGINNINGS, 1):
                if len(w) >= n:
                    out[i, j] = 1 + xxhash.xxh3_64_intdigest(w[:n]) % (SLOTS - 1)
    return out


class Chains:
    """Chains of different lengths laid out step by step, so that one step of all is one slice."""

    def __init__(self, offsets: np.ndarray):
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        steps = int(lengths.max()) if len(lengths) else 0
        self.active = np.searchsorted(-lengths[order], -np.arange(steps), "left")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = (self.starts[np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], lengths)] + rank[doc]).astype(np.int32)

    def marginals(self, odds: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """odds: exp(weight of T less that of O) of each word; stay: exp of the transition weights, [from][to].

        Returns T's marginal, and forward and backward odds (all in the words' order).
        """
        e = np.empty(len(odds))
        e[self.place] = odds
        ahead, behind = np.empty_like(e), np.ones_like(e)
        (oo, ot), (to, tt) = stay
        s, a = self.starts, self.active
        for t in range(len(a)):
            now = e[s[t] : s[t + 1]]
            if t:
                r = ahead[s[t - 1] : s[t - 1] + a[t]]
                now = now * (ot + tt * r) / (oo + to * r)
            ahead[s[t] : s[t + 1]] = np.clip(now, 1e-30, 1e30)
        for t in range(len(a) - 2, -1, -1):
            x = e[s[t + 1] : s[t + 2]] * behind[s[t + 1] : s[t + 2]]
            behind[s[t] : s[t] + a[t + 1]] = (to + tt * x) / (oo + ot * x)
        ahead, behind = ahead[self.place], behind[self.place]
        both = ahead * behind
        return both / (1 + both), ahead, behind


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    stay: np.ndarray
    aggregate: np.ndarray

    def word_odds(self, words: list[str]) -> np.ndarray:
        return np.exp(np.clip(self.weights[features(words)].sum(axis=1) + self.bias, -30, 30))

    def packed(self) -> bytes:
        return np.concatenate([self.weights, [self.bias], self.stay.ravel(), self.aggregate]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        weights, bias, stay, aggregate = np.split(np.frombuffer(data), [SLOTS, SLOTS + 1, SLOTS + 5])
        return cls(weights, float(bias[0]), stay.reshape(2, 2), aggregate)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.aggregate[:-1] + self.aggregate[-1], -30, 30)))


def _evidence(marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: greatest marginal, log of the expected number of toxic words, log of their density."""
    n = np.diff(offsets)
    sums = np.concatenate([[0.0], np.cumsum(marginal)])
    expected = np.maximum(sums[offsets[1:]] - sums[offsets[:-1]], 0)
    top = np.zeros(len(n))
    full = n > 0
    if full.any():
        top[full] = np.maximum.reduceat(marginal, offsets[:-1][full])
    return np.stack([top, np.log1p(expected), np.log1p(100 * expected / np.maximum(n, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.05 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hessian, gradient)
    return beta


def _train(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, rounds: int = 60) -> Model:
    offsets, coded = wordhash.split(texts)
    slots = features(coded.dictionary.to_pylist())
    word = coded.indices.to_numpy()
    doc = wordhash.doc_of(offsets)
    # Which features mark toxic documents? Counted once a document; the columns in turn, to hold little at a time.
    hits, others = np.zeros(SLOTS), np.zeros(SLOTS)
    for a in range(0, len(toxic), 256):  # some documents at a time
        b = min(a + 256, len(toxic))
        own = slice(offsets[a], offsets[b])
        seen_in = np.unique((doc[own] - a) * len(slots) + word[own])
        d, w = seen_in // len(slots), seen_in % len(slots)
        for column in slots.T:
            pairs = np.unique(d * SLOTS + column[w])
            bad = toxic[a + pairs // SLOTS]
            hits += np.bincount(pairs[bad] % SLOTS, minlength=SLOTS)
            others += np.bincount(pairs[~bad] % SLOTS, minlength=SLOTS)
    hits[0] = 0
    lift = np.log((hits + 0.25) / (toxic.sum() + 1)) - np.log((others + 0.25) / ((~toxic).sum() + 1))
    marks = (hits >= min(5, max(2, toxic.sum() / 100))) & (lift > 2.3)
    label = marks[slots].any(axis=1)[word] & toxic[doc]
    # Segments of 64 words are the chains of the fit; all words take part.
    cuts = np.unique(np.concatenate([offsets, np.arange(0, len(word), 64)]))
    chains = Chains(cuts)
    first = np.zeros(len(word), bool)
    first[cuts[:-1][np.diff(cuts) > 0]] = True
    inner = np.flatnonzero(~first).astype(np.int32)
    del doc, first
    weights, stay = np.zeros(SLOTS), np.zeros((2, 2))
    bias = -3.0
    speed, speed_stay, speed_bias = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
    n_words = len(slots)
    for _ in range(rounds):
        odds = np.exp(np.clip(weights[slots].sum(axis=1) + bias, -30, 30))[word]
        p, ahead, behind = chains.marginals(odds, np.exp(stay))
        gap = label - p
        by_word, g_bias = np.bincount(word, weights=gap, minlength=n_words), gap.sum()
        g = sum(np.bincount(column, weights=by_word, minlength=SLOTS) for column in slots.T) - 0.02 * weights
        g[0] = 0
        # expected transitions from the odds on both sides
        r, x = ahead[inner - 1], odds[inner] * behind[inner]
        w = np.exp(stay)
        del p, ahead, behind, gap, odds
        all_ = 1 / (w[0, 0] + w[0, 1] * x + w[1, 0] * r + w[1, 1] * r * x)
        expected = w * np.array([[all_.sum(), (x * all_).sum()], [(r * all_).sum(), (r * x * all_).sum()]])
        g_stay = seen - expected - 0.02 * stay
        speed += g * g
        speed_stay += g_stay * g_stay
        speed_bias += g_bias * g_bias
        weights += 0.5 * g / np.sqrt(speed)
        stay += 0.1 * g_stay / np.sqrt(speed_stay)
        bias += 0.3 * g_bias / np.sqrt(speed_bias)
    model = Model(weights, bias, np.exp(stay), np.zeros(4))
    del chains, inner, label
    p, _, _ = Chains(offsets).marginals(np.exp(np.clip(weights[slots].sum(axis=1) + bias, -30, 30))[word], model.stay)
    model.aggregate = _logistic(_evidence(p, offsets), toxic.astype(float), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows of both that may be learned from."""
    label = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).dropna()
    sizes = {r["toxic"]: r["count"] for r in label.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(float(per_label)) / F.when(F.col("toxic") == 1, sizes[1]).otherwise(sizes[0])
    chosen = label.filter(place < share).limit(4 * per_label)  # about 2 * per_label rows, so small enough to broadcast
    # Lengths are drawn first, so that no more texts than the bound allows are moved; of repeated rows one goes to the shuffle for each task.
    short = docs.filter(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    of_label = Window.partitionBy("toxic").orderBy(place, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = short.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), F.octet_length("text").cast("long").alias("size"))).alias("one"))
    within = one.withColumn("so_far", F.sum("one.size").over(of_label)).filter(F.col("so_far") <= MOST_BYTES // 2).select("doc_id", F.col("one.digest").alias("digest"))
    first = Window.partitionBy("doc_id").orderBy("text")
    drawn = short.withColumn("digest", F.xxhash64("text")).join(F.broadcast(within), ["doc_id", "digest"])
    sample = drawn.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", "text", "toxic")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, _SAMPLE).combine_chunks()
        toxic = rows.column("toxic").to_numpy().astype(bool)
        if toxic.any() and not toxic.all():
            weight = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum())
            model = _train(rows.column("text").chunk(0), toxic, weight * len(toxic) / weight.sum())
            yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])

    # In a fixed order, since sums of floats depend on it.
    fitted = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic").mapInArrow(train, "model binary").head()
    return Model.unpacked(fitted["model"]) if fitted else None


def tag(docs: DataFrame, model: Model | None, span_at: float = SPAN_AT) -> DataFrame:
    """docs: text and any other columns, which stay. Adds score, n_toxic (expected) and spans (start, end, marginal) in place of any columns of these names."""
    docs = docs.drop("score", "n_toxic", "spans")
    names = docs.columns
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text", TOGETHER):
                texts = part.column("text")
                offsets, coded = wordhash.split(texts)
                if model is None:
                    score, expected, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[]] * len(texts)
                else:
                    odds = model.word_odds(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                    p, _, _ = Chains(offsets).marginals(odds, model.stay)
                    evidence = _evidence(p, offsets)
                    score, expected = model.score(evidence), np.expm1(evidence[:, 1])
                    spans = [[] for _ in range(len(texts))]
                    hit = np.flatnonzero(p >= span_at)
                    doc = np.searchsorted(offsets, hit, "right") - 1
                    for i in np.unique(doc).tolist():
                        at = [m.span() for m in _WORD.finditer(texts[i].as_py())]
                        before = None
                        for k in (hit[doc == i] - offsets[i]).tolist():
                            q = float(p[offsets[i] + k])
                            if before == k - 1:
                                last = spans[i][-1]
                                last["end"], last["marginal"] = at[k][1], max(last["marginal"], q)
                            else:
                                spans[i].append({"start": at[k][0], "end": at[k][1], "marginal": q})
                            before = k
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(expected), pa.array(spans, spans_type)], [*names, "score", "n_toxic", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double, n_toxic double, spans array<struct<start: int, end: int, marginal: double>>")


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Returns doc_id, held_out, score, predicted, n_toxic, spans."""
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = fit(rows.filter("not held_out"), labels.select("doc_id", "toxic").filter(~held_out))
    return tag(rows, model).drop("text").withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
