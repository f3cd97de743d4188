"""Runs (maximal periodic stretches) of the words of each text, by the runs theorem.

Every run is the extension of a longest Lyndon word under one of the two orders of the alphabet. The longest Lyndon word at a
place ends before the next smaller value of the inverse suffix array; it is extended to both sides by longest common extensions,
which are range minima over the arrays of longest common prefixes of the words and of the reversed words. A sparse table answers
the minima one level at a time, so memory stays linear in the words.

A run of period q has two copies of each of its windows of ``least * (exponent - 1) / exponent`` words, q apart, and these windows
cover it. Suffixes are therefore sorted only for stretches that repeated windows cover; no run crosses the border of such a stretch.

Each text is taken whole in one task, texts never meet, and nothing is shuffled. Defined results: a null or empty text has no words
and no runs; equal and repeated rows are judged each by itself; other columns of docs are not read; an empty table gives no rows.
Between runs that overlap or nest all are kept; order is by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import WORD_GAP
from reelspark.llm.wordhash import Sequences, doc_of, mix, slices, split

_RUNS = "array<struct<start: int, length: int, period: int>>"


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse suffix array and suffix array, by doubling; what is past the end is smaller than all."""
    n = len(codes)
    rank, step = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return rank, order
        step *= 2


def common_prefixes(codes: np.ndarray, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order; 0 for the first."""
    word, place, by_rank = codes.tolist(), rank.tolist(), order.tolist()
    n, same = len(word), 0
    out = [0] * n
    for i, r in enumerate(place):
        if not r:
            same = 0
            continue
        j = by_rank[r - 1]
        while i + same < n and j + same < n and word[i + same] == word[j + same]:
            same += 1
        out[r] = same
        if same:
            same -= 1
    return np.array(out, np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller value; the length where there is none."""
    values = rank.tolist()
    n = len(values)
    out, waiting = [n] * n, []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def extension(rank: np.ndarray, lcp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes i and j (never equal), by a sparse table of which one level is held at a time."""
    low = np.minimum(rank[i], rank[j]) + 1
    high = np.maximum(rank[i], rank[j]) + 1
    level = np.floor(np.log2(high - low)).astype(np.int64)
    out, table = np.zeros(len(i), np.int64), lcp
    by_level = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
    for k in range(len(edges) - 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = by_level[edges[k] : edges[k + 1]]
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k)])
    return out


def repeated(codes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether a word lies in a window of width words that its text holds twice; equal hashes of different windows only add words."""
    starts = np.arange(len(codes) - width + 1) if len(codes) >= width else np.zeros(0, np.int64)
    row = doc_of(offsets)
    starts = starts[row[starts] == row[starts + width - 1]]
    keys = Sequences(mix(codes.astype(np.uint64) + np.uint64(1))).of(starts, starts + width) ^ mix(row[starts].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    marks = np.bincount(starts[twice], minlength=len(codes) + 1) - np.bincount(starts[twice] + width, minlength=len(codes) + 1)
    return np.cumsum(marks)[: len(codes)] > 0


def runs(codes: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (over all rows), length and period of all runs of at least ``least`` words and ``exponent`` periods."""
    none = np.zeros(0, np.int64)
    cover = repeated(codes, offsets, -(-least * (exponent - 1) // exponent))
    row = doc_of(offsets)
    edge = np.concatenate([[True], (cover[1:] != cover[:-1]) | (row[1:] != row[:-1])]) if len(codes) else np.zeros(0, bool)
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(codes))
    long = cover[begin] & (end - begin >= least)
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    # the stretches one after another, each between separators of its own that are smaller than all words in both orders
    size, m = end - begin, len(begin)
    n = int(size.sum()) + m + 1
    separator = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.ones(n, bool)
    inside[separator] = False
    stretch = np.repeat(np.arange(m), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[stretch]  # place over all rows
    words = codes[at].astype(np.int64)
    text, flipped = np.zeros(n, np.int64), np.zeros(n, np.int64)
    text[separator] = flipped[separator] = np.arange(m + 1)
    text[inside], flipped[inside] = m + 1 + words, m + 1 + words.max() - words
    rank, order = suffix_ranks(text)
    lcp = common_prefixes(text, rank, order)
    back, back_order = suffix_ranks(text[::-1])
    back_lcp = common_prefixes(text[::-1], back, back_order)
    here = np.flatnonzero(inside)
    most = size[stretch] // exponent
    found = []
    for by in (rank, suffix_ranks(flipped)[0]):
        after = next_smaller(by)[here]
        fits = after - here <= most
        i, j, s = here[fits], after[fits], stretch[fits]
        ahead, behind = extension(rank, lcp, i, j), extension(back, back_lcp, n - i, n - j)
        period = j - i
        length = behind + period + ahead
        keep = length >= np.maximum(least, exponent * period)
        found.append(np.stack([(i - behind - separator[s] - 1 + begin[s])[keep], length[keep], period[keep]]))
    start, length, period = np.unique(np.concatenate(found, axis=1)[[0, 2, 1]], axis=1)[[0, 2, 1]]
    return start, length, period


def collapse_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, runs (word number, length, period) and collapsed: the words, joined by a space,
    without those that any run contains after its first period. A run has at least ``least`` words and ``exponent`` periods."""
    if exponent < 2 or least < exponent:
        raise ValueError("a run has at least two periods, and a word for each")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, words = split(batch.column("text"))
                codes = words.indices.to_numpy().astype(np.int64)
                start, length, period = runs(codes, offsets, least, exponent)
                drop = np.bincount(start + period, minlength=len(codes) + 1) - np.bincount(start + length, minlength=len(codes) + 1)
                keep = np.cumsum(drop)[: len(codes)] == 0
                left = np.concatenate([[0], np.cumsum(keep)])[offsets]
                kept = words.filter(pa.array(keep)).dictionary_decode() if len(codes) else pa.array([], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept)
                own = np.searchsorted(start, offsets)
                first = np.repeat(offsets[:-1], np.diff(own))
                structs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (start - first, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(own, pa.int32()), structs), pc.binary_join(lists, " ")],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first; null without runs."""
    ahead = lambda x, y: y["length"].cast("long") * x["period"] > x["length"].cast("long") * y["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(ahead(best, x), x).otherwise(best))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Where crc32 h of doc_id is divisible by ten, the words from a on repeat with period p, for
    g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); all other texts (null doc_id, no words) stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD_GAP), lambda w: w != "")))
    sized = chosen.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    sized = sized.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rest = F.col("n") - F.col("a")
    sized = sized.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    repeats = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeats), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of the runs and of the collapsed words of every text of docs (doc_id, text)."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")),
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
