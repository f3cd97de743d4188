"""Alignment of two tokenizers' tokens over the same bytes.

Tasks cut each text where both tokenizers surely begin a token (a space between two characters that are not white space: no token of
either holds such a place in its middle), and tokenise each distinct piece of a block of texts once. All pieces of a block stand in one row of bytes, as they
begin and end with tokens of both: ends that both tokenizers have there cut it into groups, and every end of either is one link, of the tokens that hold the byte before it.
A text's groups are those of its pieces in order. Links are counted over the corpus by pair of ids, from each block's distinct pairs and the times they
stand in it; the counts go back to the blocks, each of which sums them up for its pieces and from there for its texts.

The byte-level tokenizer sees a space and the text, the piece tokenizer the text, to which it adds the space itself. Strings of special tokens are plain text.
Defined results: a text that is null or empty, or from which either tokenizer's bytes do not give back space and text (one that holds U+2581), has no tokens,
and counts nowhere; equal and repeated rows count each by itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, materialise
from reelspark.llm.wordhash import slices

#: Bytes of text in a block; a text is never cut, a longer one is a block of its own.
BLOCK = 2_000_000
#: Pairs of ids whose counts are broadcast; more are joined by shuffle.
MOST_PAIRS = 2_000_000

_SURE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable Latin-1 as itself, all others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def load_byte_level(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray, list[bytes]]:
    """A byte-level BPE file as ranks, without its special tokens; its merges must stand in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {x["content"] for x in said["added_tokens"]}
    vocabulary, byte = said["model"]["vocab"], byte_alphabet()
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("merges do not stand in the order of their ids")
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    encoding = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, np.array([len(t) for t in tokens], np.int32), tokens


def load_pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray, list[bytes]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.vocab_size()):
        t = model.id_to_piece(i)
        tokens.append(bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode())
    if any(b" " in t.lstrip(b" ") for t in tokens):
        raise ValueError("a piece spans words")
    return model, np.array([len(t) for t in tokens], np.int32), tokens


class Pair:
    """Both tokenizers of a worker."""

    _loaded: dict[tuple[str, str, str], Pair] = {}

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        self.a, self.a_size, self.a_bytes = load_byte_level(byte_level, pattern)
        self.b, self.b_size, self.b_bytes = load_pieces(pieces)
        most = max(len(self.a_size), len(self.b_size))
        self.written = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], pa.large_string())

    @classmethod
    def of(cls, *paths: str) -> Pair:
        if paths not in cls._loaded:
            cls._loaded[paths] = cls(*paths)
        return cls._loaded[paths]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, given without their first space: sizes in bytes, ids of all by either tokenizer, and which pieces come back as other bytes (they get no ids)."""
        held = [" " + w for w in words]
        a, b = [self.a.encode_ordinary(w) for w in held], self.b.encode(words, num_threads=1)
        whole = [w.encode() for w in held]
        back = lambda parts, tokens: b"".join([tokens[i] for p in parts for i in p])
        bad = np.zeros(len(words), bool)
        if not back(a, self.a_bytes) == b"".join(whole) == back(b, self.b_bytes):
            bad = np.array([not back([x], self.a_bytes) == w == back([y], self.b_bytes) for x, w, y in zip(a, whole, b, strict=True)], bool)
            a, b = ([[] if no else p for p, no in zip(side, bad, strict=True)] for side in (a, b))
        size = np.array([len(w) for w in whole], np.int64)
        size[bad] = 0
        return size, *(np.fromiter(chain.from_iterable(p), np.int32) for p in (a, b)), bad


def align_pieces(pair: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Ids of either side, tokens a piece and bytes a piece, of pieces one after the other: the pairs of ids that are linked, links a piece, groups a piece, and a piece's groups in writing, each with ``;`` behind it."""
    ends, a_end, b_end = np.cumsum(size), np.cumsum(pair.a_size[a], dtype=np.int64), np.cumsum(pair.b_size[b], dtype=np.int64)
    every, common = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
    pairs = a[np.searchsorted(a_end, every)].astype(np.int64) << 32 | b[np.searchsorted(b_end, every)]
    upto = lambda some: np.diff(np.searchsorted(some, ends, side="right"), prepend=0)
    # in writing a group is its tokens of a, then those of b; the last of either has a mark of its own behind it
    a_last, b_last = np.searchsorted(a_end, common), np.searchsorted(b_end, common)
    a_many, b_many = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    codes, marks = np.empty(len(a) + len(b), np.int64), len(pair.written) // 3
    codes[np.arange(len(a)) + np.repeat(b_last - b_many + 1, a_many)] = a
    codes[np.arange(len(b)) + np.repeat(a_last + 1, b_many)] = b
    codes[a_last + b_last - b_many + 1] += marks
    codes[a_last + b_last + 1] += 2 * marks
    text = pair.written.take(pa.array(codes))
    bounds = _bounds(text)[np.append(0, np.cumsum(n_a + n_b))]
    return pairs, upto(every), upto(common), pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), text.buffers()[2])


def _bounds(texts: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def _sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of values by runs of so many."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(many))])


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Pieces of texts: the texts' order in what follows, offsets of their pieces, the pieces' places among the distinct ones, and those."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    # between words that neither begin nor end with white space every space is sure
    plain = np.array([bool(w) and not (w[0].isspace() or w[-1].isspace()) for w in words.dictionary.to_pylist()], bool)
    odd = np.add.reduceat(np.append(~plain[words.indices.to_numpy()], False), offsets[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    rest = [_SURE.split(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    keep = np.repeat(~odd, np.diff(offsets))
    every = pa.chunked_array([words.filter(pa.array(keep)).dictionary_decode(), pa.array([w for x in rest for w in x], pa.string())]).combine_chunks().dictionary_encode()
    sizes = np.concatenate([np.diff(offsets)[~odd], np.array([len(x) for x in rest], np.int64)])
    return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), np.concatenate([[0], np.cumsum(sizes)]), every.indices.to_numpy().astype(np.int64), every.dictionary.to_pylist()


def tokenise(docs: DataFrame, byte_level: str, pieces: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """A row a block of texts: docs (doc_id, numbers of tokens and groups, those in writing as digest, number of pieces), places (of their pieces among the block's distinct ones), n_links (a distinct piece), links (places of those among the block's pairs), pairs (ids, times)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(byte_level, pieces, pattern)
        for whole in batches:
            for batch in slices(whole, "text", block):
                order, at, places, words = cut(batch.column("text"))
                size, a, b, bad = pair.tokens(words)
                ends = np.append(0, np.cumsum(size))
                n_a, n_b = (np.diff(np.searchsorted(np.cumsum(n[x]), ends, side="right")) for x, n in ((a, pair.a_size), (b, pair.b_size)))
                keep = np.repeat(_sums(bad[places].astype(np.int64), np.diff(at)) == 0, np.diff(at))
                many = np.diff(np.append(0, np.cumsum(keep))[at])
                places = places[keep]
                times = np.bincount(places, minlength=len(words))
                used = times > 0  # every piece that is left stands in a text that counts
                a, b = a[np.repeat(used, n_a)], b[np.repeat(used, n_b)]
                size, times, n_a, n_b, places = size[used], times[used], n_a[used], n_b[used], (np.cumsum(used) - 1)[places]
                linked, n_links, n_groups, written = align_pieces(pair, a, n_a, b, n_b, size)
                pairs, links = np.unique(linked, return_inverse=True)
                counts = np.zeros(len(pairs), np.int64)
                np.add.at(counts, links, np.repeat(times, n_links))
                texts = written.take(pa.array(places))
                edge, held = _bounds(texts)[np.append(0, np.cumsum(many))].tolist(), memoryview(texts.buffers()[2] or b"")
                digests = [hashlib.sha256(held[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge, edge[1:], strict=False)]
                of_text = lambda x: pa.array(_sums(x[places], many))  # noqa: E731, B023
                held_docs = [batch.column("doc_id").take(pa.array(order)), of_text(n_a), of_text(n_b), of_text(n_groups), pa.array(digests, pa.string()), pa.array(many.astype(np.int32))]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                ints = lambda x: one(pa.array(x.astype(np.int32)))
                row = [one(pa.StructArray.from_arrays(held_docs, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_places"])), ints(places), ints(n_links), ints(links), one(pa.StructArray.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "times"]))]
                yield pa.RecordBatch.from_arrays(row, ["docs", "places", "n_links", "links", "pairs"])

    doc = f"struct<doc_id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, groups_sha256: string, n_places: int>"
    return docs.select("doc_id", "text").mapInArrow(run, f"docs array<{doc}>, places array<int>, n_links array<int>, links array<int>, pairs array<struct<pair: bigint, times: bigint>>")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def groups(side: dict[str, Column], write) -> Column:
    """For tables of tokens (of a and b: ids, ends in bytes, and the number of the token that holds each byte): what write makes of the ids of a and b between neighbouring ends that both have, in order."""

    def by(common: Column) -> Column:
        # a group's first byte is the end of the group before; past the last byte stands the number of all tokens
        start = F.concat(F.array(F.lit(0)), common)
        first = lambda s: F.transform(start, lambda x: F.coalesce(F.get(side[f"{s}_at"], x), F.size(side[s])))
        ids = lambda s, at, j: F.slice(side[s], F.get(at[s], j) + 1, F.get(at[s], j + 1) - F.get(at[s], j))
        number = F.sequence(F.lit(0), F.size(common) - 1)
        many = let(F.struct(first("a").alias("a"), first("b").alias("b")), lambda at: F.transform(number, lambda j: write(ids("a", at, j), ids("b", at, j))))
        return F.when(F.size(common) > 1, many).otherwise(F.array(write(side["a"], side["b"])))

    return F.when(F.size(side["a_end"]) > 0, let(F.array_intersect(side["a_end"], side["b_end"]), by)).otherwise(F.array())


def links(side: dict[str, Column]) -> Column:
    """Array of numbers (id of a, id of b) for all tokens of either side whose bytes overlap: one for each end of a token, an end of both counted once."""
    at = lambda s, e: F.get(side[s], F.get(side[f"{s}_at"], e - 1))
    return F.transform(F.array_union(side["a_end"], side["b_end"]), lambda e: F.shiftleft(at("a", e).cast("long"), 32).bitwiseOR(at("b", e)))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, times and whether no pair with the same b stands more often."""
    each = blocks.select(F.explode("pairs").alias("p")).select("p.pair", "p.times")
    counted = materialise(each.groupBy("pair").agg(F.sum("times").alias("times")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counted.groupBy(b.alias("b")).agg(F.max("times").alias("most"))
    joined = counted.withColumn("b", b).join(most, "b").select("pair", "times", (F.col("times") == F.col("most")).alias("best"))
    out = materialise(joined, "pairs")
    discard(counted)
    return out


def _valued(block: pa.Table, values: pa.Table) -> pa.Table:
    """The rows of a block's texts, from the block and the values (times, best) of its pairs by place."""
    flat = lambda c: block.column(c).combine_chunks().flatten()
    docs, places, n_links, links = flat("docs"), *(flat(c).to_numpy() for c in ("places", "n_links", "links"))
    many = docs.field("n_places").to_numpy()
    by_pair = np.zeros((2, values.num_rows), np.int64)
    if values.num_rows:
        by_pair[:, values.column("place").to_numpy()] = [values.column(c).to_numpy() for c in ("times", "best")]
    count_sum, n_best = (pa.array(_sums(_sums(v[links], n_links)[places], many)) for v in by_pair)
    n_a, n_b, n_groups = (docs.field(c) for c in ("n_a", "n_b", "n_groups"))
    columns = {"doc_id": docs.field("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": pc.subtract(pc.add(n_a, n_b), n_groups), "n_best": n_best, "count_sum": count_sum, "groups_sha256": docs.field("groups_sha256")}
    return pa.table(columns)


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str, block: int = BLOCK, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokenised = tokenise(docs, byte_level, pieces, pattern, block).select(F.monotonically_increasing_id().alias("block"), "*")
    # rows are large: groups of few rows
    blocks = materialise(tokenised, "aligned", {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1})
    counts = pair_counts(blocks)
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    each = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "p")).select("of_block", "place", "p.pair")
    values = each.join(counts, "pair").select("of_block", "place", "times", F.col("best").cast("long").alias("best"))
    # a group of either side is one block
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return blocks.drop("pairs").groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(_valued, schema)
