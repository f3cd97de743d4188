"""Packing along a space-filling curve.

Each document's token ids are counted into a hashed vector, scaled to length one and projected to three
dimensions by signs that a mixing function gives each id. A three-dimensional Hilbert curve turns the
point into one key, so documents alike in wording get nearby keys. The documents are range-sorted by key,
their ids are laid end to end along the curve, and the line is cut every 4096 ids: neighbours share
sequences, every id lies in exactly one piece, and only the last sequence of all is not full.

The tokenised table is written once to the shared folder; borders of the key ranges and the number of ids
in each range come from narrow scans of it, and each range, of about equally many ids, is then packed by itself in one task at its known offset.

Defined results: a null text is empty, and an empty text is its end id alone. Ties of the key follow a
hash of doc_id, then doc_id, then the ids; repeated rows are packed each by itself.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import wordhash
from reelspark.llm.common import materialise, shuffle_partitions
from reelspark.llm.wordhash import mix

SEQUENCE, END_ID = 4096, 2
DIMENSIONS, BITS = 3, 10
_TIE_BITS = 24
#: Words in a task's cache (about 40 bytes each), bytes of text taken together, rows that are cut at a time, and tokens that count as one when
#: ranges are weighed.
CACHE_WORDS, TOGETHER, ROWS, WEIGHT = 800_000, 4_000_000, 512, 1024
#: Closing punctuation, and the end of the letters that one character always stands for and whose lower case is one letter.
_CLOSING, _PLAIN_END = string.punctuation, "\u0250"
_PLAIN = "^[A-Za-z\u00aa-\u012f\u0131-\u024f]+$"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers (each below 2**bits), by the Gray-code transform."""
    x = [c.astype(np.int64) for c in cells.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Recent:
    """Ids of at most ``most`` texts, in arrays; when they are too many, the half goes that was not asked for the longest."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.hash, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.texts, self.size, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def find(self, hashed: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each text, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        at = np.minimum(np.searchsorted(self.hash, hashed), len(self.hash) - 1)
        there = self.hash[at] == hashed
        there[there] = pc.equal(self.texts.take(pa.array(at[there])), texts.filter(pa.array(there))).to_numpy(zero_copy_only=False)
        self.turn += 1
        self.used[at[there]] = self.turn
        return at, there

    def _keep(self, order: np.ndarray) -> None:
        begin = np.cumsum(self.size) - self.size
        self.ids = gather(self.ids, begin[order], self.size[order])
        self.hash, self.used, self.size, self.texts = self.hash[order], self.used[order], self.size[order], self.texts.take(pa.array(order))

    def add(self, hashed: np.ndarray, texts: pa.Array, ids: list[bytes]) -> None:
        self.hash = np.concatenate([self.hash, hashed])
        self.used = np.concatenate([self.used, np.full(len(hashed), self.turn, np.int32)])
        self.texts = pa.concat_arrays([self.texts, texts])
        self.size = np.concatenate([self.size, np.array([len(x) // 2 for x in ids], np.int64)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u2")])
        if len(self.hash) > self.most:
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2]))
        self._keep(np.argsort(self.hash, kind="stable"))


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at ``begin`` and are ``size`` long, end to end."""
    edges = np.cumsum(size)
    return values[np.arange(edges[-1] if len(edges) else 0) + np.repeat(begin - edges + size, size)]


class Words:
    """Ids of words, kept from batch to batch in a bounded cache; unseen words are tokenised together.

    White space parts words for the tokenizer as it does here. Of a word of plain letters and closing punctuation the letters and the
    punctuation are looked up apart, lower-cased as the tokenizer does; any other word is looked up as it is, special tokens in it included.
    """

    _loaded: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are stored as unsigned 16-bit integers")
        ids = np.arange(size, dtype=np.uint64)
        self.signs = np.stack([(mix(ids * np.uint64(8) + np.uint64(d + 1)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMENSIONS)], axis=1)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.seen = Recent(CACHE_WORDS)

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What is looked up of each word: its letters and its closing punctuation, or the word and nothing."""
        letters = pc.utf8_rtrim(words, characters=_CLOSING)
        plain = pc.and_(pc.utf8_is_alpha(letters), pc.match_substring_regex(letters, _PLAIN))
        return pc.if_else(plain, pc.utf8_lower(letters), words), pc.if_else(plain, pc.replace_substring_regex(words, r"^\pL+", ""), "")

    def learn(self, unseen: list[str]) -> list[bytes]:
        """Letters are one pre-token each, whose last id ends a word, so many of them can be encoded as one text."""
        found: dict[str, bytes] = {}
        plain = [w for w in unseen if w.isalpha() and max(w) < _PLAIN_END]
        for k in range(0, len(plain), 256):
            some = plain[k : k + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                found.update((w, ids[i:j].tobytes()) for w, i, j in zip(some, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
        rest = [w for w in unseen if w not in found]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            found.update((w, np.array(e.ids, "<u2").tobytes()) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return [found[w] for w in unseen]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as unsigned 16-bit integers."""
        offsets, coded = wordhash.split(texts)
        stem, tail = self.parts(coded.dictionary.cast(pa.string()))
        keys = pa.concat_arrays([stem, tail]).dictionary_encode()
        n, distinct = len(stem), keys.dictionary
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
        at, there = self.seen.find(hashed, distinct)
        unseen = np.flatnonzero(~there)
        new = self.learn(distinct.take(pa.array(unseen)).to_pylist())
        # ids of the distinct keys, those that were seen first
        old = np.flatnonzero(there)
        size, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[old] = self.seen.size[at[old]]
        begin[old] = (np.cumsum(self.seen.size) - self.seen.size)[at[old]]
        size[unseen] = [len(x) // 2 for x in new]
        begin[unseen] = len(self.seen.ids) + np.cumsum(size[unseen]) - size[unseen]
        flat = np.concatenate([self.seen.ids, np.frombuffer(b"".join(new), "<u2")])
        known = self.seen.hash[at[unseen]] == hashed[unseen] if len(self.seen.hash) else np.zeros(len(unseen), bool)  # a hash stands for one text only
        self.seen.add(hashed[unseen][~known], distinct.take(pa.array(unseen[~known])), [x for x, k in zip(new, known, strict=True) if not k])
        codes, word = keys.indices.to_numpy(), coded.indices.to_numpy()
        parts = np.stack([codes[:n][word], codes[n:][word]], axis=1).ravel()
        each = size[parts]
        edges = np.concatenate([[0], np.cumsum(each)])[::2]
        ids = gather(flat, begin[parts], each)
        return [ids[i:j].tobytes() for i, j in zip(edges[offsets[:-1]], edges[offsets[1:]], strict=True)]

    def cells(self, ids: bytes) -> np.ndarray:
        """The document's cell: unit vector of id counts, projected, each coordinate to BITS bits."""
        if not ids:
            return np.zeros(DIMENSIONS, np.int64)
        values, counts = np.unique(np.frombuffer(ids, "<u2"), return_counts=True)
        point = counts @ self.signs[values] / np.sqrt(np.dot(counts.astype(np.float64), counts))
        return np.clip((point + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary, unsigned 16 bit, with the end id), n_tokens, key (Hilbert key and tie bits)."""
    id_field = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(tokenizer)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in wordhash.slices(batch, "text", TOGETHER):
                ids = words.encode(part.column("text"))
                key = hilbert_key(np.array([words.cells(x) for x in ids]), BITS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x + end for x in ids], pa.binary()), pa.array([len(x) // 2 + 1 for x in ids], pa.int64()), pa.array((key << _TIE_BITS) | part.column("tie").to_numpy(), pa.int64())],
                    ["doc_id", "ids", "n_tokens", "key"],
                )

    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _TIE_BITS)).alias("tie")
    return docs.select("doc_id", "text", tie).mapInArrow(run, f"doc_id {id_field.dataType.simpleString()}, ids binary, n_tokens long, key long")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, ranges: int | None = None) -> DataFrame:
    """Pack docs (doc_id, text). A row for each piece: doc_id, start, length, ids (binary, unsigned 16 bit),
    ids_crc32, doc_tokens, sequence_id, offset, curve_key.
    """
    spark = docs.sparkSession
    n = ranges or shuffle_partitions(spark)
    coded = materialise(tokenise(docs, tokenizer, end_id), "packing")
    # borders of about equally many tokens: a document counts once for each WEIGHT tokens
    weighed = coded.select("key", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / WEIGHT).cast("int"))))
    shares = [i / n for i in range(1, n)]
    found = weighed.agg(F.percentile_approx("key", shares, max(10_000, 20 * n)).alias("borders")).first()["borders"] if n > 1 else None
    borders = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, key.to_numpy(), "right").astype("int32"))

    placed = coded.withColumn("part", range_of("key"))
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a range
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    id_field = docs.schema["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, ROWS):
                batch, out = whole_batch.slice(first, ROWS), []
                for p, doc_id, ids, key in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids", "key")), strict=True):
                    if p != part:
                        part, at = p, base[p]
                    whole, done = np.frombuffer(ids, "<u2"), 0
                    while done < len(whole):
                        take = min(sequence - at % sequence, len(whole) - done)
                        piece = whole[done : done + take]
                        out.append((doc_id, done, take, piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes()), len(whole), at // sequence, at % sequence, key >> _TIE_BITS))
                        done, at = done + take, at + take
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(id_field.dataType), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    schema = f"doc_id {id_field.dataType.simpleString()}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
    return placed.select("part", "doc_id", "ids", "key").repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "ids").mapInArrow(cut, schema)
