"""Byte-level BPE encoding and decoding over chunks.

A text is cut into overlapping chunks, one row each. Every chunk is pre-tokenised by itself, beginning at
its first *sure* boundary: a space between two characters that are not white space. No pre-token of the
pattern can span such a place and none looks behind it, so boundaries found from there on are those of
the whole text. Two neighbouring chunks are stitched at the first boundary in their overlap that both
have; where they have none in common (a run of thousands of letters, say) the chunks are joined and
encoded as one. The pieces between stitches are then encoded independently, each cut again at its own sure boundaries,
about every ``PIECE`` characters. A text of one chunk is one piece and needs no stitching and no shuffle. Decoding concatenates the bytes of the ids.

Defined results: a null text is empty and has no ids; equal rows are encoded each by itself; ids,
doc_id and order of chunks decide the result, never the number of partitions.
"""

from __future__ import annotations

import base64


import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP, PIECE = 16_384, 512, 1_024
#: A boundary this near to a chunk's end could be changed by what follows ('re, 've, 'll).
_UNSURE = 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one rank file; one per worker and file."""

    _loaded: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.find = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the text is cut where a pre-token is sure to begin."""
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = _SURE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            ids += self.encoding.encode_ordinary(text[at:end])
            at = end
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, text: str, first: bool) -> list[int]:
        """Starts of the pre-tokens from the first sure boundary on."""
        sure = None if first else _SURE.search(text)
        at = 0 if first else sure.start() if sure else len(text)
        return [m.start() for m in self.find.finditer(text, at)]


_SURE = regex.compile(r"(?<=\S) (?=\S)")


def pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Cut the texts of docs (row_id, text) into row_id, run, piece; the pieces of a row follow each other by run."""
    if overlap > chunk:
        raise ValueError("the overlap must not be longer than a chunk")
    n = F.length("text")
    body = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)))
    rows = docs.filter(n > 0).select("row_id", F.posexplode(body).alias("no", "body"))

    @F.pandas_udf("head array<int>, tail array<int>")
    def scan(no: pd.Series, body: pd.Series) -> pd.DataFrame:
        codec = Codec.of(path, pattern)
        found = [codec.starts(b, k == 0) for k, b in zip(no, body, strict=True)]
        head = [[s for s in x if s < overlap] for x in found]
        tail = [[s - chunk for s in x if chunk <= s < len(b) - _UNSURE] for x, b in zip(found, body, strict=True)]
        return pd.DataFrame({"head": head, "tail": tail})

    w = Window.partitionBy("row_id").orderBy("no")
    scanned = rows.repartition("row_id", "no").select("row_id", "no", "body", scan("no", "body").alias("at"))
    common = F.array_min(F.array_intersect(F.lag("at.tail").over(w), F.col("at.head")))
    cut = scanned.withColumn("sync", common).withColumn("after", F.coalesce(F.lead("sync").over(w), F.lit(0)))
    begin = F.coalesce("sync", F.lit(0))
    cut = cut.select(
        "row_id",
        "no",
        F.sum(F.when(F.col("sync").isNotNull(), 1).otherwise(0)).over(w).alias("run"),
        F.substring(F.col("body"), begin + 1, chunk + F.col("after") - begin).alias("piece"),
    )
    parts = F.array_sort(F.collect_list(F.struct("no", "piece")))
    return cut.groupBy("row_id", "run").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("piece"))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (binary, little-endian unsigned 32-bit)."""

    @F.pandas_udf("binary")
    def encode(text: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return text.map(codec.encode)

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: b"".join(p["ids"] for p in sorted(x, key=lambda p: p["run"])))

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = base.filter(F.length("text") <= chunk).select("doc_id", encode("text").alias("ids"))
    long = base.filter(F.length("text") > chunk).withColumn("row_id", F.struct("doc_id", F.monotonically_increasing_id().alias("k")))
    coded = pieces(long, path, pattern, chunk, overlap).select("row_id", "run", encode("piece").alias("ids"))
    coded = coded.groupBy("row_id").agg(F.collect_list(F.struct("run", "ids")).alias("parts"))
    return short.unionByName(coded.select(F.col("row_id.doc_id").alias("doc_id"), joined("parts").alias("ids")))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add decoded (binary), the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return ids.map(codec.decode)

    return encoded.withColumn("decoded", decode("ids"))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of every document's ids and of the bytes decoded from them."""
    coded = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
