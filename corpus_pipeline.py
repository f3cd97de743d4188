"""A training corpus from raw documents: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``documents``: doc_id, text, lang, source, n_chars.
Null and repeated rows take part like all others; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import language_id, ngram_join, packing, substring_dedup, toxicity
from reelspark.llm.common import held_out, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is too far from all that are known, and those without a letter."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.filter(~held_out()))
    return language_id.predict(docs, model).filter("accepted").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that score as toxic."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return toxicity.tag(docs, model).filter(F.col("score") < toxicity.PREDICT_AT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 of their five-word shingles, the one with the least doc_id stays.

    Rows alike in doc_id and text are one document; documents without words are no duplicates of each other.
    """
    docs = docs.select(*COLUMNS).withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("digest")))
    linked = ngram_join.similarity_components(docs.select(F.col("row").alias("doc_id"), "text"), n=5, num=4, den=5)
    stay = linked.filter("doc_id = component_id").select(F.col("doc_id").alias("row")).distinct()
    return docs.join(stay.hint("shuffle_hash"), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that also stand elsewhere go."""
    left = substring_dedup.remove_repeats(docs.select(*COLUMNS), carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of at most 4096 tokens along the curve."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: No stage but the passages' can be stated in SQL; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
