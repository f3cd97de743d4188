"""Bottom-k document fingerprints, in DataFrame operations only.

A text's words are cut into shingles of five consecutive words (a shorter text is one shingle, an empty
one has none); each shingle is hashed to 64 bits, and the fingerprint is the k smallest distinct hashes
in ascending order. Sketches of parts merge to the sketch of the whole; resemblance, containment and the
number of distinct shingles are estimated from sketches alone. While a text has at most k distinct
shingles, every estimate is exact.

Defined results: a null text is empty. Two empty fingerprints resemble each other fully (1.0), an empty
and a filled one not at all (0.0). Equal texts have equal fingerprints; repeated rows and rows without a
doc_id are kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import WORD_GAP

K, SHINGLE = 128, 5


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending."""

    def hashes(hw: Column) -> Column:
        n = F.size(hw)
        windows = F.transform(
            F.sequence(F.lit(1), n - shingle + 1),
            lambda i: F.xxhash64(*[F.element_at(hw, i + j) for j in range(shingle)]),
        )
        return F.when(n >= shingle, windows).when(n > 0, F.array(F.xxhash64(hw))).otherwise(F.array().cast("array<bigint>"))

    # The one-element array binds the hashed words once; a plain column could be inlined into the lambda.
    bound = F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), hashes)
    return F.slice(F.sort_array(F.array_distinct(bound[0])), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (shingles across the seam belong to neither part)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance: shared members among the k smallest of the union."""

    def share(u: Column) -> Column:
        return F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)

    both = F.transform(F.array(merge(a, b, k)), share)[0]
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = F.element_at(a, -1).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J(1 + |B|/|A|) / (1 + J), within 0 and 1."""
    j = resemblance(a, b, k)
    value = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / ((1 + j) * F.nullif(distinct_shingles(a, k), F.lit(0.0)))
    return F.coalesce(F.least(value, F.lit(1.0)), F.lit(1.0))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a member."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(ids: DataFrame, width: int, span: int) -> DataFrame:
    """(id, next_id) for distinct long ids; the last has a null next_id.

    ids are cut into blocks of ``width`` consecutive values; in a block a window finds the next id, and the
    last id of a block gets the head of the next block that has any, found by the same rule among block
    numbers. No window spans more than ``width`` rows, whatever the ids are.
    """
    block = F.floor(F.col("id") / width).cast("long") if span <= 2**52 else F.expr(f"(id - pmod(id, {width}L)) div {width}L")
    w = Window.partitionBy("block").orderBy("id")
    placed = ids.withColumn("block", block)
    local = placed.withColumn("next_id", F.lead("id").over(w))
    if span <= width:  # two blocks at most: one border to bridge
        heads = placed.groupBy("block").agg(F.min("id").alias("head")).withColumn("block", F.col("block") - 1)
    else:
        heads = placed.groupBy("block").agg(F.min("id").alias("head"))
        ahead = successors(heads.select(F.col("block").alias("id")), width, span // width + 1).dropna()
        heads = heads.join(ahead.select(F.col("id").alias("before"), F.col("next_id").alias("block")), "block").select(F.col("before").alias("block"), "head")
    return local.join(heads, "block", "left").select("id", F.coalesce("next_id", "head").alias("next_id"))


def with_next_document(docs: DataFrame, width: int = 256) -> DataFrame:
    """Add next_text and next_sketch: those of the following doc_id, after the last of the first.

    docs: doc_id, text, sketch. Each text is shuffled once, to its block of ``width`` ids; the head of every
    block is sent to the block before it as well. Rows that share a doc_id follow each other in the
    order of their text.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return docs.withColumn("next_text", F.col("text")).withColumn("next_sketch", F.col("sketch"))
    block = F.expr(f"(doc_id - pmod(doc_id, {width}L)) div {width}L")
    ids = docs.select(block.alias("id")).distinct()
    ahead = successors(ids, width, (high - low) // width + 1)
    first_block = low // width
    ahead = ahead.select(F.coalesce("next_id", F.lit(first_block)).alias("block"), F.col("id").alias("before"))
    placed = docs.withColumn("block", block)
    head = placed.groupBy("block").agg(F.min("doc_id").alias("doc_id"))
    head = head.join(ahead, "block").select("doc_id", "before")
    # Heads are rare (one in ``width``); the join keeps their texts only.
    sentinel = (
        placed.drop("block")
        .join(F.broadcast(head) if (high - low) // width < 100_000 else head, "doc_id")
        .select("before", F.struct("text", "doc_id", "sketch").alias("head"))
        .groupBy("before")
        .agg(F.min_by("head", F.struct("head.doc_id", "head.text")).alias("head"))
        .select(F.col("before").alias("block"), F.col("head.doc_id"), F.col("head.text"), F.col("head.sketch"), F.lit(1).alias("guest"))
    )
    w = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    own = placed.select("block", "doc_id", "text", "sketch", F.lit(0).alias("guest"))
    return (
        own.unionByName(sentinel)
        .withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_sketch", F.lead("sketch").over(w))
        .filter("guest = 0")
        .drop("block", "guest")
    )


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document, of its edited text, and the likeness to that and to the next one."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next_document(base.withColumn("sketch", sketch(F.col("text"), k)))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n - cut), F.left(F.coalesce("next_text", F.lit("")), cut))
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>")), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
