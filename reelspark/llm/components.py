"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component (least node reachable) for every node of a link.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on the least of them, so after a
    few rounds every component is a star. A node's neighbours are never gathered; hot nodes are a skewed join,
    which adaptive execution splits. Each round is written to the shared folder, and the round before deleted. The driver sees two numbers a round.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(edges.select("low", "high"))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        hung = large.join(least, "high")
        small = hung.select(F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("least").alias("low"))
        old, edges = edges, materialise(small.distinct(), "links")
        discard(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
