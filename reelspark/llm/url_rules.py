"""URL allow and block rules as a sort-merge range join.

A host is turned into its reversed labels (``m.example.net`` -> ``net.example.m.``), so a rule on a
host covers one interval of keys: all keys that begin with the rule's key. Such intervals nest and
never overlap partly. Urls and rules are dealt into key ranges, sorted, and swept once per range; the
sweep keeps a stack of the rules whose interval is open. A rule whose interval crosses range borders is
sent to every range it touches, at most (nesting depth) copies a border more.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default
verdict. Of the rules that fit, the one with the most characters in host and path wins, then the longer
host, then ``block``. Repeated rows are judged each by itself; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import ascii_lower, shuffle_partitions

_LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))), F.lit(""))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"[.]")), "."), F.lit("."))


def _borders(keys: DataFrame, n: int, per_range: int) -> np.ndarray:
    """n - 1 key borders from a bounded hash-ordered sample; they steer the load, never the result."""
    rows = keys.orderBy(F.xxhash64("key", "salt")).limit(n * per_range).collect()
    found = sorted(r["key"] for r in rows)
    return np.array([found[len(found) * i // n] for i in range(1, n)] if found else [], dtype=object)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int | None = None,
    sample_per_range: int = 20,
) -> DataFrame:
    """Judge every url. ``rules`` has host, path, verdict; rows with a null field are not rules.

    Returns id_col, host, path, rule (host and path of the winning rule, or null) and verdict.
    """
    spark = pages.sparkSession
    n = ranges or shuffle_partitions(spark)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    page = src.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    page = page.withColumn("key", F.concat(host_key(F.col("host")), "path")).withColumn("salt", F.xxhash64("id"))
    borders = _borders(page.select("key", "salt"), n, sample_per_range)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        """Equal keys that fill whole ranges are spread over them by salt."""
        k = key.to_numpy(dtype=object)
        low, high = np.searchsorted(borders, k, "left"), np.searchsorted(borders, k, "right")
        return pd.Series((low + salt.to_numpy() % (high - low + 1)).astype("int32"))

    @F.pandas_udf("array<int>")
    def ranges_of(low: pd.Series) -> pd.Series:
        k = low.to_numpy(dtype=object)
        first = np.searchsorted(borders, k, "left")
        last = np.searchsorted(borders, np.array([x + _LAST for x in k], dtype=object), "right")
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last, strict=True)])

    rule = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .withColumn("key", host_key(F.col("host")))
        .withColumn("part", F.explode(ranges_of("key")))
    )
    id_type = src.schema["id"].dataType.simpleString()
    events = (
        page.select(range_of("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    ).unionByName(rule.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = -1, []  # of (key, {path: (host, verdict)}, path lengths from the longest)
        for batch in batches:
            out = []
            for p, key, kind, id_, host, path, verdict in zip(*(batch[c] for c in ("part", "key", "kind", "id", "host", "path", "verdict")), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    paths = stack[-1][1]
                    if paths.get(path, ("", ""))[1] != "block":
                        paths[path] = (host, verdict)
                    stack[-1][2][:] = sorted({len(x) for x in paths}, reverse=True)
                    continue
                best = None
                for _, paths, lengths in stack:
                    for m in lengths:
                        if len(path) >= m and (hit := paths.get(path[:m])):
                            found = (len(hit[0]) + m, len(hit[0]), hit[0] + path[:m], hit[1])
                            best = found if best is None or found[:2] > best[:2] else best
                            break
                out.append((id_, host, path, best and best[2], best[3] if best else default))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"], dtype=object)

    swept = (
        events.repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "key", "kind")
        .mapInPandas(sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("id", id_col)
