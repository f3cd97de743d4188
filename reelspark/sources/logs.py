"""Tolerant readers of append-only logs and labelled lists: what is broken is counted, what older rows lack is filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of schema from a log of one JSON object a line (line: string), and ``rejected``.

    A line is rejected if it is no whole object or a value has another type; all its columns are null then. A column that a line lacks, or has as null, gets its default. Columns
    not in the schema are skipped. Blank and null lines are no rows.
    """
    rows = lines.filter(F.trim("line") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"}
    # exploded, so that a line is parsed once and not for each use of its columns
    parsed = rows.select(F.trim("line").alias("line"), F.explode(F.array(F.from_json("line", f"{schema}, broken_ string", options))).alias("x"))
    rejected = F.col("x").isNull() | F.col("x.broken_").isNotNull() | ~F.col("line").startswith("{")
    names = [f.strip().split()[0] for f in schema.split(",")]
    filled = [F.coalesce(F.col(f"x.{n}"), F.lit(defaults[n])) if defaults and n in defaults else F.col(f"x.{n}") for n in names]
    parsed = parsed.withColumn("rejected", rejected)
    return parsed.select(*(F.when(~F.col("rejected"), c).alias(n) for n, c in zip(names, filled, strict=True)), "rejected")


def parse_labelled(lines: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a list with tabs between them (line: string), and ``rejected`` where a line has another number of them. Blank lines, null ones and those that begin with ``#`` are no rows."""
    rows = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    cells = F.split(F.regexp_replace("line", "\r$", ""), "\t", -1)
    fits = F.size(cells) == len(columns)
    return rows.select(*(F.when(fits, F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(columns)), (~fits).alias("rejected"))
