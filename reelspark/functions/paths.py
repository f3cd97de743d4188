"""Expressions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The parts between slashes that are not empty; null for a null path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def canonical(path: Column) -> Column:
    """The path without empty parts and ``.``, each ``..`` taking the part before it away; null if it leads above the top.

    Links are not resolved, as tables have none.
    """
    climb = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(x)))
    return F.array_join(F.aggregate(components(path), F.array().cast("array<string>"), climb), "/")


def contained(path: Column, root: Column) -> Column:
    """Whether the path, made canonical, is the root or lies below it; false for null and for paths that lead above the top."""
    own, top = canonical(path), canonical(root)
    return F.coalesce((own == top) | (top == "") | own.startswith(F.concat(top, F.lit("/"))), F.lit(False))


def ancestors(parts: Column) -> Column:
    """All folders above: arrays of components, from the top, which is empty."""
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.slice(parts, F.lit(1), k))
    return F.when(F.size(parts) > 0, above).otherwise(F.array().cast("array<array<string>>"))
