"""Trees of any depth from paths: numbering for browsing, and items that stand for a whole folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.paths import ancestors, components
from reelspark.operators.ranges import carried, numbered, written

#: Folders that make the folder they stand in a disc.
DISC_PARTS = ("BDMV", "VIDEO_TS")


def browse_tree(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every file and folder of a library (path, size) as a node of its tree.

    Nodes are numbered in pre-order, a folder's own files before its subfolders; a node's subtree is the numbers from ``begin`` to ``last``, so it is a range filter.
    ``ordinal`` is the place among the children of the parent, folders first, then files, each by name. The order is by the bytes of the names.

    The numbering sorts by range, so neither a deep tree nor a folder with a third of all files is one task; sizes and counts of folders are combined before the shuffle.
    Rows of equal paths are one file of the greatest size; null, empty and all-slash paths are no files; a null size counts 0. A file and a folder may have the same path.
    Returns path, kind, depth, begin, last, ordinal, n_files, size.
    """
    found = files.withColumn("parts", components(F.col("path"))).filter(F.size("parts") > 0)
    found = found.groupBy("parts").agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"))
    below = found.select(F.explode(ancestors(F.col("parts"))).alias("parts"), "size").groupBy("parts").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))
    # each folder below adds a node to those above it
    inner = below.filter(F.size("parts") > 0).select(F.explode(ancestors(F.col("parts"))).alias("parts")).groupBy("parts").agg(F.count("*").alias("n_folders"))
    folders = below.join(inner, "parts", "left").select("parts", F.lit("folder").alias("kind"), "n_files", "size", (F.col("n_files") + F.coalesce("n_folders", F.lit(0))).alias("inside"))
    nodes = folders.unionByName(found.select("parts", F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n_files"), "size", F.lit(0).cast("long").alias("inside")))
    # the last component of a file goes before those of folders; a folder goes before all that it holds
    depth = F.size("parts")
    marked = F.transform("parts", lambda x, i: F.struct(F.when((F.col("kind") == "file") & (i == F.size("parts") - 1), 0).otherwise(1).alias("f"), x.alias("n")))
    nodes = written(nodes.withColumn("key", F.transform(marked, lambda x: F.concat(x["f"].cast("string"), x["n"]))))
    nodes = written(numbered(nodes, ["key"], "begin", ranges).drop("key"))
    nodes = nodes.withColumn("parent", F.when(depth > 0, F.slice("parts", F.lit(1), depth - 1))).withColumn("rank", F.when(F.col("kind") == "folder", 0).otherwise(1))
    children = numbered(nodes.filter("parent IS NOT NULL"), ["parent", "rank", "parts"], "among", ranges)
    first = children.groupBy("parent").agg(F.min("among").alias("first"))
    placed = children.join(first, "parent").withColumn("ordinal", F.col("among") - F.col("first") + 1).drop("among", "first")
    top = nodes.filter("parent IS NULL").withColumn("ordinal", F.lit(1).cast("long"))
    return placed.unionByName(top, allowMissingColumns=True).select(
        F.array_join("parts", "/").alias("path"), "kind", depth.alias("depth"), "begin", (F.col("begin") + F.col("inside")).alias("last"), "ordinal", "n_files", "size"
    )


def subtree(nodes: DataFrame, folder: str) -> DataFrame:
    """All nodes of a folder, itself first, by their numbers; nothing for a path that is no folder."""
    ends = nodes.filter((F.col("path") == folder) & (F.col("kind") == "folder")).select(F.col("begin").alias("from_"), F.col("last").alias("upto_"))
    return nodes.join(F.broadcast(ends), F.col("begin").between(F.col("from_"), F.col("upto_"))).drop("from_", "upto_").orderBy("begin")


def enclosing_root(files: DataFrame, roots: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add root to files (path): the deepest of roots (root: paths) that is the path or a folder above it; null if there is none.

    A sweep over files and roots sorted by components: the last root before a file, carried over range borders, is a root above it or has, among the roots above itself,
    all that are above the file too. So the open stack at a file is a suffix of that root's own chain. Equal files are all kept, in any number; equal roots are one.
    """
    tops = roots.select(components(F.col("root")).alias("parts")).filter("parts IS NOT NULL").distinct()
    own = tops.select("parts", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.slice("parts", F.lit(1), k))).alias("above"))
    chains = own.join(tops.select(F.col("parts").alias("above")), "above").groupBy("parts").agg(F.array_sort(F.collect_list("above")).alias("chain"))
    rows = files.withColumn("parts", components(F.col("path"))).withColumn("kind_", F.lit(1)).withColumn("id_", F.monotonically_increasing_id())
    marks = chains.select("parts", F.lit(0).alias("kind_"), F.lit(0).cast("long").alias("id_"), "chain")
    swept = carried(rows.unionByName(marks, allowMissingColumns=True), ["parts", "kind_", "id_"], F.col("chain"), "open", ranges).filter("kind_ = 1")
    fits = F.filter("open", lambda r: r == F.slice("parts", F.lit(1), F.size(r)))
    return swept.withColumn("root", F.array_join(F.get(fits, F.size(fits) - 1), "/")).drop("parts", "kind_", "id_", "chain", "open")


def disc_roots(files: DataFrame) -> DataFrame:
    """Root: the folders that hold a disc structure; nested ones below a disc's own structure are not looked for. The top itself is no disc."""
    parts = components(F.col("path"))
    at = lambda p: F.array_position(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.isin(*DISC_PARTS).cast("int")), 1)
    return files.select(parts.alias("p")).filter("size(p) > 2").withColumn("at", at(F.col("p"))).filter("at > 1").select(F.array_join(F.slice("p", F.lit(1), (F.col("at") - 1).cast("int")), "/").alias("root")).distinct()


def collapse_discs(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """The items of a library (path, size): a disc folder with all that lies below it is one item with the sum of its sizes; all other files stay.

    A walk from the top never enters a disc, so of nested discs the outermost counts. Returns path, kind (disc or file), n_files, size.
    Equal paths of a disc each add their size; null sizes count 0; a null path stays a file of its own.
    """
    rows = enclosing_root(files.select("path", F.coalesce("size", F.lit(0)).alias("size")), outermost(disc_roots(files)), ranges)
    discs = rows.filter("root IS NOT NULL").groupBy(F.col("root").alias("path")).agg(F.count("*").alias("n_files"), F.sum("size").alias("size")).withColumn("kind", F.lit("disc"))
    return rows.filter("root IS NULL").select("path", F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n_files"), "size").unionByName(discs)


def outermost(roots: DataFrame) -> DataFrame:
    """root: those of roots that no other lies above."""
    tops = roots.select("root", components(F.col("root")).alias("parts")).distinct()
    above = tops.select("root", F.explode(ancestors(F.col("parts"))).alias("parts")).join(tops.select("parts"), "parts", "left_semi").select("root").distinct()
    return tops.join(above, "root", "left_anti").select("root")
