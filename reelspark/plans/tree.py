"""Queries on folders of uneven depth, made from the documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.paths import contained
from reelspark.operators import tree
from reelspark.sources.catalog import table


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size: two to five components."""
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", F.when(i % 4 > 0, F.col("lang")), F.when(i % 4 > 1, F.concat(F.lit("y"), i % 10)), F.when(i % 4 > 2, F.concat(F.lit("z"), i % 3)), F.concat(F.lit("doc_"), i))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"))


def _with_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size: discs, what lies beside their structures, discs inside discs, folders whose names begin alike, and plain files."""
    i = F.col("doc_id")
    disc = F.concat(F.lit("disc_"), F.floor(i / 9) % 5)
    below = (
        F.when(i % 9 == 0, F.concat(disc, F.lit("/BDMV/STREAM/"), i)).when(i % 9 == 1, F.concat(disc, F.lit("/extra/"), i)).when(i % 9 == 2, F.concat(disc, F.lit(" x/"), i))
        .when(i % 9 == 3, F.concat(disc, F.lit("/BDMV/inner/VIDEO_TS/"), i)).when(i % 9 == 4, F.concat(disc, F.lit("/sub/VIDEO_TS/"), i)).otherwise(F.concat(F.lit("doc_"), i))
    )
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", below).alias("path"), F.col("n_chars").alias("size"))


def library_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, U1, A23 on folders of uneven depth."""
    return tree.browse_tree(_deep(spark, sf_dir))


def library_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All below one folder, by the numbers."""
    return tree.subtree(library_tree(spark, sf_dir), "src3/de").select("path", "kind", "begin")


def disc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs as one item each."""
    return tree.collapse_discs(_with_discs(spark, sf_dir))


def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest of some folders above each file, and whether a path with steps up stays below its first folder."""
    files = _deep(spark, sf_dir)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rooted = tree.enclosing_root(files.drop("size"), files.filter("doc_id % 37 = 0").select(folder.alias("root")))
    steps = F.concat("path", F.when(F.col("doc_id") % 3 == 0, "/../..").when(F.col("doc_id") % 3 == 1, "/./../../../..").otherwise("//x/.."))
    return rooted.select("doc_id", "path", "root", contained(steps, F.split("path", "/")[0]).alias("inside"))


QUERIES = {f.__name__: f for f in (library_tree, library_subtree, disc_items, nearest_roots)}

_DEEP = """deep AS (
  SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 4 > 0 THEN lang END, CASE WHEN doc_id % 4 > 1 THEN 'y' || doc_id % 10 END, CASE WHEN doc_id % 4 > 2 THEN 'z' || doc_id % 3 END, 'doc_' || doc_id) AS path, n_chars AS size
  FROM documents
)"""
_TREE = f"""WITH RECURSIVE {_DEEP}, files AS (
  SELECT string_split(path, '/') AS parts, max(size) AS size FROM deep GROUP BY path
), above AS (
  SELECT parts AS node, parts[1:len(parts) - 1] AS parts, size FROM files
  UNION ALL SELECT node, parts[1:len(parts) - 1], size FROM above WHERE len(parts) > 0
), folders AS (
  SELECT parts, count(*) AS n_files, sum(size)::BIGINT AS size FROM above GROUP BY parts
), nodes AS (
  SELECT parts, 'folder' AS kind, n_files, size FROM folders UNION ALL SELECT parts, 'file', 1, size FROM files
), up AS (
  SELECT parts AS node, kind, parts[1:len(parts) - 1] AS parts FROM nodes WHERE len(parts) > 0
  UNION ALL SELECT node, kind, parts[1:len(parts) - 1] FROM up WHERE len(parts) > 0
), inside AS (
  SELECT parts, count(*) AS n FROM up GROUP BY parts
), keyed AS (
  SELECT *, list_transform(parts, lambda x, i: CASE WHEN kind = 'file' AND i = len(parts) THEN '0' || x ELSE '1' || x END) AS key, CASE WHEN len(parts) > 0 THEN parts[1:len(parts) - 1] END AS parent FROM nodes
), placed AS (
  SELECT *, row_number() OVER (ORDER BY key) AS "begin", row_number() OVER (PARTITION BY parent ORDER BY kind = 'file', parts) AS ordinal FROM keyed
), tree AS (
  SELECT array_to_string(p.parts, '/') AS path, kind, len(p.parts)::INTEGER AS depth, "begin", "begin" + CASE WHEN kind = 'folder' THEN coalesce(n, 0) ELSE 0 END AS "last", ordinal, n_files, size
  FROM placed p LEFT JOIN inside i ON i.parts = p.parts
)"""

ORACLES = {
    "library_tree": f"{_TREE} SELECT * FROM tree",
    "library_subtree": f"""{_TREE} SELECT path, kind, "begin" FROM tree WHERE path = 'src3/de' AND kind = 'folder' OR starts_with(path, 'src3/de/')""",
    "disc_items": """WITH f AS (
  SELECT doc_id, n_chars AS size, source || '/' || lang || '/' || CASE doc_id % 9
    WHEN 0 THEN 'disc_' || doc_id // 9 % 5 || '/BDMV/STREAM/' || doc_id WHEN 1 THEN 'disc_' || doc_id // 9 % 5 || '/extra/' || doc_id WHEN 2 THEN 'disc_' || doc_id // 9 % 5 || ' x/' || doc_id
    WHEN 3 THEN 'disc_' || doc_id // 9 % 5 || '/BDMV/inner/VIDEO_TS/' || doc_id WHEN 4 THEN 'disc_' || doc_id // 9 % 5 || '/sub/VIDEO_TS/' || doc_id ELSE 'doc_' || doc_id END AS path
  FROM documents
), roots AS (
  SELECT DISTINCT regexp_extract(path, '^(.+)/(BDMV|VIDEO_TS)/', 1) AS root FROM f WHERE regexp_matches(path, '/(BDMV|VIDEO_TS)/')
  UNION SELECT DISTINCT regexp_extract(path, '^(.+?)/(BDMV|VIDEO_TS)/', 1) FROM f WHERE regexp_matches(path, '/(BDMV|VIDEO_TS)/')
), owned AS (
  SELECT doc_id, path, size, (SELECT arg_min(root, length(root)) FROM roots WHERE starts_with(path, root || '/')) AS root FROM f
)
SELECT path, 'file' AS kind, 1::BIGINT AS n_files, size FROM owned WHERE root IS NULL
UNION ALL SELECT root, 'disc', count(*), sum(size)::BIGINT FROM owned WHERE root IS NOT NULL GROUP BY root""",
    "nearest_roots": f"""WITH {_DEEP}, roots AS (
  SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM deep WHERE doc_id % 37 = 0
)
SELECT doc_id, path, (SELECT arg_max(root, length(root)) FROM roots WHERE starts_with(path, root || '/')) AS root,
  CASE doc_id % 3 WHEN 0 THEN len(string_split(path, '/')) - 2 >= 1 WHEN 1 THEN len(string_split(path, '/')) - 4 >= 1 ELSE true END AS inside
FROM deep""",
}
