"""Scans of a listing made from the documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import signatures
from reelspark.operators import scan
from reelspark.sources.catalog import table

#: Heads that the listing's files begin with, before their text, as hex; R stands for a packet's rest of 187 letters.
HEADS = (
    "1A45DFA39F4286810142F7810142F28104428284" + "7765626D", "1A45DFA39F42868101", "4F676753", "524946460000000041564920", "524946460000000057415645", "0000001866747970" + "69736F6D",
    "0000001873747970" + "6D703432", "0000001866747970" + "6D703432" + "00000000" + "69736F6D636D6663", "000000086D6F6F76" + "00000000", "47R47R47R47R47R", "0102030405060747R47R47R47R", "000001BA",
    "FFD8FF", "494433", "664C6143", "47R47R47R00", "0000000047R0000000047R0000000047R0000000047R", "52494646", "0000001866747970" + "71742020", "",
)
EXTENSIONS = ("mkv", "mp4", "MKV", "srt", "mp3", "txt", "webm", "", "avi", "ts", "mov", "iso", "ogv", "flac", "vtt", "wmv")
FOLDERS = ("", ".git/", "a/Node_Modules/", "Disc/BDMV/STREAM/", "b/Disc 2/video_ts/.x/", "d/e/f/", "d/e/f/g/h/", ".hidden/BDMV/")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: folders to be skipped, discs, links, hidden names, samples and heads of all kinds are dealt by doc_id."""
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    ext, rest = pick(EXTENSIONS, F.floor(i / 3)), F.repeat(F.lit("78"), 187)
    name = F.concat(F.when(i % 37 == 0, ".").otherwise(""), F.lit("doc_"), i, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    made = F.unhex(F.replace(pick(HEADS, i), F.lit("R"), rest))
    head = F.when(i % 20 != 17, F.substring(F.concat(made, F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 1, 4096)).otherwise(made)
    size = F.when(i % 47 == 0, 0).otherwise(F.coalesce("n_chars", F.lit(0)) * 700)
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.concat("source", F.lit("/"), pick(FOLDERS, F.floor(i / 5)), name).alias("path"), size.alias("size"), (i % 43 == 0).alias("link"), head.alias("head"),
                                                    (i % 53 == 0).alias("sample"), F.when(i % 59 != 0, F.col("source")).alias("title"), ext.alias("ext"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a scan keeps, at most four folders deep, and what is odd about them."""
    return scan.scan(_listing(spark, sf_dir), max_depth=4).withColumn("notes", F.array_join("notes", "; "))


def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: what a new index would look at, by extension alone."""
    return scan.candidates(_listing(spark, sf_dir)).select("path")


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's containers to be tried, in order, the extension deciding between equally sure ones."""
    ranked: Column = signatures.ranked(signatures.candidates(F.col("head")), F.lower("ext"))
    return _listing(spark, sf_dir).select("id", F.array_join(F.transform(ranked, lambda x: F.concat(x["container"], F.lit(":"), x["confidence"])), ",").alias("found"))


QUERIES = {f.__name__: f for f in (scan_files, scan_candidates, sniffed)}

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_SQL = f"""n AS (SELECT doc_id AS id, doc_id // 3 % 16 AS e, source, text, n_chars FROM documents),
f AS (SELECT id, {_LIST(EXTENSIONS)}[e + 1] AS ext, source || '/' || {_LIST(FOLDERS)}[id // 5 % 8 + 1] || CASE WHEN id % 37 = 0 THEN '.' ELSE '' END || 'doc_' || id || CASE WHEN e = 7 THEN '' ELSE '.' || {_LIST(EXTENSIONS)}[e + 1] END AS path,
  CASE WHEN id % 47 = 0 THEN 0 ELSE n_chars * 700 END AS size, id % 43 = 0 AS link, id % 53 = 0 AS sample, CASE WHEN id % 59 <> 0 THEN source END AS title,
  left(replace({_LIST(HEADS)}[id % 20 + 1], 'R', repeat('78', 187)) || CASE WHEN id % 20 = 17 THEN '' ELSE hex(encode(text)) END, 8192) AS h FROM n),
sig(place, prefix, container, sure) AS (VALUES (3, '1A45DFA3', 'Matroska', 2), (4, '4F676753', 'Ogg', 2), (5, '464C5601', 'Flv', 2), (6, '3026B2758E66CF11', 'Asf', 2), (7, '000001BA', 'MpegPs', 2),
  (8, '000001B3', 'RawElementaryStream', 2), (9, '00000001', 'RawElementaryStream', 2), (10, '000001', 'RawElementaryStream', 1), (11, '1F565038', 'WebM', 2), (12, '444B4946', 'WebM', 2), (13, 'FFD8FF', 'RawElementaryStream', 1),
  (14, '494433', 'RawElementaryStream', 1), (15, '664C6143', 'RawElementaryStream', 2), (16, '0B7776704B', 'RawElementaryStream', 2), (17, '4D414320', 'RawElementaryStream', 2),
  (18, '44534420', 'RawElementaryStream', 2), (19, '46524D38', 'RawElementaryStream', 2)),
packets AS (SELECT id, size, min(start) AS start FROM (SELECT id, h FROM f WHERE contains(h, '47')), (VALUES (188), (192), (204)) z(size), range(204) r(start)
  WHERE start < size AND h[2 * start + 1 : 2 * start + 2] = '47' AND h[2 * (start + size) + 1 : 2 * (start + size) + 2] = '47'
    AND h[2 * (start + 2 * size) + 1 : 2 * (start + 2 * size) + 2] = '47' AND h[2 * (start + 3 * size) + 1 : 2 * (start + 3 * size) + 2] = '47' GROUP BY 1, 2),
brand AS (SELECT id, h[9:16] IN ('66747970', '73747970') AS typed, h[9:16] = '73747970' AS segment, h[17:24] AS main, [h[33 + 8 * i : 40 + 8 * i] FOR i IN range(8)] || [h[17:24]] AS brands FROM f
  WHERE length(h) >= 24 AND h[9:16] IN ('66747970', '73747970', '6D6F6F76', '6D646174', '66726565', '736B6970', '77696465', '706E6F74', '6D6F6F66')),
found AS (SELECT id, 1 AS place, CASE WHEN typed AND main <> '71742020' AND (segment OR list_has_any(brands, ['64617368', '636D6663', '636D6632', '6D736468', '6D736978', '69736F35', '69736F36'])) THEN 'FragmentedMp4' ELSE 'Mp4' END AS container, CASE WHEN typed THEN 2 ELSE 1 END AS sure FROM brand
  UNION ALL SELECT id, 2, 'WebM', 2 FROM f WHERE h LIKE '1A45DFA3%' AND contains(h[1:128], '4282847765626D')
  UNION ALL SELECT id, place, container, sure FROM f JOIN sig ON starts_with(h, prefix)
  UNION ALL SELECT id, 20, 'MpegTs', CASE WHEN arg_min(start, size) = 0 THEN 2 ELSE 1 END FROM packets GROUP BY id
  UNION ALL SELECT id, 21, CASE WHEN length(h) < 24 OR h[17:24] = '41564920' THEN 'Avi' ELSE 'RawElementaryStream' END, CASE WHEN length(h) >= 24 AND h[17:24] = '41564920' THEN 2 ELSE 1 END FROM f WHERE h LIKE '52494646%'
  UNION ALL SELECT id, 22, 'RawElementaryStream', 0 FROM f),
once AS (SELECT id, container, min(place) AS place, arg_min(sure, place) AS sure FROM found GROUP BY 1, 2)"""
_EXT = "CASE ext WHEN 'MKV' THEN 'mkv' ELSE ext END"
_IMPLIED = f"CASE {_EXT} WHEN 'mkv' THEN 'Matroska' WHEN 'webm' THEN 'WebM' WHEN 'mp4' THEN 'Mp4' WHEN 'mov' THEN 'Mp4' WHEN 'avi' THEN 'Avi' WHEN 'wmv' THEN 'Asf' WHEN 'ogv' THEN 'Ogg'"
_MET = r"""met AS (SELECT *, string_split(path, '/') AS p, list_position(list_transform(string_split(path, '/')[:-2], lambda x: lower(x) IN ('bdmv', 'video_ts')), true) AS disc,
  list_position(list_transform(string_split(path, '/')[:-2], lambda x: x LIKE '.%' OR lower(x) IN ('node_modules', '$recycle.bin', 'system volume information', '@eadir', 'lost+found', 'target')), true) AS closed FROM f WHERE NOT link)"""
ORACLES = {
    "sniffed": f"WITH {_SQL} SELECT id, string_agg(container || ':' || sure, ',' ORDER BY sure DESC, coalesce(container = implied, false) DESC, place) AS found FROM once JOIN (SELECT id, {_IMPLIED} WHEN 'ts' THEN 'MpegTs' WHEN 'iso' THEN 'DiscStructure' END AS implied FROM f) USING (id) GROUP BY id",
    "scan_candidates": f"WITH {_SQL}, {_MET} SELECT path FROM met WHERE closed IS NULL AND p[-1] NOT LIKE '.%' AND ext NOT IN ('', 'txt')",
    "scan_files": f"""WITH {_SQL}, {_MET}, best AS (SELECT id, arg_min(container, place - 100 * sure) AS container, max(sure) AS sure FROM once GROUP BY id HAVING max(sure) > 0),
c AS (SELECT path, size, CASE WHEN ext <> '' THEN {_EXT} END AS extension, sample, title, CASE WHEN ext IN ('srt', 'vtt') THEN 'subtitle' WHEN ext IN ('mp3', 'flac') THEN 'audio' WHEN container IS NOT NULL OR ext NOT IN ('', 'txt') THEN 'video' END AS kind,
  CASE WHEN ext NOT IN ('srt', 'vtt') THEN container END AS container, CASE WHEN ext NOT IN ('srt', 'vtt') THEN sure END AS confidence, {_IMPLIED} END AS implied
  FROM met LEFT JOIN best USING (id) WHERE disc IS NULL AND closed IS NULL AND p[-1] NOT LIKE '.%' AND len(p) <= 5),
d AS (SELECT *, coalesce(container <> implied AND NOT (container = 'FragmentedMp4' AND implied = 'Mp4') AND NOT (container IN ('Matroska', 'WebM') AND implied IN ('Matroska', 'WebM')), false) AS mismatch FROM c WHERE kind IS NOT NULL AND NOT sample
  UNION ALL SELECT array_to_string(p[:disc - 1], '/'), sum(size)::BIGINT, NULL, false, p[disc - 1], 'video', 'DiscStructure', 2, NULL, false FROM met WHERE disc IS NOT NULL AND (closed IS NULL OR closed > disc) AND disc <= 5 GROUP BY p[:disc], p[:disc - 1], p[disc - 1])
SELECT path, size, extension, kind, container, confidence::INTEGER AS confidence, mismatch, container IS NULL AS unidentified, concat_ws('; ', CASE WHEN mismatch THEN 'extension says .' || extension || ' but the bytes are ' || container END,
  CASE WHEN container IS NULL AND kind <> 'subtitle' THEN 'no container signature matched; the player will still try it' END, CASE WHEN sample THEN 'looks like a sample clip' END,
  CASE WHEN coalesce(title, '') = '' THEN 'no title could be parsed from the name' END, CASE WHEN kind = 'video' AND size > 0 AND size < 1000000 THEN 'only ' || size // 1024 || ' KiB — likely truncated or a stub' END, CASE WHEN size = 0 THEN 'zero bytes' END) AS notes FROM d""",
}
