"""Scans of a listing of files: pruning, discs as one item, kinds by extension and signature, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import signatures
from reelspark.functions.paths import components
from reelspark.functions.text import ascii_lower

# Fixed values of S2, S4 and P2: folders not entered, folders that make a disc, and extensions by kind.
SKIPPED = (".git", ".svn", "node_modules", "$RECYCLE.BIN", "System Volume Information", ".Trash", ".Trashes", "@eaDir", "lost+found", "target")
DISCS = ("BDMV", "VIDEO_TS")
SUBTITLES = "srt ass ssa sub idx vtt sup smi".split()
AUDIO = "mp3 flac wav m4a aac ogg opus wma alac aiff ape dsf wv".split()
VIDEO = "mkv mp4 m4v avi mov wmv flv webm ts m2ts mts mpg mpeg vob ogv 3gp divx rmvb asf m2v mxf iso".split()


def extension(name: Column) -> Column:
    """What follows the last dot, A-Z in lower case; null without a dot or with none but the first character."""
    return F.when(name.rlike("(?s)^.+\\.[^.]*$"), ascii_lower(F.substring_index(name, ".", -1)))


def reachable(files: DataFrame, max_depth: int | None = None, discs: bool = True) -> DataFrame:
    """The files that a walk from the top meets, with name and disc: the number of folders above the first disc folder, or null.

    files: path (slashes), link (boolean: the file or a folder above is a link), other columns stay. Left out are links, names that begin with a
    dot, all below a folder that is skipped or begins with a dot, and all below more than max_depth folders. With discs, a file below a disc
    folder is met if that folder is, whatever its own name. Null paths are no files; a null link counts as none.
    """
    parts = components(F.col("path"))
    rows = files.filter("path IS NOT NULL AND NOT coalesce(link, false)").withColumn("parts_", parts).filter(F.size("parts_") > 0)
    folders, lower = F.slice("parts_", F.lit(1), F.size("parts_") - 1), lambda names: [n.lower() for n in names]
    closed = lambda x: x.startswith(".") | ascii_lower(x).isin(*lower(SKIPPED))
    first = lambda hit: F.array_position(F.transform(folders, hit), True)
    at_disc = F.nullif(first(lambda x: ascii_lower(x).isin(*lower(DISCS))), F.lit(0)) - 1 if discs else F.lit(None).cast("long")
    rows = rows.withColumns({"name": F.element_at("parts_", -1), "disc": at_disc.cast("int"), "closed_": (F.nullif(first(closed), F.lit(0)) - 1).cast("int")})
    above = F.coalesce("disc", F.size("parts_") - 1)
    open_ = F.coalesce(F.col("closed_") >= F.col("disc"), F.col("closed_").isNull()) & (F.col("disc").isNotNull() | ~F.col("name").startswith("."))
    rows = rows.filter(open_ if max_depth is None else open_ & (above <= max_depth))
    return rows.withColumn("disc_", F.when(F.col("disc").isNotNull(), F.slice("parts_", F.lit(1), F.col("disc") + 1))).drop("closed_", "parts_")


def candidates(files: DataFrame) -> DataFrame:
    """S3: files worth a look by their extension alone; discs are not told apart."""
    return reachable(files, discs=False).filter(extension(F.col("name")).isin(*VIDEO, *AUDIO, *SUBTITLES)).drop("disc", "disc_", "name")


def notes(size: Column) -> Column:
    """What is odd about a classified file (kind, container, extension, mismatch, unidentified, sample, title), as an array of texts."""
    col = F.col
    rules = [
        F.when(col("mismatch"), F.concat(F.lit("extension says ."), col("extension"), F.lit(" but the bytes are "), col("container"))),
        F.when(col("unidentified") & (col("kind") != "subtitle"), F.lit("no container signature matched; the player will still try it")),
        F.when(col("sample"), F.lit("looks like a sample clip")),
        F.when(F.coalesce(col("title"), F.lit("")) == "", F.lit("no title could be parsed from the name")),
        F.when((col("kind") == "video") & (size > 0) & (size < 1_000_000), F.concat(F.lit("only "), F.floor(size / 1024).cast("string"), F.lit(" KiB — likely truncated or a stub"))),
        F.when(size == 0, F.lit("zero bytes")),
    ]
    return F.array_compact(F.array(*rules))


def classified(files: DataFrame) -> DataFrame:
    """Adds extension, container, confidence, kind, mismatch and unidentified to files (name, head).

    Subtitles are known by extension and not read. A guess of confidence 0 is no identification. A kind is that of a subtitle's or audio
    extension, else video where a signature or extension says so, else other. Only a signature contradicts an extension.
    """
    rows = files.withColumn("extension", extension(F.col("name")))
    is_sub = F.coalesce(F.col("extension").isin(*SUBTITLES), F.lit(False))
    best = F.get(signatures.candidates(F.col("head")), F.lit(0))
    rows = rows.withColumn("best_", F.when(~is_sub, best)).withColumn("best_", F.when(F.col("best_.confidence") > signatures.WEAK, F.col("best_")))
    container, promised = F.col("best_.container"), signatures.promised(F.col("extension"))
    kind = F.when(is_sub, "subtitle").when(F.col("extension").isin(*AUDIO), "audio").when(container.isNotNull() | F.col("extension").isin(*VIDEO), "video").otherwise("other")
    rows = rows.withColumns({"container": container, "confidence": F.col("best_.confidence"), "kind": kind, "mismatch": F.coalesce(~signatures.same_family(container, promised), F.lit(False)), "unidentified": container.isNull()})
    return rows.drop("best_")


def scan(files: DataFrame, max_depth: int | None = None, samples: bool = False) -> DataFrame:
    """S2, S4, S5, P2, P3, and S1 without roots that are files and without a cap: a library's items: path, size, extension, kind, container, confidence, mismatch, unidentified, notes.

    files: path, size, link, head (binary), sample (boolean), title. Sizes below a disc folder are summed, partly before the shuffle, into one
    video item at the folder that holds the disc's (two discs of one folder are two items); an empty disc is not seen. Others are classified
    row by row. Samples, unless asked for, and files of no kind are left out; null flags count as false and null sizes as 0. Extra columns
    are dropped.
    """
    columns = ["path", "size", "extension", "kind", "container", "confidence", "mismatch", "unidentified", "notes"]
    met = reachable(files.select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "link", "head", F.coalesce("sample", F.lit(False)).alias("sample"), "title"), max_depth)
    whole = met.filter("disc IS NOT NULL").groupBy("disc_").agg(F.sum("size").alias("size"))
    folder = F.slice("disc_", F.lit(1), F.size("disc_") - 1)
    whole = whole.select(F.array_join(folder, "/").alias("path"), "size", F.lit(None).cast("string").alias("extension"), F.lit("video").alias("kind"), F.lit("DiscStructure").alias("container"),
                         F.lit(signatures.CERTAIN).alias("confidence"), F.lit(False).alias("mismatch"), F.lit(False).alias("unidentified"), F.lit(False).alias("sample"), F.try_element_at(folder, F.lit(-1)).alias("title"))
    single = classified(met.filter("disc IS NULL")).filter("kind != 'other'")
    if not samples:
        single = single.filter("NOT sample")
    return single.withColumn("notes", notes(F.col("size"))).select(*columns).unionByName(whole.withColumn("notes", notes(F.col("size"))).select(*columns))
