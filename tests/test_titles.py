"""Titles, durations and cut texts."""

from pyspark.sql import functions as F

from reelspark.functions import text

TITLES = {
    "Amélie": "amelie", "Le Fabuleux Destin d'Amélie Poulain": "fabuleux destin d amelie poulain", "Bjørn": "bjorn", "Straße": "strasse", "Æon Flux": "aeon flux", "Œuvre þing": "oeuvre thing",
    "The Matrix": "matrix", "Matrix, The": "matrix", "Der Untergang": "untergang", "Les Misérables": "miserables", "The": "the", "": "", "!!": "", "The The": "the", "The A": "a",
    "S.W.A.T.": "swat", "The.S.W.A.T.Team": "swatteam", "Destin.d.Amelie": "destin d amelie", "Episode.IV.A.New.Hope": "episode 4 a new hope", "a.b.c": "abc", "x1.a.b.": "x1 ab", "xa.b.": "xa b", "\x00a\x01b\x00": "b", "É.T. & U.F.O.": "et and ufo",
    "WALL·E": "wall e", "Spider-Man": "spider man", "Fast & Furious": "fast and furious", "Rocky II": "rocky 2", "Rocky 2": "rocky 2", "Apollo XIII": "apollo 13", "I": "i", "XX": "20",
    "Vive la France": "vive la france", "Ivan the Terrible": "ivan the terrible", "L'été": "ete", "Gli Ultimi": "ultimi", "Łódź ŞİŞ": "lodz sis", "日本": "",
}


def test_title_keys_are_the_references(spark):
    rows = spark.createDataFrame([(k, v) for k, v in TITLES.items()], "t string, want string").withColumn("got", text.title_key(F.col("t")))
    assert [tuple(r) for r in rows.filter("got != want OR got IS NULL").collect()] == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text.title_key(F.col("t"))).first()[0] is None


def test_durations_and_cut_texts(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,), (59.9,), (3599.0,), (3661.0,), (360000.0,)], "s double")
    assert [r[0] for r in rows.select(text.human_duration(F.col("s"))).collect()] == ["—"] * 5 + ["0:59", "59:59", "1:01:01", "100:00:00"]
    assert list(spark.sql("SELECT 'abc' AS t, 'abcd' AS u, '日本語文' AS v").select(text.ellipsize(F.col("t"), 3), text.ellipsize(F.col("u"), 3), text.ellipsize(F.col("v"), 3), text.ellipsize(F.col("u"), 0)).first()) == ["abc", "ab…", "日本…", "…"]
