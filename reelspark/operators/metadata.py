"""Merging metadata of several providers, and choosing artwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import language
from reelspark.functions.text import weighted_rating


def merge_fields(fragments: DataFrame, ranking: DataFrame, unlisted: int = 127) -> DataFrame:
    """For each item and field the value of the best ranked provider (then the least value); blanks never win.

    ranking: provider, pos; a small dimension. The winner is a least struct, so fragments combine before the shuffle.
    """
    ranked = fragments.filter(F.col("value").rlike(r"(?U)\S")).join(F.broadcast(ranking), "provider", "left").withColumn("rank", F.coalesce("pos", F.lit(unlisted)))
    best = ranked.groupBy("item", "field").agg(F.min(F.struct("rank", "value", "provider")).alias("best"), F.countDistinct("provider").alias("n_providers"))
    return best.select("item", "field", "best.value", "best.provider", "n_providers")


def merge_fragments(base: DataFrame, fragments: DataFrame, ranking: DataFrame, unlisted: int = 127) -> DataFrame:
    """What stands for each item, field_group and name once fragments are merged into a base bundle.

    base: item, field_group, name, value, kind, provider, rank, locked; fragments: item, field_group, name, value, kind, provider. kind: 0 derived,
    1 provider, 2 sidecar, 3 user, the higher wins; among providers the better rank, then the greater id, then the greater value. Blank
    fragments never win, a locked base always does. ranking: field_group (null: default order), provider, pos from 0; a group's own order replaces the
    default one, and who is not in it ranks ``unlisted``. The winner is a greatest struct, so fragments combine before the shuffle.
    """
    own = ranking.filter("field_group IS NOT NULL").select("field_group", "provider", F.col("pos").alias("own_pos"))
    groups = own.select("field_group").distinct().withColumn("listed", F.lit(True))
    default = ranking.filter("field_group IS NULL").select("provider", F.col("pos").alias("default_pos"))
    rows = fragments.filter(F.col("value").rlike(r"(?U)\S")).join(F.broadcast(own), ["field_group", "provider"], "left").join(F.broadcast(groups), "field_group", "left").join(F.broadcast(default), "provider", "left")
    pos = F.coalesce(F.when(F.col("listed"), F.col("own_pos")).otherwise(F.col("default_pos")), F.lit(unlisted))
    rows = rows.withColumn("rank", F.when(pos > 255, unlisted).otherwise(pos)).withColumn("locked", F.lit(False))
    columns = ["item", "field_group", "name", "value", "kind", "provider", F.col("rank").cast("int").alias("rank"), "locked"]
    both = base.select(*columns).unionByName(rows.select(*columns))
    ours = F.col("kind") == 1
    order = F.struct("locked", "kind", F.when(ours, -F.col("rank")).otherwise(0).alias("r"), F.when(ours, F.col("provider")).otherwise("").alias("p"), "value")
    best = both.groupBy("item", "field_group", "name").agg(F.max(order).alias("x"))
    return best.select("item", "field_group", "name", "x.value", "x.kind", F.when(F.col("x.kind") == 1, F.col("x.p")).alias("provider"), "x.locked")


def best_artwork(artwork: DataFrame) -> DataFrame:
    """One picture for each item and kind: provider rank, weighted rating to three places, width, url."""
    score = F.floor(weighted_rating(F.col("rating"), F.col("votes")) * 1000)
    order = F.struct("provider_rank", (-score).alias("s"), (-F.col("width")).alias("w"), "url")
    return artwork.groupBy("item", "kind").agg(F.min(order).alias("best")).select("item", "kind", "best.url", (-F.col("best.w")).alias("width"), (-F.col("best.s")).alias("score"))


# Fixed values of each kind of picture: what language means for it, ideal width by height and how far from it, least width.
KINDS = {
    "poster": ("user", 0.667, 0.08, 500), "season_poster": ("user", 0.667, 0.08, 500), "logo": ("user", 2.5, 2.0, 400), "clear_art": ("user", 2.5, 2.0, 400), "banner": ("user", 5.4, 0.6, 758), "album_cover": ("user", 1.0, 0.05, 500),
    "backdrop": ("textless", 1.778, 0.15, 1280), "artist_background": ("textless", 1.778, 0.15, 1280), "disc": ("textless", 1.0, 0.05, 400), "thumb": ("textless", 1.778, 0.15, 640),
    "episode_still": ("any", 1.778, 0.15, 640), "actor_headshot": ("any", 0.667, 0.25, 185),
}


def select_artwork(artwork: DataFrame, wanted: list[str]) -> DataFrame:
    """One picture for each item and kind, with the language policy of its kind; item, kind, url, textless, aspect_ok.

    artwork: item, kind, url, language, width, height, rating, votes, provider_rank. Size and aspect count unless no picture has both. Then, by policy:
    pictures without text first; or those in the best wanted language, else without text, else any; or no matter. Then by provider, weighted
    rating to three places, width, url. One least struct over all, so pictures combine before the shuffle. Of different
    tags at one language step the least counts.
    """
    def of(place: int) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[place]))), F.col("kind"))

    rows = artwork.filter(F.col("kind").isin(*KINDS)).withColumn("tag", language.tag(F.col("language")))
    aspect = F.when(F.col("height") == 0, 0.0).otherwise(F.col("width") / F.col("height"))
    ok = F.abs(aspect - of(1)) <= of(2)
    textless = F.col("tag") == "und"
    step = language.step(F.col("tag"), wanted)
    n = 2 * len(wanted)
    by_language = F.when(of(0) == "any", 0).when(of(0) == "textless", F.when(textless, 0).otherwise(1)).otherwise(F.when(step < n, step).when(textless, n).otherwise(n + 1))
    same = F.when((of(0) == "user") & (step < n), F.col("tag")).otherwise("")
    order = F.struct(
        (~(ok & (F.col("width") >= of(3)))).alias("poor"), by_language.alias("language"), same.alias("tag"), F.col("provider_rank").alias("provider"),
        (-F.floor(weighted_rating(F.col("rating"), F.col("votes")) * 1000)).alias("score"), (-F.col("width")).alias("width"), "url", textless.alias("textless"), ok.alias("aspect_ok"),
    )
    return rows.groupBy("item", "kind").agg(F.min(order).alias("x")).select("item", "kind", "x.url", "x.textless", "x.aspect_ok")
