"""Matching names to candidates with an explicit margin over the runner-up: whole candidate lists, or the best one inside blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.text import runtime_agreement, similarity, title_similarity, year_agreement
from reelspark.operators.ranges import written

# Fixed values of F26 and W6: the weights of the signals, the least score of a candidate, that of a sure one, and what it must lead by.
TITLE, RUNTIME, YEAR, POPULARITY = 1.00, 0.45, 0.35, 0.05
LEAST, SURE, MARGIN, MOST = 0.45, 0.80, 0.08, 5


def weighted_score(title: Column, q_year: Column, c_year: Column, q_runtime: Column, c_runtime: Column, popularity: Column) -> Column:
    """the signals' weighted mean over those that both sides have; title and popularity (0 to 100, absent as 0) always count."""
    years, runtimes = q_year.isNotNull() & c_year.isNotNull(), q_runtime.isNotNull() & c_runtime.isNotNull()
    year = F.when(years, YEAR * year_agreement(q_year, c_year)).otherwise(0.0)
    runtime = F.when(runtimes, RUNTIME * runtime_agreement(q_runtime, c_runtime)).otherwise(0.0)
    liked = POPULARITY * F.least(F.greatest(F.coalesce(popularity / 100.0, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    whole = TITLE + POPULARITY + F.when(years, YEAR).otherwise(0.0) + F.when(runtimes, RUNTIME).otherwise(0.0)
    return F.round((TITLE * title + year + runtime + liked) / whole, 6)


def _keys(title: Column) -> Column:
    """Keys of which two titles share one if their similarity is above 0.

    Equal titles share the title, others with common words a word. A distance d of at most two fifths of the longer length n leaves
    n - 1 - 2 d common pairs of letters, which is at least one from n = 6 on; below, n - d common letters, at least one.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - 1, F.lit(1))), lambda i: F.concat(F.lit("2"), F.substring(title, i, F.lit(2))))
    letters = F.when(F.length(title) <= 5, F.transform(F.split(title, ""), lambda x: F.concat(F.lit("1"), x))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.split(title, " "), lambda x: F.concat(F.lit("w"), x))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), title)), words, pairs, letters))


#: Runtimes are compared slot by slot, of 4 % each; _ANY stands for all slots, _BELOW for runtimes below 0.
_STEP, _ANY, _BELOW = math.log(1.04), -1_000_000, -1_000_001
#: Scores are rounded to six places, so bounds leave room for that.
_ROOM = 1e-5
_WEIGHT_OF_GAP = {0: YEAR, 1: YEAR * 0.7, 2: YEAR * 0.3}


def _slot(log_runtime: Column) -> Column:
    return F.floor(log_runtime / F.lit(_STEP)).cast("long")


def _short_lists(c: DataFrame) -> DataFrame:
    """Of candidates equal in names, year and runtime those that can be among the best six of a query: of equal popularity the least ids, then
    the most popular ones. A sixth that is more popular by 0.005 of 100 leads in every rounded score."""
    alike = ["names", "c_year", "c_runtime"]
    c = c.withColumn("liked", F.least(F.greatest(F.coalesce(F.col("popularity") / 100.0, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy(*alike, "liked").orderBy("candidate"))).filter(F.col("n") <= MOST + 1)
    c = c.withColumn("n", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("liked"), "candidate")))
    sixth = F.max(F.when(F.col("n") == MOST + 1, F.col("liked"))).over(Window.partitionBy(*alike))
    return c.withColumn("sixth", sixth).filter(F.col("sixth").isNull() | (F.col("liked") >= F.col("sixth") - 5e-5)).drop("n", "liked", "sixth")


def _shelves(c: DataFrame) -> DataFrame:
    """Each candidate by its own year and all years, its own slot and all slots: what _probes asks for."""
    has_year, timed = F.col("c_year").isNotNull(), F.col("c_runtime") > 0
    years = F.when(has_year, F.array(F.struct(F.lit(True).alias("near"), F.col("c_year").cast("long").alias("at_year")), F.struct(F.lit(False).alias("near"), F.lit(0).cast("long").alias("at_year"))))
    years = F.coalesce(years, F.array(F.struct(F.lit(False).alias("near"), F.lit(0).cast("long").alias("at_year"))))
    slots = F.when(timed, F.array(_slot(F.log(F.col("c_runtime"))), F.lit(_ANY).cast("long"))).otherwise(F.array(F.lit(_ANY).cast("long")))
    c = c.withColumn("has_year", has_year).withColumn("has_runtime", F.col("c_runtime").isNotNull())
    return c.withColumn("at", F.explode(years)).withColumn("slot", F.explode(slots)).select("*", "at.near", "at.at_year").drop("at")


_SHELF = ["names", "has_year", "has_runtime", "near", "at_year", "slot"]


def _probes(least: Column) -> Column:
    """Shelves where a query with the titles' similarity ``similar`` can find a score of ``least``: the missing signals lower the sum that is
    needed; what the year gives, by its gap, bounds what the runtime must give, and so its slots."""
    found = []
    for has_year in (True, False):
        for has_runtime in (True, False):
            years = F.col("q_year").isNotNull() & F.lit(has_year)
            runtimes = F.col("q_runtime").isNotNull() & F.lit(has_runtime)
            whole = TITLE + POPULARITY + F.when(years, YEAR).otherwise(0.0) + F.when(runtimes, RUNTIME).otherwise(0.0)
            need = least * whole - TITLE * F.col("similar") - POPULARITY - _ROOM
            for gap in (None, 0, 1, -1, 2, -2) if has_year else (None,):
                left = need - (0.0 if gap is None else _WEIGHT_OF_GAP[abs(gap)])
                share = left / RUNTIME
                wide = F.log(1.0 + F.greatest(0.25 - 0.23 * share, F.lit(0.02))) + 1e-9
                at = F.log(F.when(F.col("q_runtime") > 0, F.col("q_runtime")))
                slots = F.when(left <= 0, F.array(F.lit(_ANY).cast("long"))).when(runtimes & (share <= 1) & at.isNotNull(), F.sequence(_slot(at - wide), _slot(at + wide)))
                if gap is not None:
                    slots = F.when(years, slots)
                found.append(F.struct(F.lit(has_year).alias("has_year"), F.lit(has_runtime).alias("has_runtime"), F.lit(gap is not None).alias("near"),
                                      (F.lit(0) if gap is None else F.coalesce(F.col("q_year") + gap, F.lit(0))).cast("long").alias("at_year"), slots.alias("slots")))
    return F.filter(F.array(*found), lambda x: x["slots"].isNotNull())


def _scores(probed: DataFrame, shelves: DataFrame) -> DataFrame:
    """Scored pairs of keys and candidates that meet on a shelf; on one for all years only those further apart than two have not met by year."""
    pairs = probed.join(shelves.hint("merge"), _SHELF).filter(F.col("near") | F.coalesce(F.abs(F.col("q_year") - F.col("c_year")) > 2, F.lit(True)))
    return pairs.withColumn("score", weighted_score(F.col("similar"), F.col("q_year"), F.col("c_year"), F.col("q_runtime"), F.col("c_runtime"), F.col("popularity")))


def _best_six(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST + 1)


def _bounds(keys: DataFrame, near: DataFrame, shelves: DataFrame) -> DataFrame:
    """keys with ``least``, a score that six candidates of the key reach, or LEAST.

    Looked for among the three most similar titles: first in the same year and about the same runtime, then in all years, then everywhere,
    each for the keys that have fewer than six so far, so that no step meets many candidates for many keys.
    """
    closest = near.withColumn("n", F.row_number().over(Window.partitionBy("q_title").orderBy(F.desc("similar"), "names"))).filter("n <= 3").drop("n")
    at = F.log(F.when(F.col("q_runtime") > 0, F.col("q_runtime")))
    around = F.sequence(_slot(at) - 1, _slot(at) + 1)
    yes, no, any_slot = F.lit(True), F.lit(False), F.array(F.lit(_ANY).cast("long"))

    def shelf(has_year: Column, has_runtime: Column, by_year: bool, slots: Column) -> Column:
        year = (F.coalesce("q_year", F.lit(0)) if by_year else F.lit(0)).cast("long")
        return F.struct(has_year.alias("has_year"), has_runtime.alias("has_runtime"), F.lit(by_year).alias("near"), year.alias("at_year"), slots.alias("slots"))

    everywhere = [shelf(F.lit(y), F.lit(t), False, any_slot) for y in (True, False) for t in (True, False)]
    steps = [("q_year IS NOT NULL AND q_runtime > 0", F.array(shelf(yes, yes, True, around))), ("q_runtime > 0", F.array(shelf(yes, yes, False, around), shelf(no, yes, False, around))), ("true", F.array(*everywhere))]
    done, open_keys = None, keys
    for where, shelves_of in steps:
        probed = open_keys.filter(where).join(closest, "q_title").withColumn("at", F.explode(shelves_of)).select("key", "q_year", "q_runtime", "similar", "names", "at.*")
        pairs = probed.withColumn("slot", F.explode("slots")).drop("slots").join(shelves.hint("merge"), _SHELF)
        score = weighted_score(F.col("similar"), F.col("q_year"), F.col("c_year"), F.col("q_runtime"), F.col("c_runtime"), F.col("popularity"))
        six = _best_six(pairs.select("key", "candidate", score.alias("score"))).groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        known = written(open_keys.join(six.filter(F.col("n") > MOST).drop("n"), "key", "left"))
        found = known.filter("least IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        open_keys = known.filter("least IS NULL").drop("least")
    return done.unionByName(open_keys.withColumn("least", F.lit(LEAST))).withColumn("least", F.greatest("least", F.lit(LEAST)))


def ranked_candidates(queries: DataFrame, candidates: DataFrame, itself: bool = True) -> DataFrame:
    """The best five candidates of each query among all that score 0.45, and whether the first is clearly the best.

    queries: id, title (normalized), year, runtime; candidates also popularity and alternates (array of normalized titles, may be null).
    Years, runtimes and popularity may be null (a runtime below 0 counts as null); rows without a title match nothing. Ids of candidates are
    distinct. With itself = False a query is no candidate of its own (equal ids). Returns query, place, candidate, score, margin, verdict.

    Queries of one title, year and runtime are one key. Similarities are taken once for each two distinct titles that share a key of letters
    (see _keys; no other two are similar). Of candidates equal in all but popularity and id a few stay (_short_lists). A first look gives every
    key a score that six candidates reach (_bounds); then it meets only those titles, years and runtimes that can reach it (_probes), so the
    pairs grow with the distinct years and runtimes around a key and not with the rows of a title. Six are kept a key, as one may be the
    query itself. Titles that are not similar reach 0.45 only by equal years, runtimes within 3 % and a popularity of 65:
    0.35 + 0.45 r + 0.05 p >= 0.45 * 1.85. Those pairs meet by year and runtime, for keys without six better ones.

    What grows with the candidates is joined by merging: the planner does not count what explode adds, so it would take exploded rows of a
    small file for a small table and send them whole through the driver.
    """
    runtime = F.when(F.col("runtime") >= 0, F.col("runtime"))
    q = queries.filter("title IS NOT NULL").select(F.col("id").alias("query"), F.col("title").alias("q_title"), F.col("year").alias("q_year"), runtime.alias("q_runtime"))
    q = q.withColumn("key", F.struct("q_title", "q_year", "q_runtime"))
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("title"), F.coalesce("alternates", F.array().cast("array<string>"))), lambda x: x.isNotNull())))
    c = candidates.select(F.col("id").alias("candidate"), names.alias("names"), F.col("year").alias("c_year"), runtime.alias("c_runtime"), F.col("popularity").cast("double").alias("popularity"))
    c = written(_short_lists(c.filter(F.size("names") > 0)))
    keys = q.select("key", "q_title", "q_year", "q_runtime").distinct()

    best = F.array_max(F.transform("names", lambda x: title_similarity(F.col("q_title"), x)))
    left = q.select("q_title").distinct().withColumn("token", F.explode(_keys(F.col("q_title"))))
    right = c.select("names").distinct().withColumn("token", F.explode(F.array_distinct(F.flatten(F.transform("names", _keys)))))
    near = written(left.join(right.hint("merge"), "token").select("q_title", "names").distinct().withColumn("similar", best).filter("similar > 0"))

    shelves = _shelves(c)
    keys = written(_bounds(keys, near, shelves))
    probed = keys.join(near, "q_title").withColumn("at", F.explode(_probes(F.col("least")))).select("key", "q_year", "q_runtime", "least", "similar", "names", "at.*")
    alike = _scores(probed.withColumn("slot", F.explode("slots")).drop("slots"), shelves)

    width = F.lit(math.log(1.03))
    by_runtime = keys.filter("q_runtime > 0 AND q_year IS NOT NULL AND least < 0.46").withColumn("slot", F.floor(F.log(F.col("q_runtime")) / width))
    liked = c.filter("c_runtime > 0 AND popularity >= 64.9").withColumn("own", F.floor(F.log(F.col("c_runtime")) / width))
    liked = liked.withColumn("slot", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    far = by_runtime.join(liked.hint("merge"), (by_runtime["slot"] == liked["slot"]) & (F.col("q_year") == F.col("c_year")))
    far = far.filter(F.abs(F.col("q_runtime") - F.col("c_runtime")) <= 0.03 * F.least("q_runtime", "c_runtime")).withColumn("similar", best).filter("similar = 0")
    far = far.withColumn("score", weighted_score(F.col("similar"), F.col("q_year"), F.col("c_year"), F.col("q_runtime"), F.col("c_runtime"), F.col("popularity")))

    columns = ("key", "candidate", "score")
    scored = alike.filter(F.col("score") >= F.col("least")).select(*columns).unionByName(far.filter(F.col("score") >= F.col("least")).select(*columns))
    lists = _best_six(scored).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "candidate", "score"))).alias("six"))
    others = F.col("six") if itself else F.filter("six", lambda x: x["candidate"] != F.col("query"))
    rows = q.select("query", "key").join(lists.hint("merge"), "key").withColumn("list", F.slice(others, 1, MOST)).filter(F.size("list") > 0)
    first, second = F.col("list")[0]["score"], F.try_element_at("list", F.lit(2))["score"]
    gap = F.round(first - F.coalesce(second, F.lit(0.0)), 6)
    sure = (first >= SURE) & (second.isNull() | (gap > MARGIN))
    rows = rows.select("query", F.posexplode("list").alias("n", "x"), gap.alias("margin"), F.when(sure, "matched").otherwise("ambiguous").alias("verdict"))
    return rows.select("query", (F.col("n") + 1).alias("place"), "x.candidate", "x.score", "margin", "verdict")


def best_candidates(queries: DataFrame, candidates: DataFrame, block: list[str], least: float = 0.45, sure: float = 0.8, margin: float = 0.08) -> DataFrame:
    """the best candidate of each query among those of its block alone, by title and runtime; ranked_candidates does J5, F26, O4 and W6.

    queries, candidates: id, title (normalized), runtime and the block columns; ids of candidates are distinct, but for rows equal
    in all. Equal titles of other blocks are not considered, and a row without runtime gets 0.7 at most.

    A score depends on titles and runtimes alone, so queries equal in block, title and runtime are one key, and of candidates equal in them the
    three least ids stay (one may be the query itself). Similarities are taken once for each two distinct titles. A first look at candidates of
    the same title and about the same runtime gives each key a score that three reach; it then meets only titles and runtimes (by slots, as in
    ranked_candidates) that can reach it. So pairs grow with the distinct runtimes around a key and not with the rows of a block.
    """
    sides = ["title", "runtime", *block]
    q = queries.filter("id IS NOT NULL AND title IS NOT NULL").select(F.col("id").alias("query"), *sides).withColumnsRenamed({"title": "q_title", "runtime": "q_runtime"})
    c = candidates.filter("id IS NOT NULL AND title IS NOT NULL").select(F.col("id").alias("candidate"), *sides).withColumnsRenamed({"title": "c_title", "runtime": "c_runtime"})
    for name in block:
        q, c = q.filter(F.col(name).isNotNull()), c.filter(F.col(name).isNotNull())
    alike = [*block, "c_title", "c_runtime"]
    c = c.withColumn("n", F.dense_rank().over(Window.partitionBy(*alike).orderBy("candidate"))).filter("n <= 3")
    c = c.withColumn("n", F.row_number().over(Window.partitionBy(*alike, "candidate").orderBy("n"))).filter("n <= 2").drop("n")
    own = F.when(F.col("c_runtime") > 0, _slot(F.log(F.col("c_runtime")))).when(F.col("c_runtime") < 0, F.lit(_BELOW).cast("long"))
    shelves = written(c.withColumn("slot", F.explode(F.filter(F.array(own, F.lit(_ANY).cast("long")), lambda x: x.isNotNull()))))
    keys = q.select(*block, "q_title", "q_runtime").distinct()
    keys = written(keys.withColumn("key", F.struct(*block, "q_title", "q_runtime")))

    def meet(probed: DataFrame) -> DataFrame:
        pairs = probed.withColumn("slot", F.explode("slots")).drop("slots").join(shelves.hint("merge"), [*block, "c_title", "slot"])
        score = F.round(0.7 * F.col("similar") + 0.3 * runtime_agreement(F.col("q_runtime"), F.col("c_runtime")), 6)
        scored = pairs.select("key", "candidate", score.alias("score"), *(["least"] if "least" in probed.columns else []))
        return scored.filter(F.col("score") >= (F.greatest(F.col("least"), F.lit(least)) if "least" in probed.columns else F.lit(least)))

    def best_three(scored: DataFrame) -> DataFrame:
        return scored.withColumn("place", F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score"), "candidate"))).filter("place <= 3")

    at = F.log(F.when(F.col("q_runtime") > 0, F.col("q_runtime")))
    around = keys.filter("q_runtime > 0 AND q_title != ''").select("*", F.col("q_title").alias("c_title"), F.lit(1.0).alias("similar"), F.sequence(_slot(at) - 1, _slot(at) + 1).alias("slots"))
    known = best_three(meet(around)).groupBy("key").agg(F.max("place").alias("n"), F.min("score").alias("least")).filter("n = 3").drop("n")
    keys = written(keys.join(known.hint("merge"), "key", "left"))

    left, right = keys.select("q_title").distinct(), c.select("c_title").distinct()
    if least > 0.3 + _ROOM:  # the runtimes alone do not reach it
        left, right = left.withColumn("token", F.explode(_keys(F.col("q_title")))), right.withColumn("token", F.explode(_keys(F.col("c_title"))))
        near = left.join(right.hint("merge"), "token").select("q_title", "c_title").distinct()
    else:
        near = left.crossJoin(right)
    near = near.withColumn("similar", similarity(F.col("q_title"), F.col("c_title")))
    near = written(near.filter(0.7 * F.col("similar") + 0.3 >= least - _ROOM))
    over = F.greatest(F.coalesce("least", F.lit(least)), F.lit(least)) - _ROOM - 0.7 * F.col("similar")
    share = over / 0.3
    wide = F.log(1.0 + F.greatest(0.25 - 0.23 * share, F.lit(0.02))) + 1e-9
    slots = F.when((over <= 0) | ((F.col("q_runtime") < 0) & (share <= 1)), F.array(F.lit(_ANY).cast("long")))
    slots = slots.when(share <= 1, F.concat(F.coalesce(F.sequence(_slot(at - wide), _slot(at + wide)), F.array().cast("array<long>")), F.array(F.lit(_BELOW).cast("long"))))
    probed = keys.join(near, "q_title").withColumn("slots", F.when(F.col("q_runtime").isNotNull() | (over <= 0), slots)).filter("slots IS NOT NULL")
    lists = best_three(meet(probed)).groupBy("key").agg(F.collect_list(F.struct("candidate", "score")).alias("three"))

    q = q.withColumn("key", F.struct(*block, "q_title", "q_runtime")).select("query", "key")
    scored = q.join(lists.hint("merge"), "key").select("query", F.explode("three").alias("x")).select("query", "x.*").filter("query != candidate")
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).filter("place <= 2")
    both = top.groupBy("query").agg(F.max(F.when(F.col("place") == 1, F.struct("candidate", "score"))).alias("one"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    gap = F.round(F.col("one.score") - F.coalesce("second", F.lit(0.0)), 6)
    verdict = F.when((F.col("one.score") >= sure) & (F.col("second").isNull() | (gap > margin)), "matched").otherwise("ambiguous")
    return both.select("query", "one.candidate", "one.score", gap.alias("margin"), verdict.alias("verdict"))
