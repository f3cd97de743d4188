"""Scalar functions on titles, sizes and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what they fold to, one for one.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
# Articles that a title may begin or end with.
ARTICLES = ("the", "a", "an", "der", "die", "das", "le", "la", "les", "el", "los", "las", "il", "lo")


def normalize_title(c: Column) -> Column:
    """Lower case without accents, '&' as 'and', anything but letters and digits as one space, without one article at either end.

    What the queries' SQL can say; title_key is F1 in full.
    """
    c = F.translate(F.lower(c), ACCENTED, FOLDED)
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "&", " and "), "[^a-z0-9]+", " "))
    c = F.regexp_replace(c, f"^({'|'.join(ARTICLES)}) ", "")
    return F.regexp_replace(c, f" ({'|'.join(ARTICLES)})$", "")


# Fixed values of F1: letters that fold to one letter, those that fold to two, articles, and Roman numerals up to 20 (not I).
_FOLDS = {
    "a": "àáâãäåāăą", "c": "çćčĉċ", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľł", "n": "ñńņň",
    "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śşšŝ", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_LONG_FOLDS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "&": " and "}
_ALL_ARTICLES = "the a an le la les l un une des der die das ein eine el los las una il lo gli uno o os as um uma de het een".split()
_ROMAN = {r: str(n) for n, r in enumerate("ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 2)}


def title_key(c: Column) -> Column:
    """initialisms joined (S.W.A.T. as SWAT), lower case without accents, '&' as 'and', anything but letters and digits as one space, Roman
    numerals as digits, without one article at either end (the last word stays).

    An initialism is two or more single letters, each with a dot, that begin where no letter or digit goes before.
    """
    c = F.translate(c, "\u0000\u0001", "  ")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{Nl}\p{No}\p{Nd}])((?:\p{L}\.){2,})", "\u0000$1\u0001")
    # between the two marks dots go
    c = F.array_join(F.transform(F.split(c, "\u0000"), lambda x: F.concat(F.replace(F.substring_index(F.concat(F.when(x.contains("\u0001"), x).otherwise(F.lit("\u0001"))), "\u0001", 1), F.lit("."), F.lit("")), F.when(x.contains("\u0001"), F.substring_index(x, "\u0001", -1)).otherwise(x))), "")
    c = F.lower(F.translate(c, "İ", "I"))  # as its first lower-case letter, without the dot above
    c = F.translate(c, "".join(_FOLDS.values()), "".join(k * len(v) for k, v in _FOLDS.items()))
    for one, more in _LONG_FOLDS.items():
        c = F.replace(c, F.lit(one), F.lit(more))
    words = F.split(F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")), " ")
    roman = F.create_map(*(F.lit(x) for pair in _ROMAN.items() for x in pair))
    words = F.transform(words, lambda w: F.coalesce(F.try_element_at(roman, w), w))
    articles = F.array(*(F.lit(x) for x in _ALL_ARTICLES))
    words = F.when((F.size(words) > 1) & F.array_contains(articles, F.element_at(words, 1)), F.slice(words, 2, F.size(words))).otherwise(words)
    words = F.when((F.size(words) > 1) & F.array_contains(articles, F.element_at(words, -1)), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    return F.array_join(words, " ")


def token_f1(a: Column, b: Column) -> Column:
    """Share of common distinct tokens of two normalized titles, 0 to 1."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def similarity(a: Column, b: Column) -> Column:
    """The better of token overlap and edit distance; a distance beyond two fifths of the longer title counts as none."""
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    near = F.when(distance <= F.floor(longest * 2 / 5), 1.0 - distance / F.nullif(longest, F.lit(0))).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(token_f1(a, b), near))


def title_similarity(a: Column, b: Column) -> Column:
    """as similarity, but a repeated word counts as often as both titles have it, and two empty titles are equal."""
    def numbered(c: Column) -> Column:
        words = F.split(c, " ")
        return F.transform(words, lambda x, i: F.concat_ws(" ", x, F.size(F.filter(F.slice(words, 1, i + 1), lambda y: y == x)).cast("string")))

    x, y = numbered(a), numbered(b)
    longest = F.greatest(F.length(a), F.length(b))
    budget = F.floor(longest * 2 / 5)
    distance = F.levenshtein(a, b)
    near = F.when(distance <= budget, 1.0 - distance / F.nullif(longest, F.lit(0))).otherwise(0.0)
    words = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(words, near))


def runtime_agreement(a: Column, b: Column) -> Column:
    """1 within 2 %, falling to 0 at 25 % of the smaller; 0 if either is 0."""
    off = F.abs(a - b) / F.nullif(F.least(a, b).cast("double"), F.lit(0.0))
    return F.coalesce(F.when(off <= 0.02, 1.0).when(off >= 0.25, 0.0).otherwise((0.25 - off) / 0.23), F.lit(0.0))


def year_agreement(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.7).when(gap == 2, 0.3).when(gap.isNotNull(), 0.0)


def weighted_rating(rating: Column, votes: Column) -> Column:
    """A rating drawn towards 5 as if by ten more votes; a missing one counts as 5."""
    return (F.coalesce(rating, F.lit(5.0)) * votes + 50.0) / (votes + 10)


def human_size(size: Column) -> Column:
    """Bytes in whole or tenths of the largest binary unit below."""
    def unit(power: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.round(size / float(1 << (10 * power)), 1)), F.lit(f" {name}"))

    return F.when(size >= 1 << 30, unit(3, "GiB")).when(size >= 1 << 20, unit(2, "MiB")).when(size >= 1 << 10, unit(1, "KiB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def human_duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss; a dash for none, nothing finite, or no time."""
    total = F.floor(seconds)
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when((seconds > 0) & ~F.isnan(seconds) & (seconds != float("inf")), text).otherwise("—")


def ellipsize(c: Column, width: int) -> Column:
    """at most so many characters, the last one an ellipsis if any are cut."""
    return F.when(F.char_length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, max(width - 1, 0)), F.lit("…")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
