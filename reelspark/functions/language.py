"""Language tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter codes and the two-letter codes of the same languages.
THREE_TO_TWO = {
    "eng": "en", "jpn": "ja", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "zho": "zh", "chi": "zh",
    "kor": "ko", "nld": "nl", "dut": "nl", "swe": "sv", "nor": "no", "dan": "da", "fin": "fi", "pol": "pl", "tur": "tr", "ara": "ar", "heb": "he", "hin": "hi",
    "tha": "th", "vie": "vi", "ind": "id", "ces": "cs", "cze": "cs", "ell": "el", "gre": "el", "hun": "hu", "ron": "ro", "rum": "ro", "ukr": "uk", "cat": "ca",
    "isl": "is", "ice": "is",
}
# Tags that name no language.
UNDETERMINED = ("", "und", "mis", "zxx", "mul")


def tag(c: Column) -> Column:
    """lower case, '-' between parts, two-letter codes; 'und' for null and what names no language."""
    low = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    codes = F.create_map(*(F.lit(x) for pair in THREE_TO_TWO.items() for x in pair))
    first = F.substring_index(low, "-", 1)
    rest = F.when(low.contains("-"), F.substring(low, F.length(first) + 2, F.length(low))).otherwise("")
    two = F.coalesce(F.try_element_at(codes, first), first)
    return F.when(low.isin(*UNDETERMINED), "und").when(rest != "", F.concat(two, F.lit("-"), rest)).otherwise(two)


def base(tagged: Column) -> Column:
    return F.substring_index(tagged, "-", 1)


def step(tagged: Column, wanted: list[str], original: str | None = None) -> Column:
    """How far down a chain of normalised wanted tags a normalised tag stands: exact before dialect at each, then the original language, then any, then none."""
    out = None
    for k, w in enumerate(wanted):
        exact = (tagged == w) & (tagged != "und")
        same = (tagged != "und") & (base(tagged) == w.split("-")[0]) & F.lit(w != "und")
        out = (F.when(exact, 2 * k) if out is None else out.when(exact, 2 * k)).when(same, 2 * k + 1)
    n = 2 * len(wanted)
    known = (tagged != "und") & (base(tagged) == F.lit((original or "und").split("-")[0])) & F.lit((original or "und") != "und")
    out = F.when(known, n) if out is None else out.when(known, n)
    return out.when(tagged != "und", n + 1).otherwise(n + 2)


def match_name(chosen: Column, wanted: int) -> Column:
    """What the step of the chosen tag means."""
    return F.when(chosen >= 2 * wanted + 1, "last_resort").when(chosen == 2 * wanted, "original").when(chosen == 0, "exact").when(chosen == 1, "dialect").otherwise("fallback")
