"""Column functions that measure and clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """No NUL or carriage return, single blanks, trimmed lines, at most one empty line in a row, none at the ends."""
    t = F.regexp_replace(text, r"[\x00\r]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def meaningful_chars(text: Column) -> Column:
    """Letters and digits of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


# Punctuation that may stand at the edges of a plain word.
_EDGE = r"[.,;:()\[\]\"'!?-]*"


def tokens(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def text_quality(text: Column) -> Column:
    """Share of tokens that are two or more ASCII letters between edge punctuation."""
    good = F.regexp_count(text, F.lit(rf"(?U)(?<!\S){_EDGE}[A-Za-z]{{2,}}{_EDGE}(?!\S)"))
    return F.when(tokens(text) > 0, good / tokens(text)).otherwise(F.lit(0.0))


def layer_score(text: Column) -> Column:
    """How much readable text a layer holds: letters and digits weighted by quality."""
    return meaningful_chars(text) * (F.lit(0.25) + text_quality(text))


def better_layer(layer: Column, scanned: Column, gain: float = 1.05) -> Column:
    """The scanned text where it scores clearly higher than the embedded layer, else the layer."""
    return F.when(F.coalesce(layer_score(scanned) > gain * layer_score(layer), layer.isNull()), scanned).otherwise(layer)


def needs_scan(text: Column, image_share: Column, least: int = 80, wide: float = 0.6, thin: int = 400) -> Column:
    """Whether a page must be read as an image: hardly any text, or a thin layer over a large image."""
    n = meaningful_chars(F.coalesce(text, F.lit("")))
    return (n < least) | (F.coalesce(image_share > wide, F.lit(False)) & (n < thin))


def us_date(value: Column, today_year: int) -> Column:
    """m/d/yy or m/d/yyyy; two digits mean this century only up to this year; impossible days are null."""
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    month, day, year = (F.regexp_extract(value, pattern, k) for k in (1, 2, 3))
    number = year.try_cast("int")
    full = F.when(number >= 100, number).otherwise(number + F.when(number <= today_year % 100, 2000).otherwise(1900))
    text = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(value.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd"))


def first_year(*values: Column) -> Column:
    """The first year from 1800 to 2099 in the first value that has one."""
    return F.coalesce(*[F.regexp_extract(v, r"\b((?:18|19|20)[0-9]{2})\b", 1).try_cast("int") for v in values])


def first_year_in_text(text: Column) -> Column:
    """The first four digits from 1800 to 2099 that no other digit (0 to 9) touches; letters may, as running text has them."""
    return F.regexp_extract(text, r"(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")


def snippet(text: Column, term: str, before: int = 30, width: int = 80) -> Column:
    """A window around the first hit of term, ignoring case; null without one."""
    at = F.instr(F.lower(text), term.lower())
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(width)))


def highlight(text: Column, variants: list[str], width: int = 220) -> Column:
    """A window around the earliest hit of any variant, marked, with ellipses where it is cut; without a hit the start."""
    low = F.lower(text)
    places = [F.struct(F.nullif(F.instr(low, v.lower()), F.lit(0)).alias("at"), F.lit(len(v)).alias("n")) for v in variants]
    hits = F.filter(F.array(*places), lambda p: p["at"].isNotNull()) if places else F.array()
    best = F.array_min(hits) if places else F.lit(None)
    head = F.concat(F.left(text, F.lit(width)), F.when(F.length(text) > width, "…").otherwise(""))
    if not places:
        return F.coalesce(head, F.lit(""))
    start = F.greatest(best["at"] - 1 - width // 2, F.lit(0))
    j = best["at"] - 1 - start
    cut = F.substring(text, start + 1, F.lit(width))
    marked = F.concat(
        F.when(start > 0, "…").otherwise(""), F.left(cut, j), F.lit("<mark>"), F.substring(cut, j + 1, best["n"]), F.lit("</mark>"),
        F.substring(cut, j + best["n"] + 1, F.lit(width)), F.when(start + width < F.length(text), "…").otherwise(""),
    )
    return F.coalesce(F.when(F.size(hits) > 0, marked).otherwise(head), F.lit(""))


def text_hash(units: Column, version: str = "", length: int = 16) -> Column:
    """Hex key of a sequence of texts: the same texts in the same order under the same version have the same key."""
    framed = F.transform(units, lambda u: F.concat(F.length(u).cast("string"), F.lit(":"), u))
    return F.left(F.sha2(F.concat(F.lit(version + "|"), F.array_join(framed, "|")), 256), F.lit(length))


def decade(year: Column) -> Column:
    return F.when(year >= 1940, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))
