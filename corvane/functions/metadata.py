"""Column functions that clean published metadata and put it in display form. All native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import first_year, us_date

# Published spellings of one place, by the lower-cased spelling.
PLACE_SPELLINGS = {
    "westen united states": "Western United States",
    "western u.s.": "Western United States",
    "low-earth orbit": "Low Earth Orbit",
    "leo": "Low Earth Orbit",
    "indo-pacom": "INDOPACOM",
    "indopacom aor": "INDOPACOM",
    "centcom aor": "Middle East (CENTCOM)",
    "centcom": "Middle East (CENTCOM)",
    "middle east": "Middle East (CENTCOM)",
    "u.s. central command": "Middle East (CENTCOM)",
    "washington dc": "Washington, D.C.",
    "washington, dc": "Washington, D.C.",
    "washington d.c.": "Washington, D.C.",
}
# A country that goes without saying, and title words that a number may stick to.
HOME = ["US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"]
TITLE_PARTS = ["box", "vol", "volume", "part", "section", "serial"]
# How archive file names begin, numbers of boxes and then a serial.
BOX_NUMBERS, SERIAL = r"^(?:[0-9]{1,9}_\s*)+", r"^[A-Z]{1,3}[0-9]*-[0-9]+_"
# Media codes, kinds dated by their paperwork, kinds that are no accounts.
MEDIA = {"PDF": "pdf", "IMG": "image", "VID": "video", "AUD": "audio"}
DOCUMENT_DATED = ["administrative", "correspondence", "scientific_study"]
RESEARCH_KINDS = ["scientific_study", "administrative"]
# Fixed value: how a date is shown.
SHOWN = "d MMM yyyy"


def squeezed(text: Column) -> Column:
    """Every run of white space a single blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lookup(key: Column, table: Mapping[str, str], default: Column) -> Column:
    """table[key], else default."""
    if not table:
        return default
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.get(F.array(F.try_element_at(pairs, key)), F.lit(0)), default)


def record_id(title: Column, shape: str) -> Column:
    """The title's first comma field, upper-cased, where it has the shape of an id; else the whole title."""
    first = F.trim(F.element_at(F.split(title, ","), 1))
    return F.when(first.rlike(shape), F.upper(first)).otherwise(title)


def paired_ids(lists: Sequence[Column], shape: str) -> Column:
    """Ids of pipe-separated lists, one list after the other: first comma field each, upper-cased where it is an id."""

    def ids(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
        first = F.transform(parts, lambda p: F.trim(F.element_at(F.split(p, ","), 1)))
        return F.transform(first, lambda p: F.when(p.rlike(shape), F.upper(p)).otherwise(p))

    return F.concat(*map(ids, lists))


def media_kind(code: Column, table: Mapping[str, str] = MEDIA) -> Column:
    return lookup(F.upper(code), table, F.lit("other"))


def media_address(kind: Column, link: Column, video: Column, template: str) -> Column:
    """The link; for recordings the address made from the video id (`{id}` in template), null without an id."""
    has_video = F.nullif(video, F.lit("")).isNotNull()
    made = F.when(has_video, F.replace(F.lit(template), F.lit("{id}"), video))
    return F.when(kind.isin("video", "audio"), made).otherwise(F.nullif(link, F.lit("")))


def flagged(text: Column, word: str) -> Column:
    """Whether a cell says `word`, in any case; null says nothing."""
    return F.coalesce(F.upper(F.trim(text)) == word.upper(), F.lit(False))


def clean_title(title: Column) -> Column:
    """Titles that are archive file names made readable; other titles only trimmed.

    Box numbers at the start go, with one serial like `HS1-834228961_` behind them, underscores become blanks, a blank
    parts `Vol1`, and the first letter is a capital. Nothing left: the title as it was.
    """
    whole = F.trim(F.coalesce(title, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(whole, BOX_NUMBERS, ""), SERIAL, "")
    rest = F.regexp_replace(squeezed(F.translate(rest, "_", " ")), r"^[ -]+|[ -]+$", "")
    rest = F.regexp_replace(rest, rf"(?i)\b({'|'.join(TITLE_PARTS)})(\d+)\b", "$1 $2")
    shown = F.concat(F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 2**31 - 1))
    return F.when(whole.rlike(r"^\d+_") & (rest != ""), shown).otherwise(whole)


def normal_place(place: Column, spellings: Mapping[str, str] = PLACE_SPELLINGS) -> Column:
    """One spelling for each place; nothing for empty cells and words that say there is none."""
    text = F.regexp_replace(squeezed(place), r"[,;]+$", "")
    text = F.regexp_replace(text, r"(?<![A-Z])\.$", "")
    last = F.upper(F.replace(F.trim(F.element_at(F.split(text, ","), -1)), F.lit("."), F.lit("")))
    home = F.contains(text, F.lit(",")) & last.isin(*HOME)
    text = F.when(home, F.regexp_replace(text, r",[^,]*$", "")).otherwise(text)
    return F.when(~F.upper(text).isin("", "N/A", "NA", "NONE", "UNKNOWN"), lookup(F.lower(text), spellings, text))


def title_years(title: Column) -> Column:
    """Years from 1800 to 2099 that stand alone in a title, in order."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b((?:18|19|20)\d\d)\b"), 1)
    return F.transform(found, lambda y: y.cast("int"))


def reconciled_year(raw: Column, parsed: Column, title: Column, release_year: Column) -> Column:
    """struct(year, keep_date): a two-digit date that the title contradicts yields to the title's first year; without a
    date the title's year counts, unless it is only the year of publication."""
    years = title_years(title)
    first, some = F.get(years, F.lit(0)), F.size(years) > 0
    contradicted = parsed.isNotNull() & some & ~F.array_contains(years, parsed) & raw.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{2}\s*$")
    undated = F.upper(F.trim(F.coalesce(raw, F.lit("")))).isin("", "N/A")
    paperwork = undated & (first == release_year) & (F.size(F.array_distinct(years)) == 1)
    year = F.when(contradicted, first).when(parsed.isNotNull(), parsed).when(~F.coalesce(paperwork, F.lit(False)), first)
    return F.struct(year.alias("year"), (~F.coalesce(contradicted, F.lit(False))).alias("keep_date"))


def not_after(year: Column, limit: Column) -> Column:
    return F.when(~F.coalesce(year > limit, F.lit(False)), year)


def date_note(title: Column, year: Column) -> Column:
    """A caution where the title names years and the stored one is not among them."""
    years = title_years(title)
    apart = year.isNotNull() & (F.size(years) > 0) & ~F.array_contains(years, year)
    return F.when(apart, F.concat(F.lit("the title says "), F.get(years, F.lit(0)).cast("string")))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with its names sorted and its nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def release_label(number: Column, date: Column) -> Column:
    day = F.date_format(date, SHOWN)
    head = F.when(F.coalesce(number, F.lit(0)) > 0, F.format_string("Release %02d", number)).otherwise("Release")
    return F.concat(head, F.lit(" · "), day)


def label(facet: Column, value: Column, known: Mapping[str, Mapping[str, str]]) -> Column:
    """The label of a facet's value; values a facet does not know are spelled out, free facets keep theirs."""
    spelled = F.lower(F.translate(value, "_", " "))
    spelled = F.concat(F.upper(F.left(spelled, F.lit(1))), F.substring(spelled, 2, 2**31 - 1))
    pairs = {f"{f}\x1f{v}": text for f, values in known.items() for v, text in values.items()}
    other = F.when(facet.isin(*known), spelled).otherwise(value)
    return lookup(F.concat(facet, F.lit("\x1f"), value), pairs, other)


def era(year: Column) -> Column:
    """Decades from the 1940s; everything later belongs to the 2020s."""
    return F.when(year >= 1940, F.concat((F.floor(F.least(year, F.lit(2029)) / 10) * 10).cast("string"), F.lit("s")))


def research_record(kind: Column, title: Column, words: str) -> Column:
    """Research papers and paperwork, by kind or by words of the title."""
    named = F.coalesce(title.rlike(words), F.lit(False))
    return F.coalesce(kind.isin(*RESEARCH_KINDS), F.lit(False)) | named


def shown_date(raw: Column, parsed: Column, year: Column, today_year: int) -> Column:
    """The published date in one unambiguous form: a day, a range of two days, or the publisher's wording without
    the comma between month and year; without a date the year, else a dash."""
    text = squeezed(F.coalesce(raw, F.lit("")))
    ends = F.split(text, r"\s*[-–]\s*")
    day = lambda v: F.date_format(us_date(v, today_year), SHOWN)
    low, high = day(F.get(ends, F.lit(0))), day(F.get(ends, F.lit(1)))
    span = F.when((F.size(ends) == 2) & low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" – "), high))
    wording = F.regexp_replace(text, r"([A-Za-z]),\s*(\d{4})\b", "$1 $2")
    none = F.upper(text).isin("", "N/A")
    return F.coalesce(
        F.date_format(parsed, SHOWN),
        F.when(none, F.coalesce(F.when(year > 0, year.cast("string")), F.lit("—"))),
        span,
        day(text),
        wording,
    )


def date_heading(kind: Column) -> Column:
    return F.when(F.coalesce(kind.isin(*DOCUMENT_DATED), F.lit(False)), "Document date").otherwise("Incident date")


def without_opener(summary: Column, things: Sequence[str] = ("record", "document", "file", "report", "video", "image")) -> Column:
    """`This report is a ...` begins with its article instead."""
    opener = rf"(?i)^\s*This (?:is|(?:{'|'.join(things)}) is) (a|an|the)\s+"
    article = F.regexp_extract(summary, opener, 1)
    rest = F.regexp_replace(summary, opener, "")
    begun = F.concat(F.upper(F.left(article, F.lit(1))), F.substring(article, 2, 9), F.lit(" "), rest)
    return F.when(article != "", begun).otherwise(summary)


def remainder(summary: Column, description: Column) -> Column:
    """What follows in a description that begins with the summary, white space aside; null where nothing does."""
    words = F.split(F.regexp_replace(squeezed(summary), "…+$", ""), " ")
    words = F.filter(words, lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?s)^\s*"), F.array_join(quoted, r"\s+"), F.lit("(.*)$"))
    rest = F.call_function("regexp_extract", description, pattern, F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(rest, r"^\s+|\s+$", ""), r"^[.,;:]+\s*", "")
    return F.when((F.size(words) > 0) & (rest != ""), rest)


def opening(text: Column, limit: int = 600, least: int = 200) -> Column:
    """The first `limit` characters, back to the last full stop when that is far enough, else with an ellipsis."""
    whole = squeezed(text)
    cut = F.left(whole, F.lit(limit))
    end = F.length(cut) - F.instr(F.reverse(cut), " .")
    stop = F.when((F.instr(F.reverse(cut), " .") > 0) & (end > least + 1), F.left(cut, end))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.coalesce(stop, F.concat(F.rtrim(cut), F.lit("…"))))


def first_sentences(text: Column, n: int = 2, limit: int = 360) -> Column:
    """The first n sentences (each begins with a capital, quote or bracket), cut at a blank beyond the limit."""
    whole = squeezed(F.coalesce(text, F.lit("")))
    parts = F.slice(F.split(whole, r"(?<=[.!?])\s+(?=[A-Z“\"(])"), 1, n)
    out = F.trim(F.array_join(parts, " "))
    cut = F.concat(F.regexp_replace(F.left(out, F.lit(limit)), r" [^ ]*$", ""), F.lit("…"))
    return F.when(F.length(out) > limit, cut).otherwise(out)


def meta_text(text: Column, width: int = 200) -> Column:
    """Text on one line, cut at a whole word, without punctuation before the ellipsis; null for none."""
    whole = squeezed(text)
    cut = F.regexp_replace(F.regexp_replace(F.left(whole, F.lit(width)), r" [^ ]*$", ""), r"[.,;:]+$", "")
    return F.when(text != "", F.when(F.length(whole) <= width, whole).otherwise(F.concat(cut, F.lit("…"))))


def safe_name(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit(150))


def file_path(source: Column, name: Column, address: Column) -> Column:
    """source/name.suffix, the suffix taken from the address (.bin without one)."""
    last = F.element_at(F.split(F.coalesce(address, F.lit("")), "/"), -1)
    suffix = F.lower(F.regexp_extract(last, r"[^.](\.[^./]+)$", 1))
    return F.concat(source, F.lit("/"), safe_name(name), F.when(suffix != "", suffix).otherwise(".bin"))


def digest(content: Column) -> Column:
    """struct(sha256, size) of a file's bytes."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.length(content).cast("long").alias("size"))


def listing_year(raw: Column, title: Column, release: Column, today_year: int) -> Column:
    """struct(date, year) of a listing row: parsed, reconciled with the title, and not after the release."""
    date = us_date(raw, today_year)
    found = reconciled_year(raw, F.coalesce(F.year(date), first_year(raw)), title, F.year(release))
    return F.struct(F.when(found["keep_date"], date).alias("date"), not_after(found["year"], F.year(release)).alias("year"))


def series_key(record: Column, description: Column, shared: Column, shape: str) -> Column:
    """Records of one published series: those of a shared description, those whose id has a common head, else itself."""
    head = F.regexp_extract(record, shape, 1)
    return (
        F.when(F.coalesce(shared & (description != ""), F.lit(False)), F.concat(F.lit("desc:"), F.xxhash64(description).cast("string")))
        .when(head != "", F.concat(F.lit("head:"), head))
        .otherwise(F.concat(F.lit("rec:"), record))
    )


def first_rule(rules: Sequence[tuple[str, str]], *texts: Column, default: str | None = None) -> Column:
    """Value of the first rule (pattern, value) that hits, tried on one text after the other."""
    found = []
    for text in texts:
        chain = reduce(lambda out, r: F.when(text.rlike(r[0]), r[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))
        found.append(chain)
    return F.coalesce(*found, F.lit(default).cast("string"))


def stated_assessment(title: Column, assessment: Column, word: str = "unresolved", none: str = "not_assessed") -> Column:
    """The assessment; where there is none, a title that says `word` settles it."""
    own = F.coalesce(assessment, F.lit(none))
    return F.when((own == none) & F.coalesce(title.rlike(rf"(?i)\b{word}\b"), F.lit(False)), word).otherwise(own)
