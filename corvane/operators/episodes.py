"""Episodes: the events a record tells of, with class, details, pages, year and outcome. All native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that decide the class of an episode, in order of precedence.
CLASS_TAGS = [
    ("space", ["astronaut", "orbit"]),
    ("traces", ["crash", "debris", "traces"]),
    ("encounter", ["em_effects", "instruments", "physiological", "heat", "animals", "landed", "descend", "pacing",
                   "occupants", "close_range"]),
]
# Media whose description alone makes a sensor episode, unless one of these tags names a witness.
SENSOR_MEDIA = ["video", "image", "audio"]
WITNESS_TAGS = ["pilot", "many_witnesses", "driving"]
# Kinds that tell of no event, and the detail such a record has.
PAPER_KINDS = ["administrative", "correspondence"]
KIND_DETAILS = {"scientific_study": "study", "analysis": "study", "administrative": "policy", "correspondence": "inquiry"}
# Lengths in characters and the first valid year.
MAX_PLACE, MAX_EXPLANATION, FIRST_YEAR = 120, 80, 1800


def _has_any(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def episode_class(tags: Column, media: Column, page: Column, table=CLASS_TAGS, sensor=SENSOR_MEDIA, witness=WITNESS_TAGS) -> Column:
    """First class whose tags occur; else `sensor` for a described recording without a witness; else `sighting`."""
    out = F.when(media.isin(*sensor) & (page == 0) & ~_has_any(tags, witness), "sensor").otherwise("sighting")
    for name, wanted in reversed(table):
        out = F.when(_has_any(tags, wanted), name).otherwise(out)
    return out


def rule_episodes(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """record, seq, page, class, details: one for each account with tags; a record without any gets one for its description.

    records: (record, media, kind, research, text, description_tags); accounts: (record, page, tags). Research and paperwork is
    `none` with the detail of its kind, as is a record whose text could not be read (page null) or whose description has
    no tags; a described recording is then `sensor`.
    """
    tagged = accounts.filter(F.size("tags") > 0)
    told = tagged.join(records.select("record", "media"), "record").select(
        "record", F.col("page").cast("int").alias("page"), F.col("tags").alias("details"), episode_class(F.col("tags"), F.col("media"), F.col("page")).alias("class")
    )
    rest = records.join(tagged.select("record").distinct(), "record", "left_anti")
    paper = F.coalesce(F.col("research"), F.lit(False)) | F.coalesce(F.col("kind").isin(*PAPER_KINDS), F.lit(False))
    readable = F.coalesce(F.col("text"), F.lit("")) != ""
    tags = F.coalesce("description_tags", F.array().cast("array<string>"))
    untagged = F.when(F.col("media").isin(*SENSOR_MEDIA), "sensor").otherwise("none")
    described = F.when(F.size(tags) > 0, episode_class(tags, F.col("media"), F.lit(0))).otherwise(untagged)
    details = F.create_map(*[F.lit(x) for pair in KIND_DETAILS.items() for x in pair])
    by_kind = F.array_compact(F.array(F.try_element_at(details, F.coalesce("kind", F.lit("")))))
    single = rest.select(
        "record",
        F.when(paper | readable, F.lit(0)).alias("page"),
        F.when(paper, by_kind).when(readable, tags).otherwise(F.array().cast("array<string>")).alias("details"),
        F.when(paper | ~readable, "none").otherwise(described).alias("class"),
    )
    rows = told.unionByName(single)
    seq = F.row_number().over(Window.partitionBy("record").orderBy("page", F.sort_array("details"))) - 1
    return rows.select("record", seq.alias("seq"), "page", "class", "details")


def validated(raw: DataFrame, classes: Sequence[str], details: Sequence[str], outcomes: Sequence[str], as_of_year: int,
              max_summary: int = 600) -> DataFrame:
    """Episodes with a known class and a summary, coerced field by field.

    raw: event, summary, pages array<string>, details array<string>, year string, place, outcome, explanation and any
    other columns; valid_pages array<int> (null: all). Unknown details and pages go, an unknown outcome is not_stated, a year
    outside 1800 to next year is null, long texts are cut (the summary at a blank, with an ellipsis).
    """
    summary = F.trim(F.regexp_replace(F.col("summary"), r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.left(summary, F.lit(max_summary)), r" [^ ]*$", ""), F.lit("…"))
    pages = F.array_compact(F.transform("pages", lambda p: F.trim(p).try_cast("int")))
    allowed = F.filter(pages, lambda p: (p >= 0) & (F.col("valid_pages").isNull() | F.array_contains("valid_pages", p)))
    year = F.trim("year").try_cast("int")
    short = lambda c, n: F.nullif(F.left(F.trim(c), F.lit(n)), F.lit(""))
    return raw.filter(F.trim("event").isin(*classes) & (summary != "")).withColumns({
        "event": F.trim("event"),
        "summary": F.when(F.length(summary) > max_summary, cut).otherwise(summary),
        "pages": F.coalesce(F.sort_array(F.array_distinct(allowed)), F.array().cast("array<int>")),
        "details": F.coalesce(F.array_distinct(F.filter(F.transform("details", lambda d: F.trim(d)), lambda d: d.isin(*details))),
                              F.array().cast("array<string>")),
        "year": F.when(year.between(FIRST_YEAR, as_of_year + 1), year),
        "place": short("place", MAX_PLACE),
        "outcome": F.when(F.col("outcome").isin(*outcomes), F.col("outcome")).otherwise("not_stated"),
        "explanation": short("explanation", MAX_EXPLANATION),
    })


def problems(raw: DataFrame, known: DataFrame, classes: Sequence[str]) -> DataFrame:
    """record, problem: records that are not in the input, unknown classes and empty summaries."""
    strange = raw.join(known.select("record"), "record", "left_anti").select("record", F.lit("unknown record").alias("problem"))
    bad = raw.filter(~F.coalesce(F.trim("event").isin(*classes), F.lit(False)))
    blank = raw.filter(F.trim(F.coalesce("summary", F.lit(""))) == "")
    missing = known.select("record").join(raw.select("record"), "record", "left_anti")
    return (
        strange.unionByName(bad.select("record", F.concat(F.lit("unknown class "), F.coalesce("event", F.lit("null"))).alias("problem")))
        .unionByName(blank.select("record", F.lit("empty summary").alias("problem")))
        .unionByName(missing.select("record", F.lit("not read").alias("problem")))
    )


def merged_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys of both; where both have one, the new rows."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
