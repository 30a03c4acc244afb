"""Search and browsing: visible records, tag parameters, spellings of a query, named sort orders, pages with totals,
related records, unit filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.metadata import RESEARCH_KINDS
from corvane.operators.relational import having_tags

# States of a record that is shown, and of one that is shown once it has been classified before.
SHOWN, SHOWN_AGAIN = ["classified"], ["extracted", "downloaded"]
# What a hit in a field says about the record.
FIELD_WEIGHTS = {"title": 10, "record_id": 8, "summary": 5, "description": 4, "incident_location": 3, "text": 1}
# Numbers that stand for none in the orders, rows of a page.
NO_YEAR_FIRST, NO_YEAR_LAST, PAGE = 0, 9999, 30


def visible(status: Column, classifier: Column) -> Column:
    return status.isin(*SHOWN) | (status.isin(*SHOWN_AGAIN) & classifier.isNotNull())


def not_research(kind: Column, title: Column, words: Sequence[str] = ()) -> Column:
    """Kinds that are no papers (or none yet), titles without the words."""
    out = kind.isNull() | ~kind.isin(*RESEARCH_KINDS)
    return reduce(lambda c, w: c & ~F.coalesce(F.contains(F.lower(title), F.lit(w.lower())), F.lit(False)), words, out)


def tag_params(params: Sequence[str], facets: Sequence[str]) -> list[tuple[str, str]]:
    """(facet, value) of each `facet:value` whose facet is known."""
    pairs = [p.partition(":") for p in params]
    return [(f, v) for f, colon, v in pairs if colon and v and f in facets]


def tag_param_column(param: Column, facets: Sequence[str]) -> Column:
    """The same for a column of parameters: struct(facet, value), null for unknown facets."""
    parts = F.split(param, ":", 2)
    facet, value = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(facet.isin(*facets) & (value != ""), F.struct(facet.alias("facet"), value.alias("value")))


def spellings(query: str | None, compounds: Mapping[str, str]) -> list[str]:
    """A query as typed, then its known compound, spaced, joined and hyphenated; no form twice in any case."""
    typed = " ".join((query or "").split())
    known = compounds.get(typed.lower(), typed)
    parts = re.split(r"[\s-]+", known)
    found: dict[str, str] = {}
    for form in filter(None, [typed, known, " ".join(parts), "".join(parts), "-".join(parts)]):
        found.setdefault(form.lower(), form)
    return list(found.values())


def spellings_column(query: Column, compounds: Mapping[str, str]) -> Column:
    """`spellings` for a column of queries."""
    typed = F.trim(F.regexp_replace(query, r"\s+", " "))
    pairs = [F.lit(x) for pair in compounds.items() for x in pair]
    known = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(typed)), typed) if pairs else typed
    forms = F.array(typed, known, *[F.regexp_replace(known, r"[\s-]+", glue) for glue in (" ", "", "-")])
    fresh = F.filter(forms, lambda f, i: (f != "") & ~F.exists(F.slice(forms, 1, i), lambda g: F.lower(g) == F.lower(f)))
    return F.when(typed != "", fresh).otherwise(F.array().cast("array<string>"))


def literal_hit(field: Column, words: Sequence[str]) -> Column:
    """Whether a field has any of the words in it, in any case; % and _ are plain characters."""
    low = F.lower(F.coalesce(field, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])


def pattern_hit(field: Column, words: Sequence[str]) -> Column:
    """The same with % and _ as wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.ilike(field, F.lit(f"%{w}%")), F.lit(False)) for w in words])


def sort_order(name: str, c: Mapping[str, str], rank: Column | None = None) -> list[Column]:
    """Columns of a named order. c gives the names of release, record, featured, year, significance, pages and id; an
    unknown name, and relevance without a rank, is the order by release."""
    of = lambda k, none: F.coalesce(F.col(c[k]), F.lit(none))
    release = [F.desc(c["release"]), F.desc(c["featured"]), F.col(c["record"])]
    named = {
        "relevance": [rank.desc(), F.desc(c["release"]), F.col(c["record"])] if rank is not None else [F.desc(c["release"]), F.col(c["record"])],
        "incident": [of("year", NO_YEAR_FIRST).desc(), F.col(c["record"])],
        "oldest": [of("year", NO_YEAR_LAST).asc(), F.col(c["record"])],
        "significance": [of("significance", 0).desc(), F.desc(c["featured"]), F.col(c["id"])],
        "pages": [of("pages", 0).desc(), F.col(c["id"])],
    }
    return named.get(name, release)


def search(records: DataFrame, fields: Mapping[str, int], words: Sequence[str], tags: DataFrame | None = None,
           wanted: Sequence[tuple[str, str]] = (), key: str = "id", wildcards: bool = False) -> DataFrame:
    """Records that hold any word in any field and have every wanted (facet, value), with their rank: the weight of each
    field with a hit, once. Without words every record is found, with rank 0."""
    rank = F.lit(0)
    if words:
        hit = pattern_hit if wildcards else literal_hit
        rank = sum((F.when(hit(F.col(f), words), w).otherwise(0) for f, w in fields.items()), rank)
    found = records.withColumn("rank", rank)
    if words:
        found = found.filter("rank > 0")
    if tags is not None and wanted:
        found = having_tags(found, tags, key, [(F.col("facet") == f) & (F.col("value") == v) for f, v in wanted])
    return found


def paged(rows: DataFrame, order: Sequence[Column], number: int, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """One page in order, and one row (total, pages); there is at least one page."""
    total = rows.agg(F.count("*").alias("total"))
    counts = total.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), counts


def related(records: DataFrame, source: str, record: str, ids: str) -> DataFrame:
    """(source, a, b) for each id a record names that the same source has."""
    named = records.select(source, F.col(record).alias("a"), F.explode(F.array_distinct(ids)).alias("b"))
    known = records.select(source, F.col(record).alias("b"))
    return named.join(known, [source, "b"], "left_semi").select(source, "a", "b")


def unrelated(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b, ...) without those that edges (a, b) join in either direction."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def looked_up(rows: DataFrame, ids: str, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the table's columns for each element of an id list, in the list's order, one row an element."""
    each = rows.select("*", F.posexplode(ids).alias("place", key))
    return each.join(table.select(key, *columns), key, "left")


def in_range(units: DataFrame, page: str, low: int, high: int) -> DataFrame:
    return units.filter(F.col(page).between(low, high))


def of_year(date: Column, year: int) -> Column:
    return F.year(date) == year


def outdated(stored: Mapping[str, str], current: Mapping[str, str]) -> bool:
    """Whether any version key of stored results differs from the current one or is missing."""
    return any(stored.get(k) != v for k, v in current.items())


def stale(classifier: Column, version: Column, failed_model: Column, model: str | None, rules_version: int) -> Column:
    """Records to classify again: with a model, all that neither it nor a failed try of it has seen; without one,
    those that older rules classified."""
    if model is None:
        return (classifier == "rules") & (F.coalesce(version, F.lit(0)) < rules_version)
    return ~F.coalesce(classifier == model, F.lit(False)) & ~F.coalesce(failed_model == model, F.lit(False))
