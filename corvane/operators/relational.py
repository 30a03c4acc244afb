"""Listing diffs, numbering, shared values, ranked search and diverse picks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def having_tags(records: DataFrame, tags: DataFrame, key: str, wanted: Sequence[Column]) -> DataFrame:
    """Records that have every wanted tag: one semi-join each."""
    for condition in wanted:
        records = records.join(tags.filter(condition).select(key), key, "left_semi")
    return records


def facet_counts(records: DataFrame, facet: str, key: str) -> DataFrame:
    return records.groupBy(facet).agg(F.countDistinct(key).alias("n"))


def upsert_diff(listing: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Change set of a listing against stored rows (key, row_hash, file_hash, status).

    New rows start as `new`; a changed file goes back to `new`; a change of the rest moves `classified` back to
    `extracted`; rows that left the listing stay.
    """
    new, old = listing.alias("n"), stored.alias("o")
    joined = new.join(old, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    action = (
        F.when(F.col(f"o.{key}").isNull(), "insert")
        .when(F.col(f"n.{key}").isNull(), "keep")
        .when(F.col("n.row_hash") == F.col("o.row_hash"), "unchanged")
        .otherwise("update")
    )
    status = (
        F.when(action == "insert", "new")
        .when((action == "update") & (F.col("n.file_hash") != F.col("o.file_hash")), "new")
        .when((action == "update") & (F.col("o.status") == "classified"), "extracted")
        .otherwise(F.col("o.status"))
    )
    return joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), action.alias("action"), status.alias("next_status")
    )


def apply_upsert(listing: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The stored rows after a listing: new and changed ones as listed with their next status and no tries, the others as they
    are. stored has the columns of listing, status and attempts."""
    changes = upsert_diff(listing, stored, key)
    touched = changes.filter(F.col("action").isin("insert", "update")).select(key, F.col("next_status").alias("status"))
    fresh = listing.join(touched, key).withColumn("attempts", F.lit(0))
    return stored.join(touched.select(key), key, "left_anti").unionByName(fresh.select(*stored.columns))


def number_repeats(rows: DataFrame, key: Column, order: Sequence[Column], out: str) -> DataFrame:
    """key, then key#2, key#3 ... in the given order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(out, F.when(nth == 1, key).otherwise(F.concat(key, F.lit("#"), nth.cast("string"))))


def relevance(fields: Sequence[tuple[Column, int]], variants: Sequence[str]) -> Column:
    """Sum of the weights of the fields in which any variant occurs, ignoring case; % and _ are literal."""

    def found(field: Column) -> Column:
        hits = [F.contains(F.lower(field), F.lit(v.lower())) for v in variants]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    return sum((F.when(found(f), w).otherwise(0) for f, w in fields), F.lit(0))


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def diverse_picks(rows: DataFrame, record: str, agency: str, order: Sequence[Column], k: int) -> DataFrame:
    """First one per record and agency, then one per record, up to k rows."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(record).orderBy(*order))).filter("_r = 1")
    first = first.withColumn("_a", F.row_number().over(Window.partitionBy(agency).orderBy(*order)))
    return first.orderBy((F.col("_a") != 1).cast("int"), *order).limit(k).drop("_r", "_a")


def ordered_rules(rules: Sequence[tuple[str, str]], text: Column, default: str) -> Column:
    """Value of the first pattern that hits."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


@dataclass(frozen=True)
class LabelRule:
    """A value and its pattern; `meta` is a further pattern for metadata alone; before `since` the body does not count."""

    value: str
    pattern: str
    meta: str | None = None
    since: int | None = None


def multi_label(rules: Sequence[LabelRule], meta: Column, body: Column, year: Column | None = None, base: int = 3, step: int = 20_000) -> Column:
    """Values whose pattern hits meta, or hits body at least max(base, length / step) times where the year allows it."""
    bar = F.greatest(F.lit(base), (F.length(body) / step).cast("int"))

    def applies(rule: LabelRule) -> Column:
        stated = F.coalesce(meta.rlike(rule.pattern), F.lit(False))
        if rule.meta:
            stated = stated | F.coalesce(meta.rlike(rule.meta), F.lit(False))
        told = F.coalesce(F.regexp_count(body, F.lit(rule.pattern)) >= bar, F.lit(False))
        if rule.since is not None and year is not None:
            told = told & F.coalesce(year >= rule.since, F.lit(True))
        return stated | told

    return F.array_compact(F.array(*[F.when(applies(r), F.lit(r.value)) for r in rules]))


def shared_description(meta: Column, description: Column, body: Column, shared: Column) -> tuple[Column, Column]:
    """(meta, body) for rules: a description that a collection shares is body text, any other belongs to the metadata."""
    own = F.coalesce(description, F.lit(""))
    text = F.coalesce(body, F.lit(""))
    return F.when(shared, meta).otherwise(F.concat_ws("\n", meta, own)), F.when(shared, F.concat_ws("\n", own, text)).otherwise(text)


def with_children(records: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """records with one array of structs for each table of children, in the order of their columns; none is an empty array."""
    for name, table in children.items():
        columns = [c for c in table.columns if c != key]
        nested = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        empty = F.array().cast(nested.schema[name].dataType)
        records = records.join(nested, key, "left").withColumn(name, F.coalesce(name, empty))
    return records


def set_algebra(a: Column, b: Column) -> Column:
    """struct(both, only_a, subset, jaccard) of two item arrays."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.struct(
        both.alias("both"), F.size(F.array_except(a, b)).alias("only_a"), (F.size(F.array_except(a, b)) == 0).alias("subset"),
        F.when(either > 0, F.bround(both / either, 6)).otherwise(0.0).alias("jaccard"),
    )
