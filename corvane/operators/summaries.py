"""Summaries of records and accounts: details, timelines, waves, places, outcomes, redaction, encounters, hierarchy.

Inputs are long tables; every function names the columns it reads. Lists in results are rows, ranked by count and then by
name, so ties have one order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import decade
from corvane.storage import dealt, written

# Least members of a compared group and its least records, rows a split needs, rows it shows.
MIN_GROUP, MIN_RECORDS, SPLIT_LEAST, SPLIT_ROWS = 8, 3, 3, 12
# Fixed value: marks on a page that make a record heavily redacted.
HEAVY = 2.0
# Ids of the lists of episodes that weigh as much as a row.
LIST = 20
GROUPS = ["unresolved", "explained", "not_assessed"]


def most_common(rows: DataFrame, group: Sequence[str], item: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent items of each group with their count and rank."""
    counts = rows.filter(F.col(item).isNotNull()).groupBy(*group, item).agg(F.count("*").alias(n))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(n), item))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def low_median(x: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def high_median(x: str) -> Column:
    return F.expr(f"element_at(sort_array(collect_list({x})), cast(count({x}) div 2 as int) + 1)")


def detail_summary(hits: DataFrame, record: str, page: str, detail: str, year: str) -> DataFrame:
    """detail, pages, records, first_year, last_year and decades (a map of hits with a year)."""
    per_decade = hits.withColumn("_d", decade(F.col(year))).filter("_d is not null").groupBy(detail, "_d").agg(F.count("*").alias("_n"))
    maps = per_decade.groupBy(detail).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_d", "_n")))).alias("decades"))
    out = hits.groupBy(detail).agg(
        F.countDistinct(record, page).alias("pages"), F.countDistinct(record).alias("records"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )
    return out.join(maps, detail, "left")


def best_examples(hits: DataFrame, record: str, page: str, detail: str, quality: Column) -> DataFrame:
    """One hit per detail and record, the most readable, with its place: records of most hits first."""
    per = Window.partitionBy(detail, record)
    best = hits.withColumn("_n", F.count("*").over(per)).withColumn("_q", quality)
    best = best.withColumn("_r", F.row_number().over(per.orderBy(F.desc("_q"), page))).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy(detail).orderBy(F.desc("_n"), record))
    return best.withColumn("place", place).drop("_n", "_q", "_r")


def timeline(mentions: DataFrame, unit: Sequence[str], date: str, precision: str) -> DataFrame:
    """(year, month, weight): a unit with days or months spreads one over its different months, a unit with only years over
    its different years (month null)."""
    fine = F.col(precision) != "year"
    rows = mentions.select(*unit, F.year(date).alias("year"), F.when(fine, F.month(date)).alias("month")).distinct()
    has_month = F.max(F.col("month").isNotNull()).over(Window.partitionBy(*unit))
    rows = rows.withColumn("_m", has_month).filter(F.col("month").isNotNull() | ~F.col("_m"))
    share = F.lit(1.0) / F.count("*").over(Window.partitionBy(*unit))
    return rows.withColumn("weight", share).groupBy("year", "month").agg(F.sum("weight").alias("weight"))


def units_in_waves(waves: DataFrame, units: DataFrame, year: str, unit: Sequence[str]) -> DataFrame:
    """(first, unit) for each wave (first, last) in which a unit names a year. A wave is a few years, which become rows,
    so the join is by year."""
    years = waves.select("first", F.explode(F.sequence("first", "last")).alias(year))
    return units.join(F.broadcast(years), year).select("first", *unit).distinct()


def wave_details(inside: DataFrame, details: DataFrame, unit: Sequence[str], detail: str, least: int = 3, lift: float = 1.3, k: int = 6) -> DataFrame:
    """(first, detail, n, lift, common, distinctive): ranks among a wave's details by count and by lift, up to k.

    Lift is the share of the wave's units (dated ones) over the share of all units that have any detail.
    """
    sizes = inside.groupBy("first").agg(F.count("*").alias("_w"))
    pairs = details.select(*unit, detail).distinct()
    overall = pairs.groupBy(detail).agg(F.count("*").alias("_o"))
    total = pairs.select(*unit).distinct().agg(F.count("*").alias("_all"))
    rows = inside.join(pairs, list(unit)).groupBy("first", detail).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = rows.join(overall, detail).join(F.broadcast(sizes), "first").join(F.broadcast(total))
    rows = rows.withColumn("_l", F.col("n") * F.col("_all") / (F.col("_w") * F.col("_o")))
    w = Window.partitionBy("first")
    common = F.row_number().over(w.orderBy(F.desc("n"), detail))
    typical = F.col("_l") >= lift
    rare = F.when(typical, F.row_number().over(w.orderBy(F.desc(typical), F.desc("_l"), detail)))
    ranked = rows.withColumns({"common": common, "distinctive": rare}).filter((F.col("common") <= k) | (F.col("distinctive") <= k))
    cut = lambda c: F.when(F.col(c) <= k, F.col(c)).alias(c)
    return ranked.select("first", detail, "n", F.bround("_l", 2).alias("lift"), cut("common"), cut("distinctive"))


def wave_months(waves: DataFrame, months: DataFrame) -> DataFrame:
    """(first, month, weight, peak): weights of the twelve months over a wave's years, zero-filled, and its first heaviest one."""
    years = waves.select("first", F.explode(F.sequence("first", "last")).alias("year"))
    found = months.filter("month is not null").join(F.broadcast(years), "year").groupBy("first", "month").agg(F.sum("weight").alias("_w"))
    grid = waves.select("first", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    rows = grid.join(found, ["first", "month"], "left").withColumn("weight", F.bround(F.coalesce("_w", F.lit(0.0)), 2))
    w = Window.partitionBy("first")
    peak = F.when(F.max("weight").over(w) > 0, F.min_by("month", F.struct(-F.col("weight"), F.col("month"))).over(w))
    return rows.select("first", "month", "weight", peak.alias("peak"))


def place_summary(mentions: DataFrame, place: str, year: str, top: int = 12) -> DataFrame:
    """(place, n, rank, decade, in_decade) of the most named places, zero-filled over the decades of any of them."""
    named = most_common(mentions, [], place, top)
    rows = mentions.join(F.broadcast(named.select(place)), place).withColumn("decade", decade(F.col(year))).filter("decade is not null")
    cells = rows.groupBy(place, "decade").agg(F.count("*").alias("_c"))
    grid = named.join(cells.select("decade").distinct())
    return grid.join(cells, [place, "decade"], "left").select(place, "n", "rank", "decade", F.coalesce("_c", F.lit(0)).alias("in_decade"))


def split_by(members: DataFrame, category: Sequence[str], group: str, groups: Sequence[str], least: int = 1, top: int | None = None) -> DataFrame:
    """Counts, shares and totals of the groups by category; rows below `least` go, the largest `top` stay."""
    counts = [F.count_if(F.col(group) == g).alias(f"n_{g}") for g in groups]
    rows = members.filter(F.col(category[-1]).isNotNull()).groupBy(*category).agg(F.count("*").alias("total"), *counts)
    rows = rows.filter(F.col("total") >= least)
    for g in groups:
        rows = rows.withColumn(f"share_{g}", F.bround(F.col(f"n_{g}") / F.col("total"), 3))
    if top is None:
        return rows
    w = Window.partitionBy(*category[:-1]).orderBy(F.desc("total"), category[-1])
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def with_company(rows: DataFrame, facet: str, least: int = 2) -> DataFrame:
    """Rows of facets that have at least `least` of them: one value alone compares with nothing."""
    return rows.withColumn("_k", F.count("*").over(Window.partitionBy(facet))).filter(F.col("_k") >= least).drop("_k")


def outcome_group(assessment: Column) -> Column:
    known = assessment.isin("unresolved", "not_assessed")
    return F.when(assessment == "", None).when(known, assessment).when(assessment.isNotNull(), "explained")


def derived_verdicts(verdicts: DataFrame, record: str = "record", at: str = "at") -> DataFrame:
    """record, group, assessment, evidence (the place of the quoted verdict) from verdicts (group, category, strong, at).

    Definite wording outweighs hedges where there is any; the larger group wins, a tie is none; explained records take
    their most frequent category (the first stated on ties) and quote its last statement.
    """
    strongest = F.col("strong") == F.max("strong").over(Window.partitionBy(record))
    used = verdicts.withColumn("_s", strongest).filter("_s")
    cats = used.groupBy(record, "group", "category").agg(F.count("*").alias("n"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    explained = F.col("group") == "explained"
    out = cats.groupBy(record).agg(
        F.sum(F.when(explained, F.col("n")).otherwise(0)).alias("_e"),
        F.sum(F.when(~explained, F.col("n")).otherwise(0)).alias("_u"),
        F.max(F.when(explained, F.struct("n", (-F.col("_first")).alias("f"), "category", "_last"))).alias("_c"),
        F.max(F.when(~explained, F.col("_last"))).alias("_l"),
    )
    wins = F.when(F.col("_e") > F.col("_u"), "explained").when(F.col("_u") > F.col("_e"), "unresolved")
    by = lambda e, u: F.when(F.col("_e") > F.col("_u"), e).otherwise(u)
    return out.withColumn("group", wins).filter("group is not null").select(
        record, "group", by(F.col("_c.category"), F.lit("unresolved")).alias("assessment"), by(F.col("_c._last"), F.col("_l")).alias("evidence")
    )


def effective_outcomes(records: DataFrame, derived: DataFrame, record: str = "record", use_derived: bool = True) -> DataFrame:
    """record, stated, outcome, effective, source, agrees for records (record, assessment) that state or lack a verdict."""
    stated = records.withColumn("stated", outcome_group(F.col("assessment"))).filter("stated is not null")
    both = stated.join(derived.select(record, F.col("group").alias("_g"), F.col("assessment").alias("_a")), record, "left")
    takes = F.lit(use_derived) & (F.col("stated") == "not_assessed") & F.col("_g").isNotNull()
    agrees = F.when(F.col("_g").isNotNull(), (F.col("stated") == "not_assessed") | (F.col("stated") == F.col("_g")))
    return both.select(
        record, "stated", F.when(takes, F.col("_g")).otherwise(F.col("stated")).alias("outcome"),
        F.when(takes, F.col("_a")).otherwise(F.col("assessment")).alias("effective"),
        F.when(takes, "derived").otherwise("stated").alias("source"), agrees.alias("agrees"),
    )


def record_facets(records: DataFrame, tags: DataFrame, record: str, columns: Sequence[str], year: str, known: Sequence[str]) -> DataFrame:
    """(record, facet, value): columns of a record, its decade, and its tags of the known facets."""
    whole = [records.select(record, F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    whole.append(records.select(record, F.lit("decade").alias("facet"), decade(F.col(year)).alias("value")))
    out = tags.filter(F.col("facet").isin(*known)).select(record, "facet", "value")
    for part in whole:
        out = out.union(part.filter("value is not null and value <> ''"))
    return out.distinct()


def item_sets(*tables: DataFrame, record: str, item: str) -> DataFrame:
    """record, items: the union of several (record, item) tables, sorted."""
    out = tables[0].select(record, item)
    for more in tables[1:]:
        out = out.union(more.select(record, item))
    return out.groupBy(record).agg(F.sort_array(F.collect_set(item)).alias("items"))


def redaction_tiers(records: DataFrame, marks: DataFrame, record: str, pages: str, flag: str, heavy: float = HEAVY) -> DataFrame:
    """records with marks, density (marks a page, 2 digits) and tier: heavy, marked, flag only or none."""
    n = marks.groupBy(record).agg(F.count("*").alias("marks"))
    out = records.join(n, record, "left").withColumn("marks", F.coalesce("marks", F.lit(0)))
    density = F.when(F.col(pages) > 0, F.bround(F.col("marks") / F.col(pages), 2)).otherwise(0.0)
    out = out.withColumn("density", density)
    tier = F.when((F.col(pages) > 0) & (F.col("density") >= heavy), "heavy").when(F.col("marks") > 0, "marked")
    return out.withColumn("tier", tier.when(F.col(flag), "flag only").otherwise("none"))


def redaction_split(tiers: DataFrame, facets: DataFrame, record: str, flag: str, least: int = 5, top: int = SPLIT_ROWS) -> DataFrame:
    """(facet, value, total, counts by tier, any_share, flag_share), most redacted first."""
    rows = facets.join(tiers.select(record, "tier", flag), record)
    out = rows.groupBy("facet", "value").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias("n_" + t.replace(" ", "_")) for t in ("heavy", "marked", "flag only", "none")],
        F.count_if(F.col(flag)).alias("_f"),
    ).filter(F.col("total") >= least)
    out = out.withColumns({"any_share": F.bround((F.col("total") - F.col("n_none")) / F.col("total"), 3), "flag_share": F.bround(F.col("_f") / F.col("total"), 3)})
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("any_share"), F.desc("total"), "value"))
    return with_company(out.drop("_f"), "facet").withColumn("place", place).filter(F.col("place") <= top)


def codes_by(marks: DataFrame, records: DataFrame, record: str, owner: str, code: str) -> DataFrame:
    """(owner, code, n, total, rank) of the marks of records that have an owner."""
    rows = marks.join(records.filter(F.col(owner).isNotNull()).select(record, owner), record)
    counts = rows.groupBy(owner, code).agg(F.count("*").alias("n"))
    w = Window.partitionBy(owner)
    return counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), code))})


def kind_summary(accounts: DataFrame, account: str, record: str, kinds: str, year: str) -> DataFrame:
    """(kind, size, records, first_year, last_year, enough) of accounts with an array of kinds."""
    rows = accounts.select(account, record, year, F.explode(kinds).alias("kind"))
    out = rows.groupBy("kind").agg(F.count("*").alias("size"), F.countDistinct(record).alias("records"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return out.withColumn("enough", (F.col("size") >= MIN_GROUP) & (F.col("records") >= MIN_RECORDS))


def kind_overlaps(accounts: DataFrame, kinds: str) -> DataFrame:
    """(a, b, n): accounts that are of both kinds, a before b. A row has few kinds, so its pairs are made within the row."""
    own = F.array_sort(F.array_distinct(kinds))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return accounts.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def hierarchy(episodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes (level, class, sub, n, records, share, first_year, last_year, outcomes) from the total down to subcategories.

    episodes (record, class, sub, year, outcome); classes (class): a class without episodes stays as a zero node, a
    subcategory without any does not. Share is that of the parent.
    """
    outcome = F.coalesce("outcome", F.lit("not_stated"))
    rows = episodes.withColumn("outcome", outcome)
    tree = rows.rollup("class", "sub").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.countDistinct("record").alias("records"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    tree = tree.withColumn("level", F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "class").otherwise("sub")).drop("_g")
    outcomes = None
    for level, keys in (("sub", ["class", "sub"]), ("class", ["class"]), ("total", [])):
        part = rows.groupBy(*keys, "outcome").agg(F.count("*").alias("c"))
        whole = part.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "c")))).alias("outcomes"))
        whole = whole.select(F.lit(level).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in ("class", "sub")], "outcomes")
        outcomes = whole if outcomes is None else outcomes.union(whole)
    same = [F.col("t.level") == F.col("o.level"), F.col("t.class").eqNullSafe(F.col("o.class")), F.col("t.sub").eqNullSafe(F.col("o.sub"))]
    tree = tree.alias("t").join(outcomes.alias("o"), same, "left").select("t.*", "o.outcomes")
    empty = classes.select("class").join(episodes.select("class"), "class", "left_anti")
    zero = F.lit(0).cast("long")
    empty = empty.select("class", F.lit(None).cast("string").alias("sub"), zero.alias("n"), zero.alias("records"), F.lit("class").alias("level"))
    tree = tree.unionByName(empty, allowMissingColumns=True)
    total = F.max(F.when(F.col("level") == "total", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    of_class = F.max(F.when(F.col("level") == "class", F.col("n"))).over(Window.partitionBy("class"))
    parent = F.when(F.col("level") == "class", total).when(F.col("level") == "sub", of_class)
    return tree.withColumn("share", F.bround(F.col("n") / parent, 3)).select("level", "class", "sub", "n", "records", "share", "first_year", "last_year", "outcomes")


def node_details(episodes: DataFrame, keys: Sequence[str], defining: DataFrame | None = None, k: int = 6) -> DataFrame:
    """(keys, detail, n, share, rank): details a node's episodes report most, without those that define the node."""
    sizes = episodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = episodes.select(*keys, F.explode(F.array_distinct("details")).alias("detail"))
    if defining is not None:
        rows = rows.join(F.broadcast(defining), [*keys, "detail"], "left_anti")
    top = most_common(rows, keys, "detail", k)
    return top.join(sizes, list(keys)).select(*keys, "detail", "n", F.bround(F.col("n") / F.col("_n"), 3).alias("share"), "rank")


def node_examples(episodes: DataFrame, keys: Sequence[str], sources: Sequence[str], k: int = 3) -> DataFrame:
    """(keys, id, place): up to k episodes of different records, those of the earlier sources and with most details first."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    order = [rank, F.size("details").desc(), F.col("id")]
    first = F.row_number().over(Window.partitionBy(*keys, "record").orderBy(*order))
    rows = episodes.withColumn("_r", first).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select(*keys, "id", "place")


def class_decades(episodes: DataFrame) -> DataFrame:
    """Zero-filled class x decade matrix with shares of the decade, over classes and decades that occur."""
    rows = episodes.withColumn("decade", decade(F.col("year"))).filter("decade is not null")
    cells = rows.groupBy("class", "decade").agg(F.count("*").alias("_n"))
    totals = rows.groupBy("decade").agg(F.count("*").alias("_t"))
    grid = episodes.select("class").distinct().join(totals).join(cells, ["class", "decade"], "left")
    n = F.coalesce("_n", F.lit(0))
    return grid.select("class", "decade", n.alias("n"), F.bround(n / F.col("_t"), 4).alias("share"))


def tag_rows(records: DataFrame, record: str, tags: str, singles: Mapping[str, str]) -> DataFrame:
    """(record, facet, value), no pair twice: entries of a map facet -> values, then single columns by facet."""
    listed = records.select(record, F.explode(tags).alias("facet", "values")).select(record, "facet", F.explode("values").alias("value"))
    for facet, column in singles.items():
        listed = listed.union(records.select(record, F.lit(facet), F.col(column)))
    return listed.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def subcategory(episodes: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key and sub: the first rule (class, place, sub, any, exclude) of the episode's class whose `any` meets its details
    and whose `exclude` does not; a rule without `any` always meets."""
    hit = (F.size("any") == 0) | F.arrays_overlap("details", "any")
    hits = episodes.join(F.broadcast(rules), "class").filter(hit & ~F.arrays_overlap("details", "exclude"))
    best = hits.groupBy(key).agg(F.min_by("sub", "place").alias("sub"))
    return episodes.join(best, key, "left").select(key, "sub")


def episode_accounts(episodes: DataFrame, accounts: DataFrame, record: str, key: str, account: str) -> DataFrame:
    """(key, account_ids): accounts on an episode's pages.

    The list of a set of pages is made once and joined to all episodes that have these pages.
    """
    pages = episodes.select(key, F.explode("pages").alias("page"), record)
    places = pages.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(record, "page"))).alias("_places"))
    told = accounts.groupBy(record, "page").agg(F.collect_set(account).alias("_ids"))
    each = places.select("_places").distinct().withColumn("_p", F.explode("_places"))
    found = each.join(told, (F.col(f"_p.{record}") == told[record]) & (F.col("_p.page") == told["page"])).groupBy("_places")
    lists = written(found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("account_ids")), "lists")
    # The result holds a list for each episode, so it is dealt by its size and not by that of the tables.
    ids = places.groupBy("_places").agg(F.count("*").alias("_n")).join(lists.select("_places", F.size("account_ids").alias("_m")), "_places")
    ids = ids.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    return dealt(places, "_places", rows=ids // LIST).join(lists.hint("merge"), "_places").select(key, "account_ids")


def episode_years(episodes: DataFrame, mentions: DataFrame, records: DataFrame, record: str, key: str) -> DataFrame:
    """(key, year): the episode's own, else the low median of years named on its pages, else the record's.

    A page's mentions are counted by year before episodes meet them.
    """
    pages = episodes.select(key, record, F.explode("pages").alias("page"))
    counts = mentions.filter(F.col("year").isNotNull()).groupBy(record, "page", F.col("year").alias("_y")).agg(F.count("*").alias("_n"))
    each = pages.join(counts, [record, "page"]).groupBy(key, "_y").agg(F.sum("_n").alias("_n"))
    years = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_y", "_n"))).alias("_l"), F.sum("_n").alias("_t"))
    upto = F.filter("_l", lambda x: 2 * F.aggregate(F.filter("_l", lambda z: z["_y"] <= x["_y"]), F.lit(0).cast("long"), lambda s, z: s + z["_n"]) >= F.col("_t"))
    named = years.select(key, F.get(upto, F.lit(0))["_y"].alias("_m"))
    rows = episodes.join(named, key, "left").join(records.select(record, F.col("year").alias("_r")), record, "left")
    return rows.select(key, F.coalesce("year", "_m", "_r").alias("year"))


def sampled(rows: DataFrame, key: str, keep: Column, most: int, seed: int = 5) -> DataFrame:
    """All rows to keep, and of the rest so many that there are `most` together, drawn by a hash of the key."""
    kept = rows.filter(keep)
    room = max(0, most - kept.count())
    rest = rows.filter(~F.coalesce(keep, F.lit(False)))
    return kept.unionByName(rest.orderBy(F.xxhash64(F.lit(seed), key), key).limit(room))


def page_text(pages: DataFrame, record: str, page: str, text: str, method: str, confidence: str) -> DataFrame:
    """record, text ([Page n] blocks of pages that say something), chars, scanned (pages read as images), confidence."""
    said = F.trim(F.regexp_replace(text, r"\s+", " ")) != ""
    blocks = F.array_sort(F.collect_list(F.when(said, F.struct(page, text))))
    out = pages.groupBy(record).agg(
        blocks.alias("_b"), F.count_if(F.col(method) == "ocr").alias("scanned"), F.bround(F.avg(confidence), 1).alias("confidence")
    )
    whole = F.array_join(F.transform("_b", lambda b: F.concat(F.lit("[Page "), b[page].cast("string"), F.lit("]\n"), b[text])), "\n\n")
    out = out.withColumn("text", whole)
    return out.select(record, "text", F.length("text").cast("long").alias("chars"), "scanned", "confidence")


def scanned_lines(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """page, text, confidence from recognised words (block, par, line, pos, word, conf): words a line, a blank line between
    blocks, the mean confidence to one digit. Words without confidence are layout and go."""
    real = words.filter((F.trim("word") != "") & (F.col("conf") >= 0)).withColumn("word", F.trim("word"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    lines = real.groupBy(*page, "block", "par", "line").agg(line.alias("t"), F.sum("conf").alias("s"), F.count("*").alias("n"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "line", "t"))), lambda x: x["t"]), "\n")
    blocks = lines.groupBy(*page, "block").agg(block.alias("t"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda x: x["t"]), "\n\n")
    return blocks.groupBy(*page).agg(text.alias("text"), F.bround(F.sum("s") / F.sum("n"), 1).alias("confidence"))
