"""Queries of the summaries over events, orders and lines, each with its DuckDB counterpart."""

from __future__ import annotations


from pyspark.sql import functions as F


from corvane.operators import episodes as ep
from corvane.operators import summaries as sm
from corvane.plans.catalog import query

# Events as details on pages: users are records, hours are pages, ids make up years of which some are unknown.
_HITS = """h AS (SELECT event_id, user_id AS record, hour(ts)::int AS page, event_type AS detail, CASE WHEN event_id % 9 > 0 THEN (1935 + event_id * 7 % 90)::int END AS year FROM events)"""


def hits(t):
    year = F.when(F.col("event_id") % 9 > 0, (1935 + F.col("event_id") * 7 % 90).cast("int"))
    return t.events.select("event_id", F.col("user_id").alias("record"), F.hour("ts").alias("page"), F.col("event_type").alias("detail"), year.alias("year"))


_DECADE = "CASE WHEN {0} >= 1940 THEN ({0} // 10 * 10)::int || 's' END"


@query(f"""WITH {_HITS}, d AS (SELECT detail, {_DECADE.format('year')} AS dec, count(*) AS n FROM h WHERE year >= 1940 GROUP BY 1, 2)
SELECT detail, count(DISTINCT (record, page)) AS pages, count(DISTINCT record) AS records, min(year) AS first_year, max(year) AS last_year,
(SELECT string_agg(dec || '=' || n, ',' ORDER BY dec) FROM d WHERE d.detail = h.detail) AS decades FROM h GROUP BY detail""")
def detail_profiles(t):
    out = sm.detail_summary(hits(t), "record", "page", "detail", "year")
    shown = F.array_join(F.transform(F.map_entries("decades"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("decades", shown)


@query(f"""WITH {_HITS}, b AS (SELECT *, count(*) OVER (PARTITION BY detail, record) AS k, row_number() OVER (PARTITION BY detail, record ORDER BY event_id % 10 DESC, page, event_id) AS r FROM h)
SELECT detail, record, page, row_number() OVER (PARTITION BY detail ORDER BY k DESC, record) AS place FROM b WHERE r = 1""")
def record_examples(t):
    rows = hits(t).withColumn("spot", F.struct("page", "event_id"))
    best = sm.best_examples(rows, "record", "spot", "detail", F.col("event_id") % 10)
    return best.select("detail", "record", "page", F.col("place").cast("long").alias("place"))


_MENTIONS = """m AS (SELECT l_orderkey AS unit, CASE WHEN l_orderkey % 3 = 0 OR l_linenumber % 2 = 0 THEN date_trunc('year', l_shipdate)::date ELSE l_shipdate::date END AS d,
l_orderkey % 3 = 0 OR l_linenumber % 2 = 0 AS only_year FROM lineitem)"""


def lines(t):
    """Line items with a mode made from the supplier, for a column of few values."""
    return t.lineitem.withColumn("mode", F.concat(F.lit("m"), F.col("l_suppkey") % 7))


def mentions(t):
    only_year = (F.col("l_orderkey") % 3 == 0) | (F.col("l_linenumber") % 2 == 0)
    day = F.when(only_year, F.trunc("l_shipdate", "year")).otherwise(F.to_date("l_shipdate"))
    return lines(t).select(F.col("l_orderkey").alias("unit"), day.alias("d"), F.when(only_year, "year").otherwise("day").alias("precision"))


@query(f"""WITH {_MENTIONS}, u AS (SELECT DISTINCT unit, year(d) AS y, CASE WHEN NOT only_year THEN month(d) END AS mo FROM m),
k AS (SELECT *, bool_or(mo IS NOT NULL) OVER (PARTITION BY unit) AS fine FROM u), s AS (SELECT y, mo, 1.0::double / count(*) OVER (PARTITION BY unit) AS w FROM k WHERE mo IS NOT NULL OR NOT fine)
SELECT y AS year, mo AS month, round_even(sum(w), 6) AS weight FROM s GROUP BY 1, 2""")
def timeline_with_years(t):
    return sm.timeline(mentions(t), ["unit"], "d", "precision").select(
        F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), F.bround("weight", 6).alias("weight"))


_WAVES = """w AS (SELECT * FROM (VALUES (1999, 2000), (1997, 1997)) v(first, last)),
i AS (SELECT DISTINCT first, l_orderkey AS unit FROM lineitem JOIN w ON year(l_shipdate) BETWEEN first AND last)"""


@query(f"""WITH {_WAVES} SELECT first, count(*) AS units FROM i GROUP BY 1""")
def units_in_waves(t):
    inside = sm.units_in_waves(*_wave_units(t), "year", ["unit"])
    return inside.groupBy("first").agg(F.count("*").alias("units"))


def _wave_units(t):
    waves = t.spark.createDataFrame([(1999, 2000), (1997, 1997)], "first int, last int")
    return waves, lines(t).select(F.col("l_orderkey").alias("unit"), F.year("l_shipdate").alias("year"))


@query(f"""WITH {_WAVES}, p AS (SELECT DISTINCT l_orderkey AS unit, ('m' || l_suppkey % 7) || '/' || l_returnflag AS detail FROM lineitem WHERE l_quantity > 30),
o AS (SELECT detail, count(*) AS o FROM p GROUP BY 1), sz AS (SELECT first, count(*) AS w FROM i GROUP BY 1),
r AS (SELECT first, detail, count(*) AS n FROM i JOIN p USING (unit) GROUP BY 1, 2 HAVING count(*) >= 3),
l AS (SELECT first, detail, n, n * (SELECT count(DISTINCT unit) FROM p) / (w * o) AS lift FROM r JOIN o USING (detail) JOIN sz USING (first)),
k AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY n DESC, detail) AS c, CASE WHEN lift >= 1.05 THEN row_number() OVER (PARTITION BY first ORDER BY lift >= 1.05 DESC, lift DESC, detail) END AS d FROM l)
SELECT first, detail, n, round_even(lift, 2) AS lift, CASE WHEN c <= 6 THEN c END AS common, CASE WHEN d <= 6 THEN d END AS distinctive FROM k WHERE c <= 6 OR d <= 6""")
def wave_profiles(t):
    inside = sm.units_in_waves(*_wave_units(t), "year", ["unit"])
    details = lines(t).filter("l_quantity > 30").select(F.col("l_orderkey").alias("unit"), F.concat_ws("/", "mode", "l_returnflag").alias("detail"))
    out = sm.wave_details(inside, details, ["unit"], "detail", lift=1.05)
    return out.withColumns({"common": F.col("common").cast("long"), "distinctive": F.col("distinctive").cast("long")})


@query(f"""WITH {_HITS}, n AS (SELECT 'p' || page AS place, count(*) AS n FROM h GROUP BY 1), top AS (SELECT *, row_number() OVER (ORDER BY n DESC, place) AS rank FROM n QUALIFY rank <= 12),
c AS (SELECT 'p' || page AS place, {_DECADE.format('year')} AS decade, count(*) AS c FROM h WHERE year >= 1940 GROUP BY 1, 2),
g AS (SELECT * FROM top, (SELECT DISTINCT decade FROM c JOIN top USING (place)))
SELECT place, n, rank, decade, coalesce(c, 0) AS in_decade FROM g LEFT JOIN c USING (place, decade)""")
def place_decades(t):
    rows = hits(t).select(F.concat(F.lit("p"), "page").alias("place"), "year")
    return sm.place_summary(rows, "place", "year").withColumn("rank", F.col("rank").cast("long"))


@query("""WITH x AS (SELECT ('m' || l_suppkey % 7) AS facet, l_returnflag || l_linenumber AS value, CASE WHEN l_quantity > 25 THEN 'a' WHEN l_quantity > 10 THEN 'b' ELSE 'c' END AS g FROM lineitem),
s AS (SELECT facet, value, count(*) AS total, count(*) FILTER (g = 'a') AS n_a, count(*) FILTER (g = 'b') AS n_b FROM x GROUP BY 1, 2 HAVING count(*) >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY total DESC, value) AS r FROM s)
SELECT facet, value, total, n_a, n_b, round_even(n_a / total, 3) AS share_a, round_even(n_b / total, 3) AS share_b FROM k WHERE r <= 12""")
def facet_splits(t):
    group = F.when(F.col("l_quantity") > 25, "a").when(F.col("l_quantity") > 10, "b").otherwise("c")
    rows = lines(t).select(F.col("mode").alias("facet"), F.concat("l_returnflag", "l_linenumber").alias("value"), group.alias("g"))
    return sm.with_company(sm.split_by(rows, ["facet", "value"], "g", ["a", "b"], 5, 12), "facet")


_VERDICTS = """v AS (SELECT user_id AS record, event_id AS pos, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'explained' ELSE 'unresolved' END AS grp, event_type AS category,
event_id % 4 = 0 AND user_id % 5 > 0 AS strong FROM events WHERE event_id % 3 > 0),
d AS (SELECT record, CASE WHEN e > u THEN 'explained' WHEN u > e THEN 'unresolved' END AS grp, CASE WHEN e > u THEN cat ELSE 'unresolved' END AS assessment, CASE WHEN e > u THEN cat_last ELSE u_last END AS evidence
FROM (SELECT record, coalesce(sum(n) FILTER (grp = 'explained'), 0) AS e, coalesce(sum(n) FILTER (grp = 'unresolved'), 0) AS u,
arg_max(category, (n, -first)) FILTER (grp = 'explained') AS cat, arg_max(last, (n, -first)) FILTER (grp = 'explained') AS cat_last, max(last) FILTER (grp = 'unresolved') AS u_last
FROM (SELECT record, grp, category, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (SELECT *, max(strong) OVER (PARTITION BY record) AS any_strong FROM v) WHERE strong = any_strong GROUP BY 1, 2, 3)
GROUP BY 1) WHERE e <> u)"""


def verdicts(t):
    rows = t.events.filter("event_id % 3 > 0")
    group = F.when(F.col("event_type").isin("click", "view", "signup"), "explained").otherwise("unresolved")
    strong = (F.col("event_id") % 4 == 0) & (F.col("user_id") % 5 > 0)
    return rows.select(F.col("user_id").alias("record"), F.col("event_id").alias("at"), group.alias("group"), F.col("event_type").alias("category"), strong.alias("strong"))


@query(f"WITH {_VERDICTS} SELECT record, grp AS \"group\", assessment, evidence FROM d")
def derived_verdicts(t):
    return sm.derived_verdicts(verdicts(t))


_STATED = """r AS (SELECT c_custkey AS record, CASE c_custkey % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'not_assessed' WHEN 2 THEN 'hoax' END AS assessment FROM customer)"""


@query(f"""WITH {_VERDICTS}, {_STATED}, s AS (SELECT *, CASE WHEN assessment IN ('unresolved', 'not_assessed') THEN assessment ELSE 'explained' END AS stated FROM r WHERE assessment IS NOT NULL)
SELECT record, stated, CASE WHEN stated = 'not_assessed' AND d.grp IS NOT NULL THEN d.grp ELSE stated END AS outcome, CASE WHEN stated = 'not_assessed' AND d.grp IS NOT NULL THEN d.assessment ELSE s.assessment END AS effective,
CASE WHEN stated = 'not_assessed' AND d.grp IS NOT NULL THEN 'derived' ELSE 'stated' END AS source, CASE WHEN d.grp IS NOT NULL THEN stated = 'not_assessed' OR stated = d.grp END AS agrees
FROM s LEFT JOIN d USING (record)""")
def record_outcomes(t):
    stated = F.get(F.array(F.lit("unresolved"), F.lit("not_assessed"), F.lit("hoax")), (F.col("c_custkey") % 4).cast("int"))
    records = t.customer.select(F.col("c_custkey").alias("record"), stated.alias("assessment"))
    return sm.effective_outcomes(records, sm.derived_verdicts(verdicts(t)))


_TIERS = """p AS (SELECT o_orderkey AS record, o_custkey % 3 AS pages, o_orderkey % 5 = 0 AS redacted, o_orderpriority AS prio FROM orders),
k AS (SELECT l_orderkey AS record, count(*) AS marks FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
t AS (SELECT p.*, coalesce(marks, 0) AS marks, CASE WHEN pages > 0 THEN round_even(coalesce(marks, 0) / pages, 2) ELSE 0 END AS density FROM p LEFT JOIN k USING (record)),
z AS (SELECT *, CASE WHEN pages > 0 AND density >= 2 THEN 'heavy' WHEN marks > 0 THEN 'marked' WHEN redacted THEN 'flag only' ELSE 'none' END AS tier FROM t)"""


def tiers(t):
    records = t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_custkey") % 3).alias("pages"), (F.col("o_orderkey") % 5 == 0).alias("redacted"), F.col("o_orderpriority").alias("prio"))
    marks = lines(t).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record"), F.col("mode").alias("code"))
    return sm.redaction_tiers(records, marks, "record", "pages", "redacted"), marks, records


@query(f"WITH {_TIERS} SELECT record, marks, density, tier FROM z")
def redaction_tiers(t):
    return tiers(t)[0].select("record", "marks", "density", "tier")


@query(f"""WITH {_TIERS}, f AS (SELECT 'prio' AS facet, prio AS value, * FROM z UNION ALL SELECT 'pages', pages::varchar, * FROM z UNION ALL SELECT 'one', 'only', * FROM z),
s AS (SELECT facet, value, count(*) AS total, count(*) FILTER (tier = 'heavy') AS n_heavy, count(*) FILTER (tier = 'marked') AS n_marked, count(*) FILTER (tier = 'flag only') AS n_flag_only,
count(*) FILTER (tier = 'none') AS n_none, round_even((count(*) - count(*) FILTER (tier = 'none')) / count(*), 3) AS any_share, round_even(count(*) FILTER (redacted) / count(*), 3) AS flag_share
FROM f GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT *, row_number() OVER (PARTITION BY facet ORDER BY any_share DESC, total DESC, value) AS place FROM s WHERE facet <> 'one' QUALIFY place <= 12""")
def redaction_splits(t):
    tiered, _, records = tiers(t)
    facets = records.select("record", F.lit("prio").alias("facet"), F.col("prio").alias("value"))
    facets = facets.union(records.select("record", F.lit("pages"), F.col("pages").cast("string"))).union(records.select("record", F.lit("one"), F.lit("only")))
    return sm.redaction_split(tiered, facets, "record", "redacted").withColumn("place", F.col("place").cast("long"))


@query("""SELECT owner, code, n, sum(n) OVER (PARTITION BY owner)::bigint AS total, row_number() OVER (PARTITION BY owner ORDER BY n DESC, code) AS rank FROM
(SELECT o_orderpriority AS owner, ('m' || l_suppkey % 7) AS code, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)""")
def codes_by_owner(t):
    _, marks, records = tiers(t)
    return sm.codes_by(marks, records.withColumnRenamed("prio", "owner"), "record", "owner", "code").withColumn("rank", F.col("rank").cast("long"))


_KINDS = """a AS (SELECT l_orderkey * 10 + l_linenumber AS account, l_suppkey AS record, year(l_shipdate)::int AS year, list_filter([CASE WHEN l_quantity > 45 THEN 'ce1' END,
CASE WHEN l_discount > 0.08 THEN 'ce2' END, CASE WHEN l_tax > 0.07 THEN 'ce3' END], x -> x IS NOT NULL) AS kinds FROM lineitem)"""


def accounts(t):
    kinds = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "ce1"), F.when(F.col("l_discount") > 0.08, "ce2"), F.when(F.col("l_tax") > 0.07, "ce3")))
    return lines(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("account"), F.col("l_suppkey").alias("record"), F.year("l_shipdate").alias("year"), kinds.alias("kinds"))


@query(f"""WITH {_KINDS.replace('x -> x', 'lambda x: x')} SELECT kind, count(*) AS size, count(DISTINCT record) AS records, min(year) AS first_year, max(year) AS last_year,
count(*) >= 8 AND count(DISTINCT record) >= 3 AS enough FROM (SELECT *, unnest(kinds) AS kind FROM a) GROUP BY 1""")
def kind_summary(t):
    return sm.kind_summary(accounts(t), "account", "record", "kinds", "year")


@query(f"""WITH {_KINDS.replace('x -> x', 'lambda x: x')}, u AS MATERIALIZED (SELECT row, unnest(kinds) AS k FROM (SELECT row_number() OVER () AS row, kinds FROM a)) SELECT x.k AS a, y.k AS b, count(*) AS n FROM u x JOIN u y ON x.row = y.row AND x.k < y.k GROUP BY 1, 2""")
def kind_overlaps(t):
    return sm.kind_overlaps(accounts(t), "kinds")


_EPISODES = """e AS (SELECT o_orderkey AS id, o_custkey AS record, o_orderpriority AS class, o_orderpriority || '/' || (o_orderkey % 3) AS sub, year(o_orderdate)::int AS year,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS outcome, ['k' || (o_orderkey % 5), 'm' || (o_custkey % 7), 'k' || (o_orderkey % 5)] AS details FROM orders)"""


def episodes(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(k.alias("id"), c.alias("record"), F.col("o_orderpriority").alias("class"), F.concat("o_orderpriority", F.lit("/"), k % 3).alias("sub"), F.year("o_orderdate").alias("year"),
                           F.when(k % 4 > 0, F.col("o_orderstatus")).alias("outcome"), F.array(F.concat(F.lit("k"), k % 5), F.concat(F.lit("m"), c % 7), F.concat(F.lit("k"), k % 5)).alias("details"))


def _level(level, keys):
    cls = "class" if "class" in keys else "NULL"
    sub = "sub" if "sub" in keys else "NULL"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    same = " AND ".join(f"x.{k} = e.{k}" for k in keys) or "true"
    return f"""SELECT '{level}' AS level, {cls} AS class, {sub} AS sub, count(*) AS n, count(DISTINCT record) AS records, min(year) AS first_year, max(year) AS last_year,
(SELECT string_agg(o || '=' || c, ',' ORDER BY o) FROM (SELECT coalesce(outcome, 'not_stated') AS o, count(*) AS c FROM e x WHERE {same} GROUP BY 1)) AS outcomes FROM e {group}"""


@query(f"""WITH {_EPISODES}, n AS ({_level('total', [])} UNION ALL {_level('class', ['class'])} UNION ALL {_level('sub', ['class', 'sub'])} UNION ALL SELECT 'class', 'never', NULL, 0, 0, NULL, NULL, NULL)
SELECT n.level, n.class, n.sub, n.n, n.records, round_even(n.n / p.n, 3) AS share, n.first_year, n.last_year, n.outcomes FROM n LEFT JOIN n p
ON (n.level = 'class' AND p.level = 'total') OR (n.level = 'sub' AND p.level = 'class' AND p.class = n.class)""")
def event_hierarchy(t):
    rows = episodes(t)
    classes = rows.select("class").distinct().union(t.spark.createDataFrame([("never",)], "class string"))
    shown = F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return sm.hierarchy(rows, classes).withColumn("outcomes", shown)


@query(f"""WITH {_EPISODES}, s AS (SELECT class, sub, count(*) AS t FROM e GROUP BY 1, 2), d AS (SELECT class, sub, detail, count(*) AS n FROM (SELECT class, sub, unnest(list_distinct(details)) AS detail FROM e)
WHERE NOT (sub LIKE '%/0' AND detail = 'k0') GROUP BY 1, 2, 3) SELECT class, sub, detail, n, round_even(n / t, 3) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY class, sub ORDER BY n DESC, detail) AS rank FROM d) JOIN s USING (class, sub) WHERE rank <= 6""")
def node_details(t):
    rows = episodes(t)
    defining = rows.filter(F.col("sub").like("%/0")).select("class", "sub", F.lit("k0").alias("detail")).distinct()
    return sm.node_details(rows, ["class", "sub"], defining).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_EPISODES}, r AS (SELECT class, {_DECADE.format('year')} AS decade FROM e), c AS (SELECT class, decade, count(*) AS n FROM r GROUP BY 1, 2), tot AS (SELECT decade, count(*) AS t FROM r GROUP BY 1)
SELECT class, decade, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / t, 4) AS share FROM (SELECT DISTINCT class FROM e) CROSS JOIN tot LEFT JOIN c USING (class, decade)""")
def class_decades(t):
    return sm.class_decades(episodes(t))


@query("""SELECT DISTINCT p_partkey AS record, facet, value FROM (SELECT p_partkey, 'kind' AS facet, unnest(string_split(p_type, ' ')) AS value FROM part UNION ALL
SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'size', nullif((p_size % 3)::varchar, '0') FROM part) WHERE value IS NOT NULL AND value <> ''""")
def classification_tags(t):
    rows = t.part.select(F.col("p_partkey").alias("record"), F.create_map(F.lit("kind"), F.split("p_type", " ")).alias("tags"), "p_brand",
                         F.nullif((F.col("p_size") % 3).cast("string"), F.lit("0")).alias("size"))
    return sm.tag_rows(rows, "record", "tags", {"brand": "p_brand", "size": "size"})


_SUBS = [("1-URGENT", 1, "both", ["k1"], ["m3"]), ("1-URGENT", 2, "k1", ["k1"], []), ("1-URGENT", 3, "rest", [], []), ("5-LOW", 1, "m", ["m1", "m2"], ["k4"])]


@query(f"""WITH {_EPISODES}, r(class, place, sub, a, x) AS (VALUES ('1-URGENT', 1, 'both', ['k1'], ['m3']), ('1-URGENT', 2, 'k1', ['k1'], ['']), ('1-URGENT', 3, 'rest', [], ['']), ('5-LOW', 1, 'm', ['m1', 'm2'], ['k4']))
SELECT id, b.sub FROM e LEFT JOIN (SELECT id, arg_min(r.sub, place) AS sub FROM e JOIN r USING (class) WHERE (len(a) = 0 OR list_has_any(details, a)) AND NOT list_has_any(details, x) GROUP BY 1) b USING (id)""")
def set_subcategories(t):
    rules = t.spark.createDataFrame(_SUBS, "class string, place int, sub string, any array<string>, exclude array<string>")
    return sm.subcategory(episodes(t).drop("sub"), rules, "id")


@query("""SELECT s_suppkey AS id, list_sort(list(DISTINCT p_partkey)) AS account_ids FROM (SELECT s_suppkey, s_nationkey, unnest([s_suppkey % 50, s_suppkey % 7]) AS page FROM supplier) s
JOIN part ON p_partkey % 25 = s_nationkey AND p_size = page GROUP BY 1""")
def accounts_of_episodes(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("record"), F.array(F.col("s_suppkey") % 50, F.col("s_suppkey") % 7).alias("pages"))
    told = t.part.select((F.col("p_partkey") % 25).alias("record"), F.col("p_size").cast("long").alias("page"), "p_partkey")
    return sm.episode_accounts(rows, told, "record", "id", "p_partkey")


@query("""WITH e AS (SELECT s_suppkey AS id, s_nationkey AS record, [s_suppkey % 5, 9] AS pages, CASE WHEN s_suppkey % 4 = 0 THEN 1900 END AS year FROM supplier),
m AS (SELECT o_custkey % 25 AS record, o_orderkey % 8 AS page, year(o_orderdate)::int AS y FROM orders WHERE o_custkey % 25 < 20), k AS (SELECT id, quantile_disc(y, 0.5) AS y FROM (SELECT id, record, unnest(pages) AS page FROM e) JOIN m USING (record, page) GROUP BY 1)
SELECT id, coalesce(e.year, k.y, 2000 + n_nationkey)::int AS year FROM e LEFT JOIN k USING (id) LEFT JOIN nation ON n_nationkey = record""")
def years_of_episodes(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("record"), F.array(F.col("s_suppkey") % 5, F.lit(9).cast("long")).alias("pages"), F.when(F.col("s_suppkey") % 4 == 0, 1900).alias("year"))
    named = t.orders.filter("o_custkey % 25 < 20").select((F.col("o_custkey") % 25).alias("record"), (F.col("o_orderkey") % 8).alias("page"), F.year("o_orderdate").alias("year"))
    records = t.nation.select(F.col("n_nationkey").cast("long").alias("record"), (2000 + F.col("n_nationkey")).cast("int").alias("year"))
    return sm.episode_years(rows, named, records, "record", "id").withColumn("year", F.col("year").cast("int"))


@query(f"""WITH {_HITS} SELECT record, string_agg(DISTINCT i, ',' ORDER BY i) AS items FROM (SELECT record, detail AS i FROM h UNION ALL SELECT record, 'p' || page FROM h) GROUP BY 1""")
def record_item_sets(t):
    rows = hits(t)
    out = sm.item_sets(rows.select("record", F.col("detail").alias("i")), rows.select("record", F.concat(F.lit("p"), "page").alias("i")), record="record", item="i")
    return out.withColumn("items", F.array_join("items", ","))


@query("""SELECT DISTINCT c_custkey AS record, facet, value FROM (SELECT c_custkey, 'seg' AS facet, c_mktsegment AS value FROM customer UNION ALL
SELECT c_custkey, 'decade', CASE WHEN 1930 + c_custkey % 80 >= 1940 THEN (1930 + c_custkey % 80) // 10 * 10 || 's' END FROM customer UNION ALL
SELECT o_custkey, 'status', o_orderstatus FROM orders) WHERE value IS NOT NULL""")
def record_facets(t):
    records = t.customer.select(F.col("c_custkey").alias("record"), F.col("c_mktsegment").alias("seg"), (1930 + F.col("c_custkey") % 80).alias("year"))
    tags = t.orders.select(F.col("o_custkey").alias("record"), F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value"))
    tags = tags.union(t.orders.select("o_custkey", F.lit("odd"), "o_orderpriority"))
    return sm.record_facets(records, tags, "record", ["seg"], "year", ["status"])


@query("""SELECT l_returnflag, list_sort(list(l_linenumber))[len(list(l_linenumber)) // 2 + 1] AS high, quantile_disc(l_linenumber, 0.5) AS low FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1""")
def high_and_low_medians(t):
    return lines(t).filter("l_orderkey % 2 = 0").groupBy("l_returnflag").agg(sm.high_median("l_linenumber").alias("high"), sm.low_median("l_linenumber").alias("low"))


@query("""WITH p AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'ocr' ELSE 'text' END AS method, CASE WHEN turn % 2 = 0 THEN turn * 7.25 END AS conf FROM conversations)
SELECT conv_id, sha256(coalesce(string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '')) AS h,
length(coalesce(string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '')) AS chars,
count(*) FILTER (method = 'ocr') AS scanned, round_even(avg(conf), 1) AS confidence FROM p GROUP BY 1""")
def page_texts(t):
    pages = t.conversations.select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, "ocr").otherwise("text").alias("method"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 7.25).alias("conf"))
    out = sm.page_text(pages, "conv_id", "turn", "text", "method", "conf")
    return out.select("conv_id", F.sha2("text", 256).alias("h"), "chars", "scanned", "confidence")


@query("""WITH w AS (SELECT o_custkey AS page, o_orderkey % 3 AS block, o_orderkey % 2 AS par, o_orderkey % 4 AS line, o_orderkey AS pos, o_orderstatus || o_orderkey AS word, (o_orderkey % 101 - 1)::double AS conf FROM orders),
l AS (SELECT page, block, par, line, string_agg(word, ' ' ORDER BY pos) AS t, sum(conf) AS s, count(*) AS n FROM w WHERE conf >= 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT page, block, string_agg(t, chr(10) ORDER BY par, line) AS t, sum(s) AS s, sum(n) AS n FROM l GROUP BY 1, 2)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY block) AS text, round_even(sum(s) / sum(n), 1) AS confidence FROM b GROUP BY 1""")
def scanned_pages(t):
    k = F.col("o_orderkey")
    words = t.orders.select(F.col("o_custkey").alias("page"), (k % 3).alias("block"), (k % 2).alias("par"), (k % 4).alias("line"), k.alias("pos"), F.concat("o_orderstatus", k).alias("word"), (k % 101 - 1).cast("double").alias("conf"))
    return sm.scanned_lines(words, ["page"])


@query("""WITH s AS (SELECT o_custkey % 100 AS g, o_orderpriority AS i, count(*) AS n FROM orders GROUP BY 1, 2) SELECT g, i, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, i) AS rank FROM s QUALIFY rank <= 3""")
def most_common_items(t):
    rows = t.orders.select((F.col("o_custkey") % 100).alias("g"), F.col("o_orderpriority").alias("i"))
    return sm.most_common(rows, ["g"], "i", 3).withColumn("rank", F.col("rank").cast("long"))


@query(None)
def seeded_sample(t):
    """The draw follows Spark's hash; tests check that it is of the right size, repeats and keeps what it must."""
    return sm.sampled(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", F.col("o_orderpriority") == "1-URGENT", 4000)


@query("""SELECT release, topic, n, round_even(n / t, 3) AS share FROM (SELECT year(o_orderdate) AS release, ('m' || l_suppkey % 7) AS topic, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
JOIN (SELECT year(o_orderdate) AS release, count(*) AS t FROM orders GROUP BY 1) USING (release)""")
def topic_shares(t):
    rows = lines(t).select("l_orderkey", "mode").distinct().join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    counts = rows.groupBy(F.year("o_orderdate").alias("release"), F.col("mode").alias("topic")).agg(F.count("*").alias("n"))
    totals = t.orders.groupBy(F.year("o_orderdate").alias("release")).agg(F.count("*").alias("t"))
    return counts.join(totals, "release").select(F.col("release").cast("long").alias("release"), "topic", "n", F.bround(F.col("n") / F.col("t"), 3).alias("share"))


@query(f"""WITH {_MENTIONS}, u AS (SELECT DISTINCT unit, year(d) AS y, CASE WHEN NOT only_year THEN month(d) END AS mo FROM m),
k AS (SELECT *, bool_or(mo IS NOT NULL) OVER (PARTITION BY unit) AS fine FROM u), s AS (SELECT y, mo, 1.0::double / count(*) OVER (PARTITION BY unit) AS w FROM k WHERE mo IS NOT NULL OR NOT fine),
g AS (SELECT first, last, unnest(range(1, 13)) AS month FROM (VALUES (1999, 2000), (1997, 1997), (1900, 1901)) v(first, last)),
x AS (SELECT first, month, round_even(coalesce((SELECT sum(w) FROM s WHERE mo = month AND y BETWEEN first AND last), 0), 2) AS weight FROM g)
SELECT *, CASE WHEN max(weight) OVER (PARTITION BY first) > 0 THEN first_value(month) OVER (PARTITION BY first ORDER BY weight DESC, month) END AS peak FROM x""")
def months_of_waves(t):
    waves = t.spark.createDataFrame([(1999, 2000), (1997, 1997), (1900, 1901)], "first int, last int")
    out = sm.wave_months(waves, sm.timeline(mentions(t), ["unit"], "d", "precision"))
    return out.withColumns({"month": F.col("month").cast("long"), "peak": F.col("peak").cast("long")})


@query(f"""WITH {_EPISODES}, x AS (SELECT *, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 2 ELSE 4 END AS s, len(details) + id % 2 AS n FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY class, record ORDER BY s, n DESC, id) AS k FROM x)
SELECT class, id, row_number() OVER (PARTITION BY class ORDER BY s, n DESC, id) AS place FROM r WHERE k = 1 QUALIFY place <= 3""")
def examples_of_nodes(t):
    source = F.get(F.array(F.lit("curated"), F.lit("model"), F.lit("odd")), (F.col("id") % 3).cast("int"))
    rows = episodes(t).withColumn("source", source)
    rows = rows.withColumn("details", F.when(F.col("id") % 2 == 1, F.array_append("details", F.lit("z"))).otherwise(F.col("details")))
    return sm.node_examples(rows, ["class"], ["curated", "model", "rules"]).withColumn("place", F.col("place").cast("long"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, array_to_string(list_sort(list_intersect(a.days, b.days)), ',') AS shared FROM
(SELECT l_suppkey AS s_suppkey, list(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) AS days FROM lineitem WHERE l_quantity > 45 GROUP BY 1) a JOIN
(SELECT l_suppkey AS s_suppkey, list(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) AS days FROM lineitem WHERE l_quantity > 45 GROUP BY 1) b ON b.s_suppkey = a.s_suppkey + 1""")
def shared_days(t):
    days = t.lineitem.filter("l_quantity > 45").groupBy("l_suppkey").agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("days"))
    a = days.select(F.col("l_suppkey").alias("a"), F.col("days").alias("da"), (F.col("l_suppkey") + 1).alias("b"))
    both = a.join(days.select(F.col("l_suppkey").alias("b"), F.col("days").alias("db")), "b")
    return both.select("a", "b", F.array_join(F.array_sort(F.array_intersect("da", "db")), ",").alias("shared"))


@query("""WITH r AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 4 = 0 THEN 'video' ELSE 'pdf' END AS media, CASE c_custkey % 6 WHEN 1 THEN 'correspondence' WHEN 2 THEN 'analysis' END AS kind,
c_custkey % 11 = 0 AS research, c_custkey % 7 > 0 AS readable, CASE WHEN c_custkey % 5 = 0 THEN ['landed'] WHEN c_custkey % 5 = 1 THEN ['disc', 'pilot'] ELSE [] END AS tags FROM customer),
a AS (SELECT o_custkey AS record, o_orderkey % 9 AS page, CASE o_orderstatus WHEN 'F' THEN ['disc'] WHEN 'O' THEN ['orbit', o_orderpriority] ELSE [] END AS tags FROM orders WHERE o_custkey % 3 = 0),
told2 AS (SELECT t.record, t.page, t.details, t.class FROM (SELECT a.record, a.page, a.tags AS details, CASE WHEN list_contains(a.tags, 'orbit') THEN 'space' WHEN r.media = 'video' AND a.page = 0 THEN 'sensor' ELSE 'sighting' END AS class
FROM a JOIN r ON a.record = r.record WHERE len(a.tags) > 0) t),
one AS (SELECT record, CASE WHEN research OR kind = 'correspondence' OR readable THEN 0 END AS page, CASE WHEN research OR coalesce(kind = 'correspondence', false) THEN CASE kind WHEN 'correspondence' THEN ['inquiry'] WHEN 'analysis' THEN ['study'] ELSE [] END
WHEN readable THEN tags ELSE [] END AS details, CASE WHEN research OR coalesce(kind = 'correspondence', false) OR NOT readable THEN 'none' WHEN list_contains(tags, 'landed') THEN 'encounter' WHEN len(tags) > 0 THEN 'sighting'
WHEN media = 'video' THEN 'sensor' ELSE 'none' END AS class FROM r WHERE record NOT IN (SELECT record FROM told2))
SELECT record, row_number() OVER (PARTITION BY record ORDER BY page, d) - 1 AS seq, page, class FROM (SELECT *, array_to_string(list_sort(details), ',') AS d FROM told2 UNION ALL SELECT record, page, details, class, array_to_string(list_sort(details), ',') FROM one)""")
def rule_episodes(t):
    """One episode for each tagged account (orders), else one for the description (customers)."""
    key = F.col("c_custkey")
    kind = F.when(key % 6 == 1, "correspondence").when(key % 6 == 2, "analysis")
    tags = F.when(key % 5 == 0, F.array(F.lit("landed"))).when(key % 5 == 1, F.array(F.lit("disc"), F.lit("pilot"))).otherwise(F.array().cast("array<string>"))
    records = t.customer.select(key.alias("record"), F.when(key % 4 == 0, "video").otherwise("pdf").alias("media"), kind.alias("kind"), (key % 11 == 0).alias("research"),
                                F.when(key % 7 > 0, "text").alias("text"), tags.alias("description_tags"))
    told = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("disc"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("orbit"), F.col("o_orderpriority")))
    accounts = t.orders.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("record"), (F.col("o_orderkey") % 9).cast("int").alias("page"), F.coalesce(told, F.array().cast("array<string>")).alias("tags"))
    out = ep.rule_episodes(records, accounts)
    return out.select("record", F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), "class")
