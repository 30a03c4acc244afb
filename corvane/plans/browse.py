"""Queries of search, browsing and record states over the orders, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import browse as br
from corvane.operators import lifecycle as lc
from corvane.plans.catalog import query
from corvane.plans.metadata import check

# Orders as records: states, a classifier that some lack, years that some lack.
_RECORDS = """r AS (SELECT o_orderkey AS id, o_orderkey % 7 AS release, 'R' || o_orderkey AS record, o_orderpriority AS title, o_custkey AS cust,
CASE o_orderstatus WHEN 'F' THEN 'classified' WHEN 'O' THEN 'extracted' ELSE 'failed' END AS status, o_orderkey % 4 = 0 AS featured,
CASE WHEN o_orderkey % 3 > 0 THEN 'rules' END AS classifier, CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END AS year,
CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 4)::int END AS significance, CASE WHEN o_orderkey % 9 > 0 THEN (o_custkey % 50)::int END AS pages,
(o_orderkey % 8)::int AS attempts, CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'video' END AS media, CASE WHEN o_orderkey % 10 > 2 THEN 'f' END AS file
FROM orders)"""


def records(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(F.col("o_orderstatus") == "F", "classified").when(F.col("o_orderstatus") == "O", "extracted").otherwise("failed")
    return t.orders.select(
        key.alias("id"), (key % 7).alias("release"), F.concat(F.lit("R"), key).alias("record"), F.col("o_orderpriority").alias("title"), cust.alias("cust"),
        state.alias("status"), (key % 4 == 0).alias("featured"), F.when(key % 3 > 0, "rules").alias("classifier"),
        F.when(key % 5 > 0, F.year("o_orderdate")).alias("year"), F.when(key % 6 > 0, (key % 4).cast("int")).alias("significance"),
        F.when(key % 9 > 0, (cust % 50).cast("int")).alias("pages"), (key % 8).cast("int").alias("attempts"),
        F.when(key % 2 == 0, "pdf").otherwise("video").alias("media"), F.when(key % 10 > 2, "f").alias("file"))


@query(f"""WITH {_RECORDS} SELECT release, count(*) AS n FROM r WHERE status = 'classified' OR (status IN ('extracted', 'downloaded')
AND classifier IS NOT NULL) GROUP BY 1""")
def visible_records(t):
    shown = records(t).filter(br.visible(F.col("status"), F.col("classifier")))
    return shown.groupBy("release").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, count(*) AS n FROM customer WHERE (nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_mktsegment, 'BUILDING') NOT IN
('scientific_study', 'administrative')) AND NOT contains(lower(c_name), '77') GROUP BY 1""")
def sighting_locations(t):
    kind = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.filter(br.not_research(kind, F.col("c_name"), ["77"])).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND lang <> '' THEN (['kind', 'topic', 'odd'])[1 + doc_id % 3] END AS facet,
CASE WHEN doc_id % 3 < 2 AND lang <> '' THEN lang || ':x' END AS value FROM documents""")
def tag_parameters(t):
    facet = F.get(F.array(*map(F.lit, ("kind", "topic", "odd"))), (F.col("doc_id") % 3).cast("int"))
    param = F.concat(facet, F.lit(":"), "lang", F.lit(":x"))
    found = br.tag_param_column(param, ["kind", "topic"])
    return t.documents.select("doc_id", found["facet"].alias("facet"), found["value"].alias("value"))


_COMPOUNDS = {"tictac": "tic tac", "tic-tac": "tic tac", "uaps": "uap"}
check("VARCHAR", {"v": ["tictac", "Tic  Tac", "uaps", "one-two three", "", None, "x"]}, lambda v: F.array_join(br.spellings_column(v, _COMPOUNDS), "|"),
      ["tictac|tic tac|tic-tac", "Tic Tac|TicTac|Tic-Tac", "uaps|uap", "one-two three|one two three|onetwothree|one-two-three", "", "", "x"])("query_spellings")

_FOUND = """f AS (SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), '1') OR contains(lower(p_name), 'red') THEN 10 ELSE 0 END
+ CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), '1') OR contains(lower(p_type), 'red') THEN 4 ELSE 0 END AS rank FROM part)"""


def _hits(t):
    parts = t.part.withColumnRenamed("p_partkey", "id")
    tags = parts.select("id", F.lit("brand").alias("facet"), F.col("p_brand").alias("value"))
    tags = tags.union(parts.select("id", F.lit("size"), F.when(F.col("p_size") > 25, "large").otherwise("small")))
    found = br.search(parts.withColumn("p_type2", F.regexp_replace("p_type", "STEEL", "red")), {"p_name": 10, "p_type2": 4}, ["1", "red"], tags,
                      [("size", "large"), ("brand", "Brand#13")])
    return found.select("id", "rank")


@query(f"""WITH {_FOUND} SELECT id, rank FROM f JOIN part ON p_partkey = id WHERE rank > 0 AND p_size > 25 AND p_brand = 'Brand#13'""")
def search_with_tags(t):
    return _hits(t)


@query(f"""WITH {_FOUND} SELECT count(*) AS total, greatest(1, ceil(count(*) / 30))::bigint AS pages FROM f JOIN part ON p_partkey = id
WHERE rank > 0 AND p_size > 25 AND p_brand = 'Brand#13'""")
def search_totals(t):
    return br.paged(_hits(t), [F.desc("rank"), F.col("id")], 1)[1]


_NAMES = {"release": "release", "record": "record", "featured": "featured", "year": "year", "significance": "significance", "pages": "pages", "id": "id"}
_ORDERS = {
    "release": "release DESC, featured DESC, record", "incident": "coalesce(year, 0) DESC, record", "oldest": "coalesce(year, 9999), record",
    "significance": "coalesce(significance, 0) DESC, featured DESC, id", "pages": "coalesce(pages, 0) DESC, id",
    "relevance": "significance DESC NULLS LAST, release DESC, record", "no such order": "release DESC, featured DESC, record",
}


@query(f"WITH {_RECORDS} " + " UNION ALL ".join(
    f"(SELECT '{k}' AS name, row_number() OVER (ORDER BY {o}) AS pos, id FROM r ORDER BY {o} LIMIT 25)" for k, o in _ORDERS.items()))
def named_orders(t):
    """The first 25 of each order: a top-k each, without a sort of the whole table."""
    rows, out = records(t), None
    for name in _ORDERS:
        order = br.sort_order(name, _NAMES, F.col("significance"))
        top = rows.orderBy(*order).limit(25)
        top = top.select(F.lit(name).alias("name"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), "id")
        out = top if out is None else out.union(top)
    return out


@query(f"WITH {_RECORDS} SELECT id, row_number() OVER (ORDER BY year NULLS LAST, id) AS pos FROM r ORDER BY year NULLS LAST, id LIMIT 40")
def nulls_last_order(t):
    order = [F.col("year").asc_nulls_last(), F.col("id")]
    return records(t).orderBy(*order).limit(40).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))


@query("""SELECT DISTINCT c_nationkey AS source, c_custkey AS a, b FROM (SELECT *, unnest([c_custkey + 25, c_custkey * 2, c_custkey + 25]) AS b FROM customer) x
WHERE EXISTS (SELECT 1 FROM customer y WHERE y.c_custkey = x.b AND y.c_nationkey = x.c_nationkey)""")
def related_records(t):
    rows = t.customer.select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("record"),
                             F.array(F.col("c_custkey") + 25, F.col("c_custkey") * 2, F.col("c_custkey") + 25).alias("ids"))
    return br.related(rows, "source", "record", "ids")


@query("""SELECT s_suppkey AS a, s_suppkey * 3 % 97 AS b FROM supplier WHERE NOT EXISTS (SELECT 1 FROM supplier e WHERE
(e.s_suppkey = supplier.s_suppkey AND e.s_nationkey = supplier.s_suppkey * 3 % 97) OR (e.s_nationkey = supplier.s_suppkey AND e.s_suppkey = supplier.s_suppkey * 3 % 97))""")
def unrelated_pairs(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 3 % 97).alias("b"))
    return br.unrelated(pairs, t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b")))


@query("""SELECT r_regionkey, place, n_nationkey, n_name FROM (SELECT r_regionkey, unnest([r_regionkey, r_regionkey + 20, 99]) AS n_nationkey,
unnest([0, 1, 2]) AS place FROM region) LEFT JOIN nation USING (n_nationkey)""")
def listed_lookups(t):
    rows = t.region.select("r_regionkey", F.array(F.col("r_regionkey"), F.col("r_regionkey") + 20, F.lit(99)).alias("ids"))
    return br.looked_up(rows, "ids", t.nation, "n_nationkey", ["n_name"]).select("r_regionkey", "place", "n_nationkey", "n_name")


@query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 2 AND 4")
def page_range(t):
    return br.in_range(t.conversations, "turn", 2, 4).select("conv_id", "turn")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate::date::varchar LIKE '1995-%' AND o_orderpriority NOT LIKE '1%' GROUP BY 1")
def year_of_orders(t):
    rows = t.orders.filter(br.of_year(F.col("o_orderdate"), 1995) & ~F.col("o_orderpriority").like("1%"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"""WITH {_RECORDS} SELECT id, CASE WHEN media = 'pdf' AND status IN ('new', 'failed', 'unavailable') THEN CASE WHEN file IS NOT NULL THEN 'fetch' ELSE 'wait' END
WHEN media = 'pdf' AND status = 'downloaded' THEN 'extract' ELSE 'classify' END AS step FROM r WHERE status IN ('extracted', 'failed') AND (status <> 'failed' OR attempts < 5)""")
def due_records(t):
    rows = records(t).filter(lc.due(F.col("status"), F.col("attempts")))
    return rows.select("id", lc.next_step(F.col("media"), F.col("status"), F.col("file").isNotNull()).alias("step"))


@query(f"""WITH {_RECORDS} SELECT id, CASE WHEN id % 6 = 0 THEN 'failed' ELSE CASE id % 3 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'extracted' ELSE 'classified' END END AS status,
attempts + (id % 6 = 0)::int AS attempts, CASE WHEN id % 6 = 0 THEN 'E: ' || id END AS error FROM r""")
def step_outcomes(t):
    step = F.get(F.array(*map(F.lit, ("fetch", "extract", "classify"))), (F.col("id") % 3).cast("int"))
    error = F.when(F.col("id") % 6 == 0, F.concat(F.lit("E: "), "id"))
    done = lc.after_step(F.col("status"), step, error, F.col("attempts"))
    return records(t).select("id", done["status"].alias("status"), done["attempts"].alias("attempts"), done["error"].alias("error"))


@query("""SELECT p_partkey, CASE WHEN p_size > 3 THEN (100 // (p_size - 3))::varchar END AS result, p_size <= 3 AS failed FROM part""")
def isolated_failures(t):
    """A function that fails for some rows: its errors are values."""

    def share(n):
        if n <= 3:
            raise ValueError(n)
        return str(100 // (n - 3))

    found = lc.isolated(t.part.select("p_partkey", "p_size"), "p_size", share)
    return found.select("p_partkey", "result", F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {_RECORDS} SELECT id, CASE WHEN media <> 'pdf' THEN 'extracted' WHEN file IS NULL THEN 'new' ELSE 'downloaded' END AS status, 0 AS attempts FROM r""")
def reset_to_extract(t):
    return lc.reset(records(t), "extract", "file").select("id", "status", "attempts")


@query("""SELECT event_id, CASE WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead THEN ts END AS finished FROM (SELECT *,
status = 'running' AND ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 MINUTE AS dead FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'running'
ELSE 'finished' END AS status FROM events))""")
def closed_runs(t):
    runs = t.events.select("event_id", F.col("ts").alias("beat"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("finished").alias("status"),
                           F.lit(None).cast("timestamp_ntz").alias("finished"))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return lc.closed_runs(runs, now).select("event_id", "status", "finished")


@query("""SELECT max(ts) FILTER (event_type = 'view') <= TIMESTAMP '2030-01-01' - INTERVAL 6 HOUR AS due FROM events""")
def run_due(t):
    runs = t.events.select(F.col("ts").alias("started"), F.when(F.col("event_type") == "view", "finished").otherwise("failed").alias("status"))
    return lc.run_due(runs, F.lit("2030-01-01").cast("timestamp_ntz"), 6)


@query("""SELECT user_id, event_id, number FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS number FROM events)
WHERE number <= 2""")
def latest_runs(t):
    return lc.latest_runs(t.events, "event_id", ["user_id"]).select("user_id", "event_id", F.col("number").cast("long").alias("number"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey % 20 AS client, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey // 20) AS ts FROM orders)
SELECT id, n FROM (SELECT id, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM e) WHERE n >= 10""")
def failures_per_minute(t):
    """Ten or more within a minute; order keys stand for the seconds at which clients fail."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.floor(F.col("o_orderkey") / 20))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("client"), at.alias("at"))
    return lc.over_rate(rows, "client", "at").select("id", "n")


@query("""WITH RECURSIVE b AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT conv_id, turn, k, n AS used, true AS kept FROM b WHERE k = 1 UNION ALL SELECT b.conv_id, b.turn, b.k, w.used + CASE WHEN w.used + b.n <= 400 THEN b.n ELSE 0 END,
w.used + b.n <= 400 FROM w JOIN b ON b.conv_id = w.conv_id AND b.k = w.k + 1) SELECT conv_id, turn FROM w WHERE kept""")
def budgeted_pages(t):
    return lc.budgeted(t.conversations, "conv_id", "turn", "text", 400).select("conv_id", "turn")


@query(f"""WITH {_RECORDS} SELECT count(*) FILTER (classifier = 'rules' AND attempts < 3) AS by_rules,
count(*) FILTER (coalesce(classifier <> 'm1', true) AND NOT coalesce(title LIKE '1%', false)) AS by_model FROM r""")
def stale_classifications(t):
    model = F.when(F.col("title").like("1%"), "m1")
    rules = br.stale(F.col("classifier"), F.col("attempts"), model, None, 3)
    with_model = br.stale(F.col("classifier"), F.col("attempts"), model, "m1", 3)
    return records(t).agg(F.count_if(rules).alias("by_rules"), F.count_if(with_model).alias("by_model"))


@query("""SELECT key, CASE WHEN any_value(doc_id % 2) IS NOT NULL AND bool_or(doc_id % 2 = 0) THEN 'cached' ELSE 'fresh' END AS origin FROM
(SELECT doc_id, substr(sha256('v1|' || length(text) || ':' || text), 1, 16) AS key FROM documents) GROUP BY 1""")
def memoised_texts(t):
    keyed = t.documents.select("doc_id", tx.text_hash(F.array("text"), "v1").alias("key"))
    cache = keyed.filter("doc_id % 2 = 0").select("key", F.lit("cached").alias("origin")).distinct()
    return lc.memoised(keyed.select("key"), cache, "key", lambda misses: misses.withColumn("origin", F.lit("fresh")))[0]
