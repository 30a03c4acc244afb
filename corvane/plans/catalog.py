"""Registered queries of the core engine, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions import metadata as md
from corvane.functions import segments as sg
from corvane.functions import spans as sp
from corvane.functions import text as tx
from corvane.operators import episodes as ep
from corvane.operators import patterns as pt
from corvane.operators import relational as rel
from corvane.operators import selection as sel
from corvane.operators import statistics as st
from corvane.operators import summaries as sm
from corvane.sources import listing as ls
from corvane.storage import dealt, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries that SQL cannot express; tests check their operators.
WITHOUT_SQL = {"passage_segments", "degree_limited_links", "seeded_sample"}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query("""SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def facet_browse(t):
    tagged = rel.having_tags(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k",
                             [F.col("l_returnflag") == "R"])
    return rel.facet_counts(tagged, "o_orderpriority", "k").orderBy(F.desc("n"), "o_orderpriority")


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(DISTINCT o_custkey) AS customers,
min(o_orderdate)::date::varchar AS first_day, max(o_orderdate)::date::varchar AS last_day FROM orders""")
def overview_totals(t):
    return t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
                        F.countDistinct("o_custkey").alias("customers"), F.to_date(F.min("o_orderdate")).cast("string").alias("first_day"),
                        F.to_date(F.max("o_orderdate")).cast("string").alias("last_day"))


@query("""SELECT row_number() OVER (ORDER BY m) AS number, * FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m,
count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
count(*) FILTER (o_orderstatus = 'P') AS p, sum(o_custkey % 50)::bigint AS pages FROM orders GROUP BY 1)""")
def release_media_pivot(t):
    counts = [F.count_if(F.col("o_orderstatus") == k).alias(k.lower()) for k in "FOP"]
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(*counts, F.sum(F.col("o_custkey") % 50).alias("pages"))
    # One row for each release, so the window over all of them is small.
    return months.withColumn("number", F.row_number().over(Window.orderBy("m")))


@query("""SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) d(kind)
LEFT JOIN (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) USING (kind)""")
def enum_zero_fill(t):
    kinds = t.spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "never")], "kind string")
    counts = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10""")
def top_locations(t):
    rows = t.customer.filter("c_mktsegment <> 'BUILDING'").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name").limit(10)


_RANK = """CASE WHEN contains(lower(p_name), '1') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), 'e') THEN 4 ELSE 0 END
+ CASE WHEN contains(lower(p_brand), '1') THEN 1 ELSE 0 END"""


def _search(t):
    rank = rel.relevance([(F.col("p_name"), 10)], ["1"]) + rel.relevance([(F.col("p_type"), 4)], ["e"])
    return t.part.withColumn("rank", rank + rel.relevance([(F.col("p_brand"), 1)], ["1"])).filter("rank > 0")


@query(f"""SELECT * FROM (SELECT p_partkey, {_RANK} AS rank FROM part) WHERE rank > 0""")
def search_ranked(t):
    return _search(t).select("p_partkey", "rank")


@query(f"""SELECT * FROM (SELECT p_partkey, {_RANK} AS rank FROM part) WHERE rank > 0 ORDER BY rank DESC, p_partkey
LIMIT 30 OFFSET 60""")
def search_paged(t):
    return rel.page(_search(t).select("p_partkey", "rank"), [F.desc("rank"), F.col("p_partkey")], 3, 30)


@query("""SELECT doc_id, substr(text, greatest(instr(lower(text), 'license') - 30, 1), 80) AS snippet FROM documents
WHERE instr(lower(text), 'license') > 0""")
def snippet_first_hit(t):
    return t.documents.select("doc_id", tx.snippet(F.col("text"), "license").alias("snippet")).filter("snippet is not null")


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderstatus = 'P' DESC, o_totalprice DESC, o_orderkey LIMIT 12""")
def highlight_topk(t):
    order = [F.desc(F.col("o_orderstatus") == "P"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return t.orders.orderBy(*order).limit(12).select("o_orderkey", "o_orderpriority")


@query("""SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem
WHERE l_quantity >= 45 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01'""")
def evidence_intersect(t):
    units = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    units = units.intersect(t.lineitem.filter("l_quantity >= 45").select("l_orderkey"))
    return units.intersect(t.orders.filter("o_orderdate >= timestamp_ntz'1998-01-01'").select("o_orderkey"))


@query("""SELECT l_shipdate::date::varchar AS d FROM lineitem UNION SELECT o_orderdate::date::varchar FROM orders""")
def all_units_union(t):
    return t.lineitem.select(F.to_date("l_shipdate").cast("string").alias("d")).union(t.orders.select(F.to_date("o_orderdate").cast("string"))).distinct()


@query("""SELECT l_shipdate::date::varchar AS d FROM lineitem EXCEPT SELECT o_orderdate::date::varchar FROM orders""")
def new_dates_except(t):
    return t.lineitem.select(F.to_date("l_shipdate").cast("string").alias("d")).subtract(t.orders.select(F.to_date("o_orderdate").cast("string").alias("d")))


@query("""WITH n AS (SELECT o_orderkey AS k, concat_ws('|', o_orderstatus, o_orderpriority) AS h, o_orderpriority AS f FROM orders
WHERE o_orderkey % 7 <> 0),
s AS (SELECT o_orderkey AS k, concat_ws('|', CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END) AS h,
  CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS f,
  CASE WHEN o_orderkey % 2 = 0 THEN 'classified' ELSE 'failed' END AS status FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, action, CASE WHEN action = 'insert' THEN 'new' WHEN action = 'update' AND nf <> sf THEN 'new'
  WHEN action = 'update' AND status = 'classified' THEN 'extracted' ELSE status END AS next_status
FROM (SELECT coalesce(n.k, s.k) AS k, n.f AS nf, s.f AS sf, status, CASE WHEN s.k IS NULL THEN 'insert'
  WHEN n.k IS NULL THEN 'keep' WHEN n.h = s.h THEN 'unchanged' ELSE 'update' END AS action FROM n FULL JOIN s ON n.k = s.k)""")
def listing_upsert_diff(t):
    key = F.col("o_orderkey")
    listing = t.orders.filter(key % 7 != 0).select(
        key.alias("k"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("row_hash"), F.col("o_orderpriority").alias("file_hash"))
    file = F.when(key % 11 == 0, "X").otherwise(F.col("o_orderpriority"))
    stored = t.orders.filter(key % 3 != 0).select(
        key.alias("k"), F.concat_ws("|", F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus")), file).alias("row_hash"),
        file.alias("file_hash"), F.when(key % 2 == 0, "classified").otherwise("failed").alias("status"))
    return rel.upsert_diff(listing, stored, "k")


@query("""SELECT p_partkey, CASE WHEN nth = 1 THEN k ELSE k || '#' || nth END AS id FROM (SELECT p_partkey,
upper(p_brand) AS k, row_number() OVER (PARTITION BY upper(p_brand) ORDER BY p_partkey) AS nth FROM part)""")
def duplicate_id_numbering(t):
    return rel.number_repeats(t.part, F.upper("p_brand"), [F.col("p_partkey")], "id").select("p_partkey", "id")


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) >= 4 AS shared FROM documents""")
def shared_description(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.select("doc_id", (F.count("*").over(Window.partitionBy("h")) >= 4).alias("shared"))


@query("""SELECT o_orderkey, make_date(y, m, 1 + o_orderkey % 28)::varchar AS d FROM (SELECT o_orderkey, 1 + o_orderkey % 12 AS m,
CASE WHEN o_orderkey % 100 <= 26 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS y FROM orders)""")
def us_date_pivot(t):
    k = F.col("o_orderkey")
    value = F.concat_ws("/", k % 12 + 1, k % 28 + 1, F.lpad((k % 100).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", tx.us_date(value, 2026).cast("string").alias("d"))


@query("""SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?:^|[^0-9])((?:18|19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS int) AS y
FROM documents""")
def year_parse(t):
    return t.documents.select("doc_id", tx.first_year_in_text(F.col("text")).alias("y"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[\x00\r]', '', 'g'),
chr(10)), lambda l: regexp_replace(regexp_replace(l, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'),
'^\s+|\s+$', '', 'g')) AS h FROM documents""")
def text_clean(t):
    return t.documents.select("doc_id", F.sha2(tx.clean_text(F.col("text")), 256).alias("h"))


@query(r"""SELECT doc_id, round_even(coalesce(len(list_filter(w, lambda x: regexp_full_match(trim(x, '.,;:()[]"''!?-'), '[A-Za-z]{2,}')))
/ nullif(len(w), 0), 0), 6) AS quality FROM (SELECT doc_id, regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+') AS w
FROM documents)""")
def text_quality(t):
    return t.documents.select("doc_id", F.bround(tx.text_quality(F.col("text")), 6).alias("quality"))


@query("""SELECT conv_id, sha256(string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS h,
count(*) AS pages FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def page_concat(t):
    pages = t.conversations.filter(F.trim("text") != "").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(F.lit("[Page "), x["turn"].cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return pages.select("conv_id", F.sha2(joined, 256).alias("h"), F.size("p").cast("long").alias("pages"))


@query("""WITH h AS (SELECT doc_id,
len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('license', 'copyright', 'email', 'token', 'the'))) AS hits FROM documents) SELECT doc_id, hits FROM h WHERE hits >= 4""")
def vocab_hits_filter(t):
    hits = lx.vocabulary_hits(F.col("text"), "license|copyright|email|token|the").cast("long")
    return t.documents.select("doc_id", hits.alias("hits")).filter("hits >= 4")


_KINDS = [("STEEL", "metal"), ("BRASS|COPPER", "alloy"), ("PROMO", "offer"), ("#1", "first")]


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'video' WHEN regexp_matches(p_type, 'STEEL') THEN 'metal' WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'alloy'
WHEN regexp_matches(p_type, 'PROMO') THEN 'offer' WHEN regexp_matches(p_name, 'STEEL') THEN 'metal' WHEN regexp_matches(p_brand, '#1') THEN 'first' ELSE 'other' END AS kind FROM part""")
def ordered_rule_kind(t):
    """The medium decides first, then rules on the type, then on name and brand, else other."""
    media = F.when(F.col("p_size") % 10 == 0, "video")
    ruled = md.first_rule(_KINDS, F.col("p_type"), F.concat_ws("\n", "p_name", "p_brand"), default="other")
    return t.part.select("p_partkey", F.coalesce(media, ruled).alias("kind"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(source, '7|license') OR regexp_matches(source, '^src1') OR a >= bar THEN 'legal' END,
CASE WHEN regexp_matches(source, 'token') OR (b >= bar AND 1940 + doc_id % 60 >= 1965) THEN 'sensor' END, CASE WHEN regexp_matches(source, ' [a-e]') OR c >= bar THEN 'early' END) AS labels
FROM (SELECT doc_id, source, len(regexp_extract_all(text, '7|license')) AS a, len(regexp_extract_all(text, 'token|[0-9]{3}')) AS b,
len(regexp_extract_all(text, ' [a-e]')) AS c, greatest(3, length(text) // 20000) AS bar FROM documents)""")
def multi_label_rules(t):
    rules = [rel.LabelRule("legal", "7|license", meta="^src1"), rel.LabelRule("sensor", "token|[0-9]{3}", since=1965), rel.LabelRule("early", " [a-e]")]
    labels = rel.multi_label(rules, F.col("source"), F.col("text"), 1940 + F.col("doc_id") % 60)
    return t.documents.select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("""SELECT DISTINCT page_id, replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '&amp;', '&') AS link FROM pages""")
def link_discovery(t):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return t.pages.select("page_id", F.explode(links).alias("link")).withColumn("link", F.replace("link", F.lit("&amp;"), F.lit("&"))).distinct()


@query("""SELECT event_type, count(DISTINCT (user_id, hour(ts))) AS units, count(DISTINCT user_id) AS users,
min(ts)::date::varchar AS first_day, max(ts)::date::varchar AS last_day FROM events GROUP BY 1""")
def detail_summary(t):
    return t.events.groupBy("event_type").agg(
        F.countDistinct("user_id", F.hour("ts")).alias("units"), F.countDistinct("user_id").alias("users"),
        F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"))


@query("""WITH r AS (SELECT DISTINCT user_id, event_type, day(ts)::int AS d FROM events),
tot AS (SELECT d, count(DISTINCT user_id) AS total FROM r GROUP BY 1), c AS (SELECT event_type, d, count(*) AS c FROM r GROUP BY 1, 2),
k AS (SELECT event_type FROM r GROUP BY 1 HAVING count(*) >= 5)
SELECT event_type, d, coalesce(c, 0) AS n, round_even(coalesce(c, 0) / total, 6) AS share FROM k CROSS JOIN tot LEFT JOIN c USING (event_type, d)""")
def detail_by_period(t):
    return st.item_by_period(t.events.withColumn("d", F.dayofmonth("ts")), "user_id", "event_type", "d")


@query("""WITH p AS (SELECT DISTINCT (user_id * 100 + day(ts)) AS u, event_type AS i FROM events), s AS (SELECT i, count(*) AS c FROM p GROUP BY 1),
n AS (SELECT count(DISTINCT u) AS n FROM p), b AS (SELECT x.i AS a, y.i AS b, count(*) AS n_both FROM p x JOIN p y ON x.u = y.u AND x.i < y.i
GROUP BY 1, 2 HAVING count(*) >= 4) SELECT a, b, n_both, round_even(n_both * n / (sa.c * sb.c), 6) AS lift
FROM b JOIN s sa ON sa.i = a JOIN s sb ON sb.i = b CROSS JOIN n""")
def cooccurrence_lift(t):
    return st.cooccurrence(t.events.withColumn("u", F.col("user_id") * 100 + F.dayofmonth("ts")), "u", "event_type")


@query("""SELECT d, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(d), max(d) + 1)) AS d FROM (SELECT date_diff('day', DATE '1990-01-01', l_shipdate::date)
AS d FROM lineitem WHERE l_quantity > 49)) LEFT JOIN (SELECT date_diff('day', DATE '1990-01-01', l_shipdate::date) AS d, count(*) AS n FROM lineitem
WHERE l_quantity > 49 AND l_linenumber = 7 GROUP BY 1) USING (d)""")
def dense_timeline(t):
    """Days without a line stay, with zero: the calendar spans all large lines, the counts only the seventh ones."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("d")
    large = t.lineitem.filter("l_quantity > 49").select(days, "l_linenumber")
    return st.dense_calendar(large.groupBy("d").agg(F.count_if(F.col("l_linenumber") == 7).alias("n")), "d")


@query("""WITH c AS (SELECT date_diff('month', DATE '1990-01-01', o_orderdate::date) AS s, count(*) FILTER (o_orderkey % 50 < 10
OR month(o_orderdate) = 7) AS n FROM orders GROUP BY 1), b AS (SELECT a.s, a.n, median(z.n) AS base FROM c a JOIN c z
ON abs(a.s - z.s) <= 10 AND abs(a.s - z.s) > 1 GROUP BY 1, 2), h AS (SELECT *, s - row_number() OVER (ORDER BY s) AS island FROM b
WHERE n >= 10 AND n >= 2.5 * base + 3) SELECT min(s) AS first, max(s) AS last, sum(n)::bigint AS total,
arg_min(s, (-n, s)) AS peak, max(base) AS baseline FROM h GROUP BY island""")
def wave_islands(t):
    months = F.months_between(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), F.lit("1990-01-01").cast("timestamp")).cast("long")
    strong = (F.col("o_orderkey") % 50 < 10) | (F.month("o_orderdate") == 7)
    counts = t.orders.groupBy(months.alias("s")).agg(F.count_if(strong).alias("n"))
    return st.waves(st.dense_calendar(counts, "s"), "s")


@query("""SELECT r_name, n_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1, 2""")
def place_grid(t):
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return places.join(counts, "n_nationkey", "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS k, p_brand || '/' || p_size AS i, o_orderpriority = '1-URGENT' AS g FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN orders ON o_orderkey = l_orderkey), s AS (SELECT count(DISTINCT k) FILTER (g) AS ni, count(DISTINCT k) FILTER (NOT g) AS no FROM r),
c AS (SELECT i, count(*) FILTER (g) AS c_in, count(*) FILTER (NOT g) AS c_out FROM r GROUP BY 1)
SELECT i AS item, c_in, c_out, round_even((c_in * no) / (greatest(c_out, 1) * ni), 6) AS lift FROM c, s
WHERE ni >= 8 AND no >= 8 AND c_in >= 3 AND (c_in * no) / (greatest(c_out, 1) * ni) >= 1.3 ORDER BY lift DESC, c_in DESC, i LIMIT 8""")
def lift_rows(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    n = lines.count()
    rows = dealt(lines, "l_partkey", rows=n).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = dealt(rows.select("l_orderkey", "p_brand", "p_size"), "l_orderkey", rows=n)
    rows = rows.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("g", F.col("o_orderpriority") == "1-URGENT")
    return st.lift_rows(rows.withColumn("item", F.concat_ws("/", "p_brand", "p_size")), "l_orderkey", "item", "g")


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O,
round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS share_F, round_even(count(*) FILTER (o_orderstatus = 'O') / count(*), 3) AS share_O FROM orders GROUP BY 1""")
def split_by(t):
    return sm.split_by(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O"])


@query("""SELECT p_type, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1
ORDER BY n DESC, p_type LIMIT 6""")
def top_rows(t):
    counts = t.part.groupBy("p_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("s"))
    return counts.join(F.broadcast(total)).select("p_type", "n", F.bround(F.col("n") / F.col("s"), 6).alias("share")).orderBy(F.desc("n"), "p_type").limit(6)


# Orders as accounts, their parts as tags, customers as series: all line items.
_TAGS = """tags AS (SELECT DISTINCT l_orderkey AS r, o_custkey AS g, l_partkey AS tag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT tag, count(*) AS df, ln(greatest((SELECT count(DISTINCT r) FROM tags), 2) / count(*)) AS w FROM tags GROUP BY 1),
norm AS (SELECT r, sqrt(sum(w * w)) AS norm FROM tags JOIN w USING (tag) GROUP BY 1),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS n_shared, sum(w) AS e, sum(w * w) AS d FROM tags x JOIN tags y ON x.tag = y.tag AND x.r < y.r
AND x.g <> y.g JOIN w ON w.tag = x.tag GROUP BY 1, 2 HAVING count(*) >= 2),
scored AS (SELECT a, b, n_shared, e * d / (na.norm * nb.norm) AS score FROM pairs JOIN norm na ON na.r = a JOIN norm nb ON nb.r = b
WHERE e * d / (na.norm * nb.norm) >= 5)"""


def _tags(t):
    rows = dealt(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("l_orderkey").alias("r"), F.col("o_custkey").alias("g"), F.col("l_partkey").alias("tag")).distinct()


def _pairs(t):
    return pt.similar_pairs(_tags(t), "r", "tag", "g").withColumn("score", F.bround("score", 5))


@query(f"""WITH {_TAGS} SELECT tag, df, round_even(w, 4) AS w FROM w""")
def tag_weights(t):
    return pt.tag_weights(_tags(t), "r", "tag", digits=4)


@query(f"""WITH {_TAGS} SELECT a, b, n_shared, round_even(score, 5) AS score FROM scored""")
def pair_scores(t):
    return _pairs(t)


@query(f"""WITH {_TAGS}, s AS (SELECT a, b, round_even(score, 5) AS score FROM scored), u AS (SELECT a, b, score FROM s UNION ALL SELECT b, a, score FROM s)
SELECT a, b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM u) WHERE rank <= 6""")
def top6_similar(t):
    return pt.top_partners(_pairs(t))


# Orders as accounts, customers in 200 groups as records; two of the four dimensions go together in every second order.
_COMBO = """t AS (SELECT DISTINCT l_orderkey AS account, o_custkey % 200 AS record, dim, tag FROM (SELECT l_orderkey, o_custkey, unnest(['shape', 'motion', 'sound', 'colour']) AS dim,
unnest(['s' || l_partkey % 17, 'm' || CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 13 ELSE l_suppkey % 13 END, 'q' || (l_quantity::int % 11), 'c' || l_linenumber]) AS tag
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
n AS (SELECT count(DISTINCT account) AS n FROM t), w AS (SELECT tag, ln(n / count(*)) AS w FROM t, n GROUP BY tag, n),
s AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round_even(w, 4) DESC, tag) AS k FROM t JOIN w USING (tag) QUALIFY k <= 10),
p AS (SELECT tag, count(*) AS p FROM s GROUP BY 1),
ok AS (SELECT * FROM s WHERE NOT (tag = 'q0' AND account IN (SELECT account FROM t WHERE tag = 's3'))),
c AS (SELECT a.account, a.record, a.tag AS t1, b.tag AS t2, NULL AS t3, [a.dim, b.dim] AS dims, [a.tag, b.tag] AS tags FROM ok a JOIN ok b ON a.account = b.account AND a.tag < b.tag AND a.dim <> b.dim
UNION ALL SELECT a.account, a.record, a.tag, b.tag, c.tag, [a.dim, b.dim, c.dim], [a.tag, b.tag, c.tag] FROM ok a JOIN ok b ON a.account = b.account AND a.tag < b.tag AND a.dim <> b.dim
JOIN ok c ON c.account = a.account AND b.tag < c.tag AND c.dim <> a.dim AND c.dim <> b.dim),
m AS (SELECT t1, t2, t3, count(*) AS m, count(DISTINCT record) AS r FROM c WHERE list_has_any(dims, ['motion', 'sound']) AND
len(list_filter(list_zip(dims, tags), lambda z: z[1] IN ('shape', 'motion') AND z[2] <> 'm0')) > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 6 AND count(DISTINCT record) >= 3),
f AS (SELECT t1, t2, t3, m, m.r, CASE WHEN t3 IS NULL THEN m / (p1.p * p2.p / n) ELSE m / ((p1.p * p2.p / n) * p3.p / n) END AS lift
FROM m CROSS JOIN n JOIN p p1 ON p1.tag = t1 JOIN p p2 ON p2.tag = t2 LEFT JOIN p p3 ON p3.tag = t3)"""


def _combo_tags(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    rows = dealt(lines, "l_orderkey").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    key, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    tags = {"shape": F.concat(F.lit("s"), part % 17), "motion": F.concat(F.lit("m"), F.when(key % 2 == 0, part % 13).otherwise(supp % 13)),
            "sound": F.concat(F.lit("q"), F.col("l_quantity").cast("int") % 11), "colour": F.concat(F.lit("c"), "l_linenumber")}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), x.alias("tag")) for d, x in tags.items()]))
    out = rows.select(key.alias("account"), (F.col("o_custkey") % 200).alias("record"), each.alias("x")).select("account", "record", "x.dim", "x.tag").distinct()
    weights = written(pt.tag_weights(out, "account", "tag", digits=4).drop("df"), "weights")
    return out.join(F.broadcast(weights), "tag")  # 48 tags


@query(f"""WITH {_COMBO} SELECT t1, t2, t3, m, r, round_even(lift, 6) AS lift, round_even(ln(lift) * r * CASE WHEN t3 IS NULL THEN 1 ELSE 1.2 END, 5) AS score FROM f WHERE lift >= 1.6""")
def combos_lift(t):
    out = pt.combinations(_combo_tags(t), ["shape", "motion"], ["motion", "sound"], ["m0"], {"q0": ["s3"]})
    return out.withColumns({"lift": F.bround("lift", 6), "score": F.bround("score", 5)})


@query("""SELECT user_id, CASE WHEN y > n THEN 'explained' WHEN n > y THEN 'unresolved' END AS verdict, last_kind FROM (SELECT user_id,
count(*) FILTER (event_type IN ('click', 'view')) AS y, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n,
arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY 1)""")
def verdict_majority(t):
    mild = F.col("event_type").isin("click", "view")
    rows = t.events.groupBy("user_id").agg(F.count_if(mild).alias("y"), F.count_if(~mild).alias("n"),
                                           F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))
    verdict = F.when(F.col("y") > F.col("n"), "explained").when(F.col("n") > F.col("y"), "unresolved")
    return rows.select("user_id", verdict.alias("verdict"), "last_kind")


@query("""SELECT tier, o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN m / c >= 0.5 THEN 'heavy' WHEN m > 0 THEN 'marked'
WHEN o_orderstatus = 'P' THEN 'flag only' ELSE 'none' END AS tier FROM orders JOIN (SELECT l_orderkey, count(*) AS c,
count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1, 2""")
def tier_split(t):
    marks = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("m"))
    rows = t.orders.join(marks, F.col("o_orderkey") == F.col("l_orderkey"))
    tier = (F.when(F.col("m") / F.col("c") >= 0.5, "heavy").when(F.col("m") > 0, "marked")
            .when(F.col("o_orderstatus") == "P", "flag only").otherwise("none"))
    return rows.groupBy(tier.alias("tier"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(r_name, 'total') AS r_name, n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchy_rollup(t):
    rows = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    tree = rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"))
    return tree.withColumn("r_name", F.coalesce("r_name", F.lit("total")))


@query("""WITH rules(pos, key, want, banned) AS (VALUES (1, 'steel-small', 'STEEL', 'PROMO'), (2, 'promo', 'PROMO', 'NONE'), (3, 'steel', 'STEEL', 'NONE'))
SELECT p_partkey, arg_min(key, pos) AS sub FROM part JOIN rules ON contains(p_type, want) AND NOT contains(p_type, banned) GROUP BY 1""")
def subcategory_first_match(t):
    rules = t.spark.createDataFrame([(1, "steel-small", "STEEL", "PROMO"), (2, "promo", "PROMO", "NONE"), (3, "steel", "STEEL", "NONE")],
                                    "pos int, key string, want string, banned string")
    hit = F.contains("p_type", "want") & ~F.contains("p_type", "banned")
    return t.part.join(F.broadcast(rules), hit).groupBy("p_partkey").agg(F.min_by("key", "pos").alias("sub"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC,
o_orderkey) AS a FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1))
ORDER BY (a <> 1)::int, o_totalprice DESC, o_orderkey LIMIT 12""")
def diverse_examples(t):
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return rel.diverse_picks(t.orders, "o_custkey", "o_orderpriority", order, 12).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS low, median(l_quantity) AS middle FROM lineitem GROUP BY 1""")
def medians(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("low"), F.median("l_quantity").alias("middle"))


@query("""SELECT doc_id, substr(sha256('v1|' || text), 1, 16) AS key FROM documents WHERE substr(sha256('v1|' || text), 1, 16) NOT IN
(SELECT substr(sha256('v1|' || text), 1, 16) FROM documents WHERE doc_id % 2 = 0)""")
def cache_misses(t):
    keyed = t.documents.select("doc_id", F.left(F.sha2(F.concat(F.lit("v1|"), "text"), 256), F.lit(16)).alias("key"))
    return keyed.join(keyed.filter("doc_id % 2 = 0").select("key"), "key", "left_anti")


@query("""SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, k""")
def stale_sessions(t):
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return found.drop("w")


@query("""SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING
AND CURRENT ROW) AS n FROM events) WHERE n >= 6""")
def rate_limit_window(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86399999999, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("n")).filter("n >= 6")


_SPAN_RULES = [sp.Rule("license", "licen[sc]e", "legal"), sp.Rule("contact", "[a-z0-9.]+@[a-z0-9.]+", "person"), sp.Rule("number", "[0-9]{3,}", "figure")]


@query("""SELECT doc_id, key, length(before) AS start, length(before) + length(hit) AS stop, hit AS match FROM (SELECT doc_id, key,
regexp_extract(text, '^(.*?)' || p, 1, 'is') AS before, regexp_extract(text, p, 0, 'i') AS hit FROM documents,
(VALUES ('license', 'licen[sc]e'), ('contact', '[a-z0-9.]+@[a-z0-9.]+'), ('number', '[0-9]{3,}')) r(key, p)) WHERE hit <> ''""")
def first_spans(t):
    found = sp.find_spans(t.documents.select("doc_id", "text"), "text", sp.Engine(_SPAN_RULES))
    rows = found.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.key", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), "s.match")


@query(None)
def passage_segments(t):
    """Sentence packing restarts its sum where a passage is full; tests compare with the text's words."""
    rows = sg.segment(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", "seq", F.length("passage").cast("long").alias("n_chars"), F.sha2("passage", 256).alias("h"))


@query(r"""SELECT doc_id, round_even(CASE WHEN len(w) > 0 THEN greatest(len(list_filter(w, lambda x: regexp_matches(x,
'^[("''“‘]?([A-Za-z]+([''’-][A-Za-z]+)*|[0-9]{1,4}([.,:/-][0-9]{1,4})*)[)"''”’.,;:!?%]{0,3}$'))) / len(w)
- 4 * len(regexp_extract_all(text, '[^A-Za-z0-9\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}.,;:!?''"()\-–/%$&]')) / length(text), 0) ELSE 0 END, 3) AS readability
FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+') AS w FROM documents)""")
def readability(t):
    return t.documents.select("doc_id", sg.readability(F.col("text")).alias("readability"))


@query("""SELECT doc_id, sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 800) || chr(10) || chr(10) || '[... ' ||
format('{:,}', length(text) - 1000) || ' characters omitted ...]' || chr(10) || chr(10) || right(text, 200) ELSE text END) AS h FROM documents""")
def head_and_tail(t):
    return t.documents.select("doc_id", F.sha2(sg.head_and_tail(F.col("text"), 1000), 256).alias("h"))


@query("""SELECT user_id, d, CASE WHEN list_has_any(tags, ['error']) THEN 'space' WHEN list_has_any(tags, ['purchase', 'signup']) THEN 'traces'
WHEN user_id % 3 < 2 AND d % 2 = 0 AND NOT list_has_any(tags, ['view']) THEN 'sensor' ELSE 'sighting' END AS class FROM
(SELECT user_id, day(ts) AS d, list(DISTINCT event_type) AS tags FROM events GROUP BY 1, 2)""")
def episode_classes(t):
    tags = t.events.groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(F.collect_set("event_type").alias("tags"))
    table = [("space", ["error"]), ("traces", ["purchase", "signup"])]
    media = F.get(F.array(*map(F.lit, ("video", "image", "pdf"))), (F.col("user_id") % 3).cast("int"))
    page = (F.col("d") % 2).cast("int")
    return tags.select("user_id", "d", ep.episode_class(F.col("tags"), media, page, table, witness=["view"]).alias("class"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r AS (SELECT k, doc_id, n AS held, 1 AS batch FROM d WHERE k = 1 UNION ALL SELECT d.k, d.doc_id,
CASE WHEN r.held > 0 AND r.held + d.n > 140000 THEN d.n ELSE r.held + d.n END,
r.batch + CASE WHEN r.held > 0 AND r.held + d.n > 140000 THEN 1 ELSE 0 END FROM r JOIN d ON d.k = r.k + 1)
SELECT doc_id, batch FROM r""")
def reading_batches(t):
    return sel.batches(t.documents.select("doc_id", "n_chars"), [F.col("doc_id")], "n_chars", 140_000).select("doc_id", "batch")


def _scored(t):
    return _pairs(t).select("a", "b", "score")


@query(f"""WITH RECURSIVE {_TAGS}, s AS (SELECT a, b, row_number() OVER (ORDER BY round_even(score, 5) DESC, a, b) AS k FROM scored),
g AS (SELECT 0::bigint AS k, []::bigint[] AS ua, []::bigint[] AS ub, NULL::bigint AS a, NULL::bigint AS b UNION ALL
SELECT m.k, list_append(g.ua, s.a), list_append(g.ub, s.b), s.a, s.b FROM g, LATERAL (SELECT min(k) AS k FROM s WHERE s.k > g.k
AND NOT list_contains(g.ua, s.a) AND NOT list_contains(g.ub, s.b)) m JOIN s ON s.k = m.k WHERE len(g.ua) < 8)
SELECT a, b FROM g WHERE a IS NOT NULL""")
def greedy_matches(t):
    return sel.matched_pairs(_scored(t)).select("a", "b")


@query(None)
def degree_limited_links(t):
    """Which link stays depends on all stronger ones; tests check small cases."""
    return sel.degree_limited(_scored(t))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS nth FROM (SELECT event_id, user_id,
row_number() OVER (ORDER BY event_id) - 1 AS k, greatest(1, count(*) OVER () // 10) AS step FROM events) WHERE k % step = 0)
WHERE nth = 1 ORDER BY k LIMIT 10""")
def spread_picks(t):
    return sel.spread(t.events.select("event_id", "user_id"), "user_id", [F.col("event_id")], 10)


@query("""SELECT m, round_even(sum(w), 6) AS reports FROM (SELECT m, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w FROM
(SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m') AS m FROM lineitem)) GROUP BY 1""")
def weighted_timeline(t):
    months = t.lineitem.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("m")).distinct()
    per = months.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("l_orderkey")))
    return per.groupBy("m").agg(F.bround(F.sum("w"), 6).alias("reports"))


@query("""SELECT coalesce(l.k, o.k) AS k, coalesce(l.n, 0) AS lines, coalesce(o.y, 0) AS y FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem
WHERE l_quantity > 45 GROUP BY 1) l FULL JOIN (SELECT o_orderkey AS k, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F') o ON l.k = o.k""")
def unit_attributes(t):
    lines = t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    years = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    return lines.join(years, "k", "full_outer").select("k", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("y", F.lit(0)).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 40 THEN l_returnflag END, page) AS verdict FROM lineitem LEFT JOIN
(SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS page FROM lineitem
WHERE l_quantity > 30 GROUP BY 1) ON k = l_orderkey""")
def own_or_agreed_verdict(t):
    stated = t.lineitem.filter("l_quantity > 30").groupBy("l_orderkey")
    agreed = stated.agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    agreed = agreed.select("l_orderkey", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("page"))
    own = F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))
    return t.lineitem.join(agreed, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(own, "page").alias("verdict"))


@query("""SELECT m, CASE WHEN n_name IN (SELECT n_name FROM (SELECT n_name, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY c DESC, n_name LIMIT 4)) THEN n_name ELSE 'Other' END AS agency, count(*) AS n
FROM (SELECT strftime(o_orderdate, '%Y') AS m, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
GROUP BY 1, 2""")
def release_shares(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    counts = rows.groupBy(F.date_format("o_orderdate", "yyyy").alias("m"), "n_name").agg(F.count("*").alias("c"))
    top = counts.groupBy("n_name").agg(F.sum("c").alias("s")).orderBy(F.desc("s"), "n_name").limit(4).select("n_name", F.lit(True).alias("top"))
    named = counts.join(F.broadcast(top), "n_name", "left")
    return named.groupBy("m", F.when(F.col("top"), F.col("n_name")).otherwise("Other").alias("agency")).agg(F.sum("c").alias("n"))


@query(f"""WITH {_TAGS} SELECT ga, gb, count(*) AS n, max(round_even(score, 5)) AS best, arg_min(a || '/' || b, (-round_even(score, 5), a, b)) AS pair
FROM (SELECT least(x.o_custkey % 25, y.o_custkey % 25) AS ga, greatest(x.o_custkey % 25, y.o_custkey % 25) AS gb, a, b, score FROM scored
JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b) GROUP BY 1, 2""")
def best_pair_per_group(t):
    of = t.orders.select("o_orderkey", F.col("o_custkey") % 25)
    rows = _scored(t).join(of.toDF("a", "na"), "a").join(of.toDF("b", "nb"), "b")
    return pt.best_per_group(rows, "na", "nb").select("ga", "gb", "n", "best", F.concat_ws("/", "a", "b").alias("pair"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS nth FROM (SELECT event_id, user_id,
row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS k, greatest(1, count(*) OVER () // 25) AS step FROM events) WHERE k % step = 0)
WHERE nth = 1 ORDER BY k LIMIT 25""")
def spread_by_time(t):
    return sel.spread(t.events.select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.col("event_id")], 25).select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, 'new' AS flag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT l_orderkey, l_linenumber, 'old' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def replaced_children(t):
    children = dealt(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey")
    fresh = children.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return ep.merged_latest(children.withColumn("flag", F.lit("old")), fresh.withColumn("flag", F.lit("new")), "l_orderkey")


@query("""SELECT k, len(list_intersect(a, b)) AS both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset,
round_even(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT l_suppkey AS k, list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS a,
list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A' AND l_quantity > 40) AS b FROM lineitem GROUP BY 1) WHERE len(a) > 0 AND len(b) > 0""")
def item_set_algebra(t):
    of = lambda flag: F.collect_set(F.when((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 40), F.col("l_linenumber")))
    sets = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(of("R").alias("a"), of("A").alias("b")).filter("size(a) > 0 and size(b) > 0")
    out = sets.select("k", rel.set_algebra(F.col("a"), F.col("b")).alias("s")).select("k", "s.*")
    return out.withColumns({"both": F.col("both").cast("long"), "only_a": F.col("only_a").cast("long")})


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_orderkey) AS n FROM
(SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 20) ON l_orderkey = o_orderkey) GROUP BY 1""")
def records_with_children(t):
    lines = t.lineitem.filter("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = rel.with_children(t.orders.select("o_orderkey"), "o_orderkey", lines=lines)
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return out.select("o_orderkey", shown.alias("lines"), F.size("lines").cast("long").alias("n"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END ||
',"z":"' || o_orderpriority || '"}') AS h FROM orders""")
def row_hashes(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("z"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    return rows.select("o_orderkey", md.row_hash(["z", "o_orderstatus", "o_custkey"]).alias("h"))


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1)""")
def fullest_listing(t):
    return ls.fullest(t.customer, "c_mktsegment").select("c_custkey")


@query(f"""WITH {_TAGS}, x AS (SELECT a, b, round_even(score, 5) AS score, n_shared, abs(year(oa.o_orderdate) - year(ob.o_orderdate)) AS gap, oa.o_custkey % 3 <> ob.o_custkey % 3 AS crossed
FROM scored JOIN orders oa ON oa.o_orderkey = a JOIN orders ob ON ob.o_orderkey = b) SELECT a, b, score, crossed AS cross_agency, gap AS years_apart FROM x
WHERE score >= 7.5 AND (crossed OR gap >= 3) AND (n_shared >= 3 OR a % 2 = 0) AND NOT (b = a + 7 OR a = b + 7)""")
def record_links(t):
    """Orders linked by what they share: of different groups of customers or three years apart."""
    records = t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_custkey") % 3).cast("string").alias("agency"), F.year("o_orderdate").alias("year"))
    pairs = _pairs(t).withColumns({"details": F.col("n_shared"), "same_report": F.col("a") % 2 == 0})
    related = t.orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 7).alias("b"))
    out = pt.record_links(pairs, records, related, apart=3)
    return out.select("a", "b", "score", "cross_agency", F.col("years_apart").cast("long").alias("years_apart"))


@query(f"""WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS r, o_custkey % 40 AS g, l_partkey % 60 AS tag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT tag, ln(greatest((SELECT count(DISTINCT r) FROM t), 2) / count(*)) AS w FROM t GROUP BY 1),
norm AS (SELECT r, sqrt(sum(w * w)) AS norm FROM t JOIN w USING (tag) GROUP BY 1),
p AS (SELECT x.r AS a, y.r AS b, sum(w) AS e, sum(w * w) AS d FROM t x JOIN t y ON x.tag = y.tag AND x.g = 3 AND y.g = 8 JOIN w ON w.tag = x.tag GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT a, b, row_number() OVER (ORDER BY score DESC, a, b) AS k FROM (SELECT a, b, round_even(e * d / (na.norm * nb.norm), 9) AS score FROM p JOIN norm na ON na.r = a JOIN norm nb ON nb.r = b) WHERE score >= 4),
g AS (SELECT 0::bigint AS k, []::bigint[] AS ua, []::bigint[] AS ub, NULL::bigint AS a, NULL::bigint AS b UNION ALL
SELECT m.k, list_append(g.ua, s.a), list_append(g.ub, s.b), s.a, s.b FROM g, LATERAL (SELECT min(k) AS k FROM s WHERE s.k > g.k
AND NOT list_contains(g.ua, s.a) AND NOT list_contains(g.ub, s.b)) m JOIN s ON s.k = m.k WHERE len(g.ua) < 8)
SELECT a, b FROM g WHERE a IS NOT NULL""")
def compared_records(t):
    """The accounts (orders) of two records (groups of customers), matched one to one."""
    rows = dealt(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    tags = rows.select(F.col("l_orderkey").alias("r"), (F.col("o_custkey") % 40).alias("g"), (F.col("l_partkey") % 60).alias("tag")).distinct()
    return pt.compared_records(tags, "r", "g", "tag", 3, 8).select("a", "b")
