"""Results that odd texts or larger tables once changed, and work that must not outgrow the input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvane import storage
from corvane.functions import text as tx
from corvane.operators import patterns as pt
from corvane.operators import summaries as sm


def most_rows(df):
    """The result, and the rows of the node that made most of them."""
    found = df.collect()
    counts = []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        metric = p.metrics().get("numOutputRows")
        if metric.isDefined():
            counts.append(metric.get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found, max(counts)


def test_years_in_text_may_touch_letters_but_no_digits(spark):
    texts = ["x1999y", "_1850_", "1999é", "12019 1950", "a1999b2001", "1799", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    found = [r.y for r in df.select("i", tx.first_year_in_text(F.col("v")).alias("y")).orderBy("i").collect()]
    assert found == [1999, 1850, 1999, 1950, 1999, None, None, None]


def test_two_large_records_are_compared_from_the_top(spark, monkeypatch):
    deal, each = random.Random(3), 1500
    tags = {i: sorted(deal.sample(range(30), deal.randint(1, 6))) for i in range(2 * each)}
    bars, reaching = [], pt.pairs_reaching
    monkeypatch.setattr(pt, "pairs_reaching", lambda *a: bars.append(a[-1]) or reaching(*a))
    rows = spark.createDataFrame([(i, "xy"[i % 2], t) for i, own in tags.items() for t in own], "r long, g string, t int")
    found = [(r.a, r.b) for r in pt.compared_records(rows, "r", "g", "t", "y", "x").collect()]
    df = Counter(t for own in tags.values() for t in own)
    w = {t: math.log(len(tags) / c) for t, c in df.items()}
    norm = {i: math.sqrt(sum(w[t] ** 2 for t in own)) for i, own in tags.items()}
    by_tag = defaultdict(list)
    for i, own in tags.items():
        for t in own if i % 2 == 0 else []:
            by_tag[t].append(i)
    scores = []
    for a in range(1, 2 * each, 2):
        shared = defaultdict(list)
        for t in tags[a]:
            for b in by_tag[t]:
                shared[b].append(w[t])
        scores += [(-round(sum(s) * sum(x * x for x in s) / norm[a] / norm[b], 9), a, b) for b, s in shared.items() if len(s) > 1]
    want, used = [], set()
    for s, a, b in sorted(scores):
        if -s >= 4 and len(want) < 8 and not {a, b} & used:
            want.append((a, b))
            used |= {a, b}
    assert sorted(found) == sorted(want) and len(want) == 8
    assert min(bars) > 5


def test_accounts_that_share_one_tag_only_do_not_meet(spark, monkeypatch):
    met, write = [], pt.written
    monkeypatch.setattr(pt, "written", lambda df, name: met.append(write(df, name)) or met[-1] if name == "near_pairs" else write(df, name))
    own = {i: ["common", f"own{i}"] for i in range(200)} | {i: ["common", "u", f"v{i % 2}"] for i in range(200, 204)}
    rows = spark.createDataFrame([(i, i, t) for i, tags in own.items() for t in tags], "r int, g int, t string")
    weights = spark.createDataFrame([(t, 9.0) for t in {t for tags in own.values() for t in tags}], "t string, w double")
    found = pt.similar_pairs(rows, "r", "t", "g", weights=weights).collect()
    assert sorted((r.a, r.b, r.n_shared) for r in found) == [(a, b, 2 + (b - a == 2)) for a, b in itertools.combinations(range(200, 204), 2)]
    assert met[0].count() == 6


@pytest.mark.parametrize("shared, least", [(1, 0.5), (2, 3.0), (3, 4.0), (1, 5.0)])
def test_pairs_by_tuples_are_those_of_all_pairs(spark, shared, least):
    deal = random.Random(shared)
    tags = {i: deal.sample(range(25), deal.randint(1, 9)) for i in range(120)}
    rows = spark.createDataFrame([(i, i % 50, t) for i, own in tags.items() for t in own], "r int, g int, t int")
    df = Counter(t for own in tags.values() for t in own)
    w = {t: math.log(len(tags) / c) for t, c in df.items()}
    norm = {i: math.sqrt(sum(w[t] ** 2 for t in own)) for i, own in tags.items()}
    want = set()
    for a, b in itertools.combinations(tags, 2):
        s = [w[t] for t in set(tags[a]) & set(tags[b])]
        if a % 50 != b % 50 and len(s) >= shared and sum(s) * sum(x * x for x in s) / (norm[a] * norm[b]) >= least:
            want.add((a, b))
    found = pt.similar_pairs(rows, "r", "t", "g", shared=shared, least=least).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want) > 0


def test_years_of_a_page_are_counted_before_episodes_meet_them(spark):
    episodes = spark.createDataFrame([(i, 1, [7, 7, 8] if i else [7, 8], None) for i in range(300)] + [(300, 1, [9], None), (301, 2, [7], 1900)],
                                     "id int, record int, pages array<int>, year int")
    named = [(1, 7, 1950 + k % 2) for k in range(200)] + [(1, 8, 1990)] * 201 + [(1, 9, None)]
    mentions = spark.createDataFrame(named, "record int, page int, year int")
    records = spark.createDataFrame([(1, 2001), (2, 2002)], "record int, year int")
    found, most = most_rows(sm.episode_years(episodes, mentions, records, "record", "id"))
    years = {r.id: r.year for r in found}
    # Page 7 alone: 100 of 1950, 100 of 1951; twice with 201 of 1990, the 301st of 601 is in 1951.
    assert (years[0], years[5], years[300], years[301]) == (1990, 1951, 2001, 1900)
    assert most < 3000


def test_a_list_of_accounts_is_made_once_for_all_episodes_of_its_pages(spark):
    episodes = spark.createDataFrame([(i, 1, [1, 2, None]) for i in range(200)] + [(200, 1, [2]), (201, 1, [5])], "id int, record int, pages array<int>")
    told = spark.createDataFrame([(1, 1 + k % 2, 1000 - k) for k in range(400)] + [(1, 2, 1000), (2, 1, 5)], "record int, page int, account int")
    found, most = most_rows(sm.episode_accounts(episodes, told, "record", "id", "account"))
    lists = {r.id: r.account_ids for r in found}
    assert set(lists) == set(range(201)) and lists[7] == list(range(601, 1001))
    assert lists[200] == sorted({1000} | set(range(601, 1000, 2)))
    assert most < 3000


def test_combinations_are_counted_where_they_are_made(spark):
    deal, rows = random.Random(1), []
    for i in range(400):
        for dim in "abcd":
            rows += [(i, i % 20, f"{dim}{k}", dim, 1.0 + k) for k in deal.sample(range(5), 2)]
        if i % 3 == 0:
            rows += [(i, i % 20, t, t[0], 9.0) for t in ("a9", "b9", "c9")]
    tags = spark.createDataFrame(rows, "account int, record int, tag string, dim string, w double")
    found, most = most_rows(pt.combinations(tags, ["a"], ["b"], contradictions={"a9": ["d0"]}, lift=1.05))
    own, members = defaultdict(list), defaultdict(list)
    for a, _, tag, _, w in rows:
        own[a].append((-w, tag))
    p, without = Counter(), 0
    for a, held in own.items():
        heavy = [t for _, t in sorted(held)[:10]]
        p.update(heavy)
        if any(t == "d0" for _, t in held):
            heavy = [t for t in heavy if t != "a9"]
            without += 1
        for k in (2, 3):
            for c in itertools.combinations(sorted(heavy), k):
                if len({t[0] for t in c}) == k and {"a", "b"} <= {t[0] for t in c}:
                    members[c].append(a)
    want = {}
    for c, held in members.items():
        lift, r = len(held) / (math.prod(p[t] for t in c) / 400 ** (len(c) - 1)), len({a % 20 for a in held})
        if len(held) >= 6 and r >= 3 and lift >= 1.05:
            want[c] = (len(held), r, round(lift, 9))
    assert {tuple(x for x in (r.t1, r.t2, r.t3) if x): (r.m, r.r, round(r.lift, 9)) for r in found} == want
    assert without and len(want) > 10 and most < 10_000


@pytest.mark.parametrize("name, key", [("replaced_children", "l_orderkey"), ("lift_rows", "l_orderkey"), ("lift_rows", "l_partkey"), ("tag_weights", "l_orderkey")])
def test_tasks_hold_as_many_rows_whatever_the_size_of_lineitem(spark, monkeypatch, name, key):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(storage, "DEALT", n // 30)
    df = __spark_entry__.queries()[name](spark, folder)
    parts = {int(x) for x in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
    assert parts and min(parts) >= 30
