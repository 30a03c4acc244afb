import datetime
import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import metadata as md
from corvane.functions import segments as sg
from corvane.functions import spans as sp
from corvane.functions import wording as wd
from corvane.operators import browse as br
from corvane.operators import lifecycle as lc
from corvane.operators import patterns as pt
from corvane.operators import relational as rel
from corvane.operators import statistics as st
from corvane.operators import summaries as sm
from corvane.sources import listing


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tags_and_ranks(spark):
    records = spark.createDataFrame([(1, "a_b%"), (2, "axb"), (3, None)], "id int, title string")
    tags = spark.createDataFrame([(1, "k", "x"), (1, "k", "y"), (2, "k", "x"), (9, "k", "x")], "id int, facet string, value string")
    assert rows(rel.having_tags(records, tags, "id", [F.col("value") == "x", F.col("value") == "y"]).select("id")) == [(1,)]
    assert rows(br.search(records, {"title": 5}, ["A_B%"]).select("id", "rank")) == [(1, 5)]
    assert rows(br.search(records, {"title": 5}, ["a_b"], wildcards=True).select("id")) == [(1,), (2,)]
    assert rows(br.search(records, {"title": 5}, [], tags, [("k", "x")]).select("id", "rank")) == [(1, 0), (2, 0)]
    ranks = [r[0] for r in records.orderBy("id").select(rel.relevance([(F.col("title"), 3)], ["X", "b%"])).collect()]
    assert ranks == [3, 3, 0]
    page, totals = br.paged(records.filter("id > 9"), [F.col("id")], 1)
    assert page.count() == 0 and rows(totals) == [(0, 1)]
    assert br.tag_params(["k:x", "odd:y", "k:", "plain", "k:a:b"], ["k"]) == [("k", "x"), ("k", "a:b")]
    assert br.spellings("tic-tac", {"tic-tac": "tic tac"}) == ["tic-tac", "tic tac", "tictac"] and br.spellings("  ", {}) == []
    assert br.outdated({"a": "1"}, {"a": "1", "b": "2"}) and not br.outdated({"a": "1", "b": "2"}, {"b": "2"})


def test_labels_of_collections(spark):
    df = spark.createDataFrame([("red", "blue " * 3, 1950), ("x", "red " * 3, 1950), ("x", "red " * 3, 1970), ("green", None, None)], "meta string, body string, year int")
    rules = [rel.LabelRule("r", "red", since=1965), rel.LabelRule("b", "blue", meta="green")]
    assert [r[0] for r in df.select(rel.multi_label(rules, F.col("meta"), F.col("body"), F.col("year"))).collect()] == [["r", "b"], [], ["r"], ["b"]]
    one = spark.createDataFrame([("t", "d", "b", True), ("t", None, None, False)], "t string, d string, b string, s boolean")
    meta, body = rel.shared_description(F.col("t"), F.col("d"), F.col("b"), F.col("s"))
    assert [tuple(r) for r in one.select(meta, body).collect()] == [("t", "d\nb"), ("t\n", "")]


def test_diverse_picks(spark):
    df = spark.createDataFrame([(1, "r1", "A", 9), (2, "r1", "B", 8), (3, "r2", "A", 7), (4, "r3", "B", 6), (5, "r4", "A", 5)], "id int, record string, agency string, n int")
    assert [r.id for r in rel.diverse_picks(df, "record", "agency", [F.desc("n")], 3).collect()] == [1, 4, 3]


def similarity(tags, n):
    df = {t: sum(t in own for own in tags.values()) for own in tags.values() for t in own}
    w = {t: math.log(max(n, 2) / c) for t, c in df.items()}
    norm = {r: math.sqrt(sum(w[t] ** 2 for t in own)) for r, own in tags.items()}
    return {
        (a, b): sum(w[t] for t in tags[a] & tags[b]) * sum(w[t] ** 2 for t in tags[a] & tags[b]) / (norm[a] * norm[b])
        for a in tags for b in tags if a < b and norm[a] * norm[b] and len(tags[a] & tags[b]) >= 2
    }


@pytest.mark.parametrize("least", [0.5, 2.0, 5.0])
def test_similar_pairs_lose_none_to_the_prefix(spark, least):
    import random

    rng = random.Random(4)
    tags = {r: set(rng.choices([f"t{k}" for k in range(30)], [40 - k for k in range(30)], k=8)) | {"all"} for r in range(40)}
    df = spark.createDataFrame([(r, r % 7, t) for r, own in tags.items() for t in own], "r int, s int, t string")
    got = {(x.a, x.b): x.score for x in pt.similar_pairs(df, "r", "t", "s", least=least).collect()}
    want = {p: v for p, v in similarity(tags, 40).items() if v >= least and p[0] % 7 != p[1] % 7}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)
    core = pt.similar_pairs(df, "r", "t", "s", least=least, core=F.col("t") != "all", behaviour=F.col("t") == "t1").collect()
    both = {p for p in want if len((tags[p[0]] & tags[p[1]]) - {"all"}) >= 2 and "t1" in tags[p[0]] & tags[p[1]]}
    assert {(x.a, x.b) for x in core} == both
    top = pt.top_partners(pt.similar_pairs(df, "r", "t", "s", least=least), 2)
    assert all(r.rank <= 2 for r in top.collect())


def test_combinations_keep_the_heaviest_and_refuse_contradictions(spark):
    rows_ = []
    for a in range(8):
        rows_ += [(a, a % 4, "disc", "shape", 2.0), (a, a % 4, "hover", "motion", 1.5), (a, a % 4, "white", "colour", 0.1 if a else 9.0)]
        rows_ += [(a, a % 4, "hum", "sound", 1.0)] if a < 7 else [(a, a % 4, "silent", "sound", 1.0)]
    rows_ += [(a, a, "dull", "colour", 1.0) for a in range(8, 30)]
    df = spark.createDataFrame(rows_, "account int, record int, tag string, dim string, w double")
    found = {(r.t1, r.t2, r.t3): (r.m, r.r) for r in pt.combinations(df, ["shape", "motion"], ["motion", "sound"], ["hover"], {"hum": ["silent"]}).collect()}
    assert found[("disc", "hover", None)] == (8, 4) and found[("disc", "hover", "hum")] == (7, 4) and found[("disc", "hum", None)] == (7, 4)
    assert ("hover", "hum", None) not in found  # a weak tag and a sound define nothing
    assert ("disc", "white", None) not in found  # no behaviour
    few = {(r.t1, r.t2, r.t3) for r in pt.combinations(df, ["shape"], ["motion"], heaviest=2).collect()}
    assert few == {("disc", "hover", None)}
    more = spark.createDataFrame(rows_ + [(0, 0, "silent", "sound", 0.5)], df.schema)
    assert {(r.t1, r.t2, r.t3): r.m for r in pt.combinations(more, ["shape"], ["sound"], (), {"hum": ["silent"]}).collect()}[("disc", "hum", None)] == 6


def test_waves_see_only_near_neighbours(spark):
    counts = [(y, 60 if y in (5, 25, 26) else 1) for y in range(40)]
    out = st.waves(spark.createDataFrame(counts, "s long, n long"), "s").collect()
    assert sorted((r["first"], r["last"], r["peak"]) for r in out) == [(5, 5, 5), (25, 26, 25)]
    assert rows(st.dense_calendar(spark.createDataFrame([(1, 2), (4, 1)], "s long, n long"), "s")) == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_verdicts_of_records(spark):
    v = [("a", 1, "explained", "x", False), ("a", 2, "unresolved", "unresolved", True), ("b", 1, "explained", "y", True), ("b", 2, "explained", "x", True),
         ("b", 3, "explained", "x", True), ("c", 1, "explained", "x", True), ("c", 2, "unresolved", "unresolved", True), ("d", 1, "explained", "z", False), ("d", 2, "explained", "y", False)]
    df = spark.createDataFrame(v, "record string, at int, group string, category string, strong boolean")
    assert rows(sm.derived_verdicts(df)) == [("a", "unresolved", "unresolved", 2), ("b", "explained", "x", 3), ("d", "explained", "z", 1)]


def test_text_of_pages_and_words(spark):
    words = [(1, 1, 1, 1, 2, "b", 90.0), (1, 1, 1, 1, 1, "a", 80.0), (1, 1, 1, 2, 1, "c", 70.0), (1, 2, 1, 1, 1, "d", 60.0), (1, 2, 1, 1, 2, "x", -1.0), (1, 2, 1, 1, 3, " ", 99.0)]
    df = spark.createDataFrame(words, "page int, block int, par int, line int, pos int, word string, conf double")
    assert rows(sm.scanned_lines(df, ["page"])) == [(1, "a b\nc\n\nd", 75.0)]
    pages = spark.createDataFrame([(1, 2, "two", "ocr", 50.0), (1, 1, "one", "text", None), (1, 3, " \n", "ocr", 71.0)], "record int, page int, text string, method string, confidence double")
    assert rows(sm.page_text(pages, "record", "page", "text", "method", "confidence")) == [(1, "[Page 1]\none\n\n[Page 2]\ntwo", 26, 2, 60.5)]


def test_budget_keeps_the_first_and_what_fits(spark):
    blocks = [(1, k, "x" * n) for k, n in enumerate([500, 1, 30, 90, 5])] + [(2, k, "x" * n) for k, n in enumerate([60, 50, 40, 1])]
    df = spark.createDataFrame(blocks, "record int, page int, text string")
    assert rows(lc.budgeted(df, "record", "page", "text", 100).select("record", "page")) == [(1, 0), (2, 0), (2, 2)]


def test_failures_stay_with_their_rows(spark):
    out = lc.isolated(spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, v string"), "v", lambda v: str(int(v) * 2))
    assert [(r.result, r.error is None) for r in out.orderBy("id").collect()] == [("8", True), (None, False), (None, False)]


def test_reading_batches_as_files(spark, tmp_path):
    records = spark.createDataFrame([("a", 60), ("b", 60), ("c", 40)], "record string, n long")
    listing.write_reading_batches(records, str(tmp_path / "b"), "n", 100)
    back = spark.read.schema("record string, n long, batch int").json(str(tmp_path / "b"))
    assert rows(back.select("batch", "record")) == [(1, "a"), (2, "b"), (2, "c")]


def test_spans_at_line_ends_and_long_texts():
    engine = sp.Engine([sp.Rule("a", r"\bdisc\b", not_before=r"\bno\b[^.;]{0,25}")], first_only=False)
    assert [s["start"] for s in engine.spans("no\ndisc here. disc " + "x" * 100_000 + " disc")] == [14, 100020]
    assert sg.dates("12 May 44 1950 and 3 June 10 1950", datetime.date(2025, 1, 1)) == [
        {"value": datetime.date(1944, 5, 12), "precision": "day"}, {"value": datetime.date(1950, 6, 10), "precision": "day"},
        {"value": datetime.date(2010, 6, 3), "precision": "day"}]
    assert wd.listed([]) == "" and wd.listed(["a"]) == "a" and wd.listed(["a", "b", "c"]) == "a, b and c"


def test_release_rows_end_to_end(spark):
    listing_ = spark.createDataFrame([("1_5_Report_1947", "7/2/47", "2026-05-01"), ("Seen March 2023", "3/23/26", "2026-05-01"), ("Report, 2026", None, "2026-05-01"),
                                      ("Later", "1/1/30", "2026-05-01")], "title string, raw string, release string")
    got = listing_.withColumn("title", md.clean_title(F.col("title"))).withColumn("d", md.listing_year(F.col("raw"), F.col("title"), F.col("release").cast("date"), 2026))
    assert [(r.title, str(r.d.date), r.d.year) for r in got.collect()] == [
        ("Report 1947", "1947-07-02", 1947), ("Seen March 2023", "None", 2023), ("Report, 2026", "None", None), ("Later", "1930-01-01", 1930)]


def test_read_batches_replace_curated_episodes(spark, tmp_path):
    kind = ("record string, event string, summary string, pages array<string>, details array<string>, year string, place string,"
            "outcome string, explanation string, valid_pages array<int>")  # fmt: skip
    read = [("a", "space", "New.", ["1"], [], "1950", None, "open", None, None), ("a", "odd", "x", None, None, None, None, None, None, None),
            ("z", "space", "y", None, None, None, None, None, None, None)]
    spark.createDataFrame(read, kind).coalesce(1).write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "broken.json").write_text("{no")
    old = spark.createDataFrame([("a", "old", "Old."), ("b", "old", "Old.")], "record string, event string, summary string")
    known = spark.createDataFrame([("a",), ("b",)], "record string")
    merged, found = listing.import_batches(spark, str(tmp_path / "in"), kind, known, old, ["space"], [], ["open"], 2025)
    assert rows(merged) == [("a", "space", "New."), ("b", "old", "Old.")]
    assert rows(found) == [("a", "unknown class odd"), ("b", "not read"), ("z", "unknown record")]
