import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import segments as sg
from corvane.functions import spans as sp
from corvane.operators import episodes as ep
from corvane.operators import selection as sel
from corvane.sources import listing
from corvane.streaming import windows as st

RULES = [sp.Rule("trail", r"\btrails?\b", "look", not_before=r"\b(?:no|without)\b[^.;]{0,20}"),
         sp.Rule("odor", r"\bodor\b", "sense", not_after=r"[\s:]*none\b"),
         sp.Rule("glow", r"\bglow\w*", "look")]


def test_guards_look_around_matches(spark):
    texts = ["It left a trail. Odor: none", "without any trail of it, then a trails glow", "nothing", None, "", "odor of sulphur"]
    out = sp.find_spans(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", sp.Engine(RULES))
    found = {r["id"]: [(s["key"], s["start"], s["end"]) for s in r["spans"]] for r in out.collect()}
    assert found == {0: [("trail", 10, 15)], 1: [("trail", 32, 38), ("glow", 39, 43)], 2: [], 3: [], 4: [], 5: [("odor", 0, 4)]}


def test_exclusive_spans_do_not_overlap():
    rules = [sp.Rule("a", "red disc", "shape"), sp.Rule("b", "disc", "shape"), sp.Rule("c", "red", "colour")]
    hits = sp.Engine(rules, first_only=False, exclusive=True).spans("a red disc and a disc")
    assert [(h["key"], h["start"]) for h in hits] == [("a", 2), ("b", 17), ("c", 2)]


def test_snippets_end_at_words():
    text = "alpha beta gamma delta epsilon"
    assert sp.widened(text, 11, 16, 3) == "…beta gamma delta…"
    assert sp.widened(text, 0, 5, 100) == text
    assert sp.merged([(5, 8), (9, 12), (40, 41)], 3, 42) == [(2, 15), (37, 42)]


def test_passages_hold_every_word(spark):
    long = " ".join(f"Sentence number {i} has some words." for i in range(120))
    text = "Head\n\n  a   short\nparagraph \n\n" + long + "\n\ntail one\n\ntail two"
    out = sg.passages(text)
    assert out[0] == "Head\n\na short\nparagraph" and out[-1] == "tail one\n\ntail two"
    assert all(len(p) <= sg.PASSAGE for p in out)
    assert " ".join(out).split() == text.split()
    rows = sg.segment(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "t").collect()
    assert [r["seq"] for r in rows] == list(range(len(out))) and {r["id"] for r in rows} == {1}
    assert sg.passages("x" * 5000) == ["x" * 5000]


@pytest.mark.parametrize("text, expected", [
    ("on July 7th, 1947 and 8 Jul 47", [((1947, 7, 7), "day"), ((1947, 7, 8), "day")]),
    ("in July 1947; 1947-07-01", [((1947, 7, 1), "day")]),
    ("March 1952", [((1952, 3, 1), "month")]),
    ("2/30/1950 and 13/1/1950, 3/4/26 and 3/4/27", [((1926, 3, 4), "day")]),
    ("3/4/24", [((2024, 3, 4), "day")]),
    ("", []), (None, []),
])
def test_dates(text, expected):
    found = sg.dates(text, datetime.date(2025, 6, 1), first_year=1900)
    want = [(datetime.date(*d), p) for d, p in expected if datetime.date(*d) <= datetime.date(2025, 6, 1)]
    if text and "3/4/27" in text:
        want.append((datetime.date(1927, 3, 4), "day"))
    assert [(d["value"], d["precision"]) for d in found] == want


@pytest.mark.parametrize("text, expected", [
    ("lasted about ten seconds", "brief"), ("for 20 minutes", "minutes"), ("visible for two hours", "long"), ("for a while", None),
    ("lasted 0 seconds, then visible for 5 minutes", "minutes"), ("for 5 to 40 minutes", "minutes"), (None, None),
    ("It was in sight approximately a few secs", "brief"), ("the 20 minutes", None), ("for 1234 seconds", None),
])
def test_durations(text, expected):
    assert (sg.duration_span(text) or (None,))[0] == expected


@pytest.mark.parametrize("text, expected", [
    ("within 1,200 feet, then 30 yards away", [1200, 90]), ("a man 5 feet tall", []), ("ten meters above the barn", [32.8]),
    ("within a few feet", [3]), ("five hundred ft. from it", [500]), ("12,34 feet away", []), (None, []),
    ("three hundred yards in front", [900]), ("within a hundred feet", [100]),
])
def test_distances(text, expected):
    assert [f for f, _ in sg.distances(text)] == pytest.approx(expected)


def test_measures(spark):
    one = spark.createDataFrame([("Plain words, 12:30 here.", "a" * 50)], "t string, u string")
    row = one.select(sg.readability(F.col("t")), sg.readability(F.lit("")), sg.head_and_tail(F.col("u"), 10),
                     sg.readability(F.lit("(don’t) stop\u00a0now... ##"))).first()
    assert row[0] == 1.0 and row[1] == 0.0
    assert row[2] == "a" * 8 + "\n\n[... 40 characters omitted ...]\n\n" + "aa"
    # Three words of four tokens; three stray signs (’ and ##) in 22 characters.
    assert row[3] == 0.205


def test_selections(spark):
    pairs = spark.createDataFrame([(1, 10, 9.0), (1, 11, 8.0), (2, 10, 7.0), (2, 11, 6.0)], "a long, b long, score double")
    assert [(r.a, r.b) for r in sel.matched_pairs(pairs).collect()] == [(1, 10), (2, 11)]
    star = spark.createDataFrame([(0, i, float(10 - i)) for i in range(1, 7)], "a long, b long, score double")
    assert [r.b for r in sel.degree_limited(star).collect()] == [1, 2, 3]
    sets = spark.createDataFrame([(3.0, ["a", "b"], [1, 2, 3]), (2.0, ["a", "b", "c"], [7]), (1.0, ["d"], [1, 9, 8, 5])],
                                 "score double, items array<string>, members array<long>")
    assert [r.score for r in sel.diverse_sets(sets).collect()] == [3.0, 1.0]
    rows = spark.createDataFrame([(i, i // 2) for i in range(20)], "i long, r long")
    assert [r.i for r in sel.spread(rows, "r", [F.col("i")], 5).collect()] == [0, 4, 8, 12, 16]
    sized = spark.createDataFrame([(1, 60), (2, 60), (3, 40), (4, 500), (5, 1)], "k long, n long")
    assert [r.batch for r in sel.batches(sized, [F.col("k")], "n", 100).orderBy("k").collect()] == [1, 2, 2, 3, 4]
    assert sel.matched_pairs(pairs.limit(0)).count() == 0


def test_batches_are_those_of_one_pass(spark):
    rng = random.Random(7)
    for case in range(4):
        sizes = [rng.choice([0, 0, 1, 5, 30, 99, 100, 101, 250] if case % 2 else [0, 1, 2, 3, 7]) for _ in range(300)]
        batch, held, want = 1, 0, []
        for n in sizes:
            if held and held + n > 100:
                batch, held = batch + 1, 0
            held += n
            want.append(batch)
        rows = spark.createDataFrame(list(enumerate(sizes)), "k long, n long").repartition(4)
        assert [r.batch for r in sel.batches(rows, [F.col("k")], "n", 100).orderBy("k").collect()] == want
    assert sel.batches(rows.limit(0), [F.col("k")], "n", 100).count() == 0


def test_greedy_picks_are_those_of_a_full_walk(spark):
    rng = random.Random(3)
    links = {(min(a, b), max(a, b)): float(rng.randint(1, 40)) for a, b in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(400)) if a != b}
    rows = [(a, b, s) for (a, b), s in links.items()]
    order = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    used, kept = {}, []
    for a, b, _ in order:
        if len(kept) < 20 and max(used.get(a, 0), used.get(b, 0)) < 3:
            kept.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    df = spark.createDataFrame(rows, "a long, b long, score double")
    assert [(r.a, r.b) for r in sel.degree_limited(df, 3, 20).collect()] == kept
    seen_a, seen_b, pairs = set(), set(), []
    for a, b, _ in order:
        if len(pairs) < 8 and a not in seen_a and b not in seen_b:
            pairs.append((a, b))
            seen_a.add(a)
            seen_b.add(b)
    assert [(r.a, r.b) for r in sel.matched_pairs(df).collect()] == pairs


def test_episode_rules(spark):
    kind = "record string, media string, kind string, research boolean, text string, description_tags array<string>"
    records = spark.createDataFrame([
        ("a", "pdf", None, False, "t", []), ("b", "video", None, False, "t", []), ("c", "video", None, False, "t", ["pilot"]),
        ("d", "pdf", None, False, "t", []), ("e", "pdf", "correspondence", False, "t", ["disc"]), ("f", "pdf", "scientific_study", True, None, None),
        ("g", "pdf", None, None, "", None), ("h", "image", None, False, "t", ["disc"])], kind)
    accounts = spark.createDataFrame([("a", 3, ["landed", "orbit"]), ("a", 1, ["disc"]), ("a", 2, []), ("d", 4, [])], "record string, page int, tags array<string>")
    out = {(r.record, r.seq): (r.page, r["class"], r.details) for r in ep.rule_episodes(records, accounts).collect()}
    assert out == {
        ("a", 0): (1, "sighting", ["disc"]), ("a", 1): (3, "space", ["landed", "orbit"]), ("b", 0): (0, "sensor", []),
        ("c", 0): (0, "sighting", ["pilot"]), ("d", 0): (0, "none", []), ("e", 0): (0, "none", ["inquiry"]), ("f", 0): (0, "none", ["study"]),
        ("g", 0): (None, "none", []), ("h", 0): (0, "sensor", ["disc"])}


def test_episode_validation(spark):
    kind = ("record string, event string, summary string, pages array<string>, details array<string>, year string, place string,"
            "outcome string, explanation string, valid_pages array<int>")  # fmt: skip
    raw = spark.createDataFrame([
        ("a", " space ", " a  b ", ["2", "1", "x", "2", "-1", "9"], ["d", "q", "d"], "1799", "", "odd", None, [1, 2]),
        ("b", "none", "s", None, None, None, None, None, None, None), ("c", "space", "  ", None, None, None, None, None, None, None),
        ("d", "space", "word " * 200, None, None, "1950", "here", "open", "why", None)], kind)
    got = {r.record: r for r in ep.validated(raw, ["space"], ["d"], ["open"], 2025).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"].event, got["a"].summary, got["a"].pages, got["a"].details) == ("space", "a b", [1, 2], ["d"])
    assert (got["a"].year, got["a"].place, got["a"].outcome) == (None, None, "not_stated")
    assert got["d"].year == 1950 and got["d"].summary.endswith("word…") and got["d"].pages == []
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "record string")
    found = {(r.record, r.problem) for r in ep.problems(raw, known, ["space"]).collect()}
    assert found == {("d", "unknown record"), ("b", "unknown class none"), ("c", "empty summary"), ("e", "not read")}


def test_listing_and_snapshot(spark, tmp_path):
    file = tmp_path / "l.csv"
    file.write_text('﻿Title , Day,,\n" A, x ",1/2/50,,\n,1/2/51,,\nB,,,\n"C ""q""\nnext",2/3/52,z,\n', encoding="utf-8")
    rows = listing.read_listing(spark, str(file), ["Title", "Day"])
    assert rows.columns == ["Title", "Day"]
    assert sorted(r.Title for r in rows.collect()) == ["A, x", 'C "q"\nnext']
    records = spark.createDataFrame([("a", "classified"), ("b", "extracted")], "record string, status string")
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "record string, page int, text string")
    listing.write_snapshot(records, pages, str(tmp_path / "snap"))
    schema = "record string, status string, pages array<struct<page:int,text:string>>"
    back, nested = listing.read_snapshot(spark, str(tmp_path / "snap"), schema)
    assert sorted(map(tuple, back.collect())) == [("a", "classified", "[Page 1]\none\n\n[Page 2]\ntwo"), ("b", "new", "")]
    assert [tuple(r) for r in nested.collect()] == [("a", 1, "one"), ("a", 2, "two")]
    assert listing.read_snapshot(spark, str(tmp_path / "snap"), schema, stored=records)[0].count() == 0
    listing.write_curated(pages, str(tmp_path / "cur"))
    (tmp_path / "cur" / "broken.json").write_text("{nope")
    old = listing.read_curated(spark, str(tmp_path / "cur"), "record string, episodes array<struct<page:int,text:string>>")
    new = spark.createDataFrame([("a", 7, "new"), ("z", 1, "z")], "record string, page int, text string")
    assert sorted(map(tuple, listing.import_curated(old, new).collect())) == [("a", 7, "new"), ("z", 1, "z")]
    url = spark.createDataFrame([("http://x/A%20b.PDF?q=1",)], "u string")
    assert url.select(listing.archive_key("u")).first()[0] == "a b.pdf"


def test_streams_agree_with_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("u", base + datetime.timedelta(seconds=s)) for s in (0, 5, 9, 2000, 2003)] + [("v", base + datetime.timedelta(days=3))]
    kind = "k string, at timestamp"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.closed_sessions(st.read_stream(spark, str(tmp_path / "in"), kind), "k", "at")
    st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).filter("k = 'u'").collect()) == [2, 3]
    alerts = st.rate_alerts(spark.createDataFrame(rows, kind), "k", "at", limit=3)
    assert {r.n for r in alerts.collect()} == {3}
    assert re.match(r"2024", str(st.calendar_counts(spark.createDataFrame(rows, kind), "at").agg(F.min("start")).first()[0]))
    once = st.first_arrivals(st.read_stream(spark, str(tmp_path / "in"), kind), "k", "at")
    st.run_available(once, str(tmp_path / "once"), str(tmp_path / "cp2"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["u", "v"]
