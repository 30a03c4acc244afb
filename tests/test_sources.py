import zipfile

import pytest
from pyspark.sql import functions as F

from corvane import __main__ as cli
from corvane.functions import lexicon as lx
from corvane.operators import lifecycle as lc
from corvane.operators import patterns as pt
from corvane.operators import summaries as sm
from corvane.sources import listing, plugins
from corvane.streaming import windows


LISTED = """
def listed(options):
    for k in range(3):
        yield {"record": "r" + options["part"] + str(k), "n": k}
"""


def test_record_source(spark, tmp_path):
    (tmp_path / "listed_source.py").write_text(LISTED)
    spark.sparkContext.addPyFile(str(tmp_path / "listed_source.py"))
    rows = plugins.read_records(spark, "listed_source:listed", "record string, n int, other string", parts="2")
    assert sorted(map(tuple, rows.collect())) == [(f"r{p}{k}", k, None) for p in range(2) for k in range(3)]


def test_links(spark):
    html = '<a href="/b.zip?a=1&amp;b=2"> "/x.csv" <a href="/a.zip"> "/y.csv" "/x.csv" <a href="/a.zip">'
    df = spark.createDataFrame([(html,), (None,)], "h string")
    rows = df.select(plugins.listing_links(F.col("h"), 'href="([^"]+[.]zip[^"]*)"', '"(/[a-z]+[.]csv)"', "/last.csv").alias("l")).collect()
    assert rows[0].l.bundles == ["/a.zip", "/b.zip?a=1&b=2"] and rows[0].l.listings == ["/x.csv", "/y.csv", "/last.csv"]
    assert rows[1].l.bundles == [] and rows[1].l.listings == ["/last.csv"]
    found = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3), ("s0", 4), ("s0", 5)], "source string, n int")
    assert {r.source for r in listing.fullest(found, "source").collect()} == {"s0"}
    pages = spark.createDataFrame([(200, "fine"), (403, "x"), (200, "<b>Access Denied</b>")], "status int, body string")
    assert [r[0] for r in pages.select(listing.blocked_page(F.col("status"), F.col("body"), ["access denied"])).collect()] == [False, True, True]


def test_pages_bundles_and_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "b.txt").write_bytes(b" ")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.txt"))
    assert sorted((r.path[-5:], r.page_no, r.text) for r in plugins.read_pages(files).collect()) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.txt", 1, " ")]

    def broken(content):
        raise OSError("no")
        yield

    assert {(r.page_no, r.error) for r in plugins.read_pages(files, broken).collect()} == {(None, "OSError: no")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/My%20File.PDF", b"%PDF-1")
        z.writestr("x/", b"")
    (tmp_path / "bad.zip").write_bytes(b"nope")
    members = plugins.bundle_members(spark.read.format("binaryFile").load(str(tmp_path / "*.zip")))
    row = members.collect()
    assert [(r.member, r.key) for r in row] == [("x/My%20File.PDF", "my file.pdf")]
    missing = spark.createDataFrame([(1, "my file.pdf", "rec"), (2, "my file.pdf", "other")], "release int, key string, record string")
    got = plugins.recovered(missing, members.withColumn("release", F.lit(1))).select("record", plugins.sniffed_pdf(F.col("content")).alias("pdf")).collect()
    assert [tuple(r) for r in got] == [("rec", True)]
    assert {r.size for r in plugins.file_digests(spark, str(tmp_path / "a.txt")).collect()} == {7}


def test_model_answers_are_cached(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    empty = spark.createDataFrame([], "key string, answer string, error string")
    whole, fresh = plugins.read_with_model(texts, empty, plugins.EchoModel(), "s", "{}", "v1")
    assert sorted(r.answer for r in whole.collect()) == ['{"begins": "a b", "words": 2}', '{"begins": "c", "words": 1}']
    cache = spark.createDataFrame(fresh.collect(), empty.schema)
    again, none = plugins.read_with_model(texts, cache, plugins.EchoModel(), "s", "{}", "v1")
    assert none.count() == 0 and again.count() == 2

    class Broken:
        name = "broken"

        def parse(self, system, prompt, schema):
            raise ValueError("x")

    assert {r.error for r in plugins.read_with_model(texts, cache, Broken(), "s", "{}", "v1")[0].collect()} == {"ValueError: x"}


def test_results_are_published_together(spark, tmp_path):
    path = str(tmp_path / "out")
    for version in ("v1", "v2"):
        plugins.publish({"a": spark.createDataFrame([(version,)], "v string")}, path, version)
        assert plugins.published(spark, path, "a").first()[0] == version
    rows = plugins.json_rows(spark.createDataFrame([(1, None)], "a int, b string"))
    assert rows.first()[0] == '{"a":1,"b":null}'


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "facet_browse" in capsys.readouterr().out
    assert cli.main(["run", "page_range", "/root/testdata/sf0.001", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).columns == ["conv_id", "turn"]
    with pytest.raises(SystemExit):
        cli.main(["run", "no such query", "x", "y"])


def test_counters_are_observed(spark):
    df, seen = lc.counted(spark.range(10), "c", even=F.col("id") % 2 == 0, large=F.col("id") > 6)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"even": 5, "large": 3}
    assert lc.must_rerun(0, True, False) and not lc.must_rerun(0, False, False)


def test_sample_keeps_what_it_must(spark):
    rows = spark.range(500).withColumn("keep", F.col("id") % 50 == 0)
    one, two = ({r.id for r in sm.sampled(df, "id", F.col("keep"), 60).collect()} for df in (rows, rows.repartition(7)))
    assert one == two and len(one) == 60 and {k for k in range(0, 500, 50)} <= one
    assert sm.sampled(rows, "id", F.col("keep"), 5).count() == 10


WORDS = "the crew of the first aircraft saw a bright round light cross the bay from west to east at great speed and then turn back over the water".split()


def test_copies_of_one_report(spark):
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    near = " ".join(["xx"] + WORDS[:14] + ["yy"] + WORDS[15:])
    pairs = spark.createDataFrame([(text, near), (text, other), ("short", "short"), (None, text)], "l string, r string")
    assert [r.same_report for r in lx.with_same_report(pairs, "l", "r").collect()] == [True, False, False, False]


def test_types_and_links(spark):
    tags = spark.createDataFrame([(a, t) for a in range(8) for t in (["x", "y", "z"] if a < 4 else ["x", "y"] if a < 6 else ["q"])], "account int, tag string")
    types = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "type int, items array<string>")
    members = pt.type_members(types, tags)
    accounts = spark.createDataFrame([(a, a // 2, 1950 + a) for a in range(8)], "account int, record int, year int")
    got = {r.type: r for r in pt.type_descriptions(types, members, tags, accounts).collect()}
    assert (got[1]["size"], got[1].records, got[1].first_year, got[1].last_year) == (6, 3, 1950, 1955)
    assert [tuple(a) for a in got[1].also] == [("z", 0.67)] and [a.tag for a in got[2].also] == ["y", "z"]
    assert {r.type for r in pt.strongest_type(members).collect()} == {1}
    best = spark.createDataFrame([(1, 2, 9.0, 3, False), (1, 3, 9.0, 3, False), (2, 3, 8.0, 1, True), (3, 4, 7.0, 5, False), (1, 4, 9.0, 2, False)], "a int, b int, score double, details int, same_report boolean")
    records = spark.createDataFrame([(1, "A", 1950), (2, "B", 1951), (3, "A", 1952), (4, "A", 1990)], "record int, agency string, year int")
    related = spark.createDataFrame([(3, 2)], "a int, b int")
    links = pt.record_links(best, records, related).select("a", "b", "cross_agency", "years_apart").collect()
    assert [tuple(r) for r in links] == [(1, 2, True, 1)]


def test_layout(spark):
    rows = [(a, t) for a in range(30) for t in (["x", "y"] if a % 3 == 0 else ["p", "q"] if a % 3 == 1 else ["x", "q"])] + [(99, "z")]
    df = spark.createDataFrame(rows, "account int, tag string")
    one = sorted(map(tuple, pt.flat_layout(df, "account", "tag").collect()))
    assert one == sorted(map(tuple, pt.flat_layout(df.repartition(5), "account", "tag").collect())) and len(one) == 31
    assert all(0.03 - 1e-9 <= v <= 0.97 + 1e-9 for _, x, y in one for v in (x, y))
    assert len({(round(x, 6), round(y, 6)) for _, x, y in one}) == 4
    few = pt.flat_layout(df.filter("account < 3"), "account", "tag").orderBy("account").collect()
    assert [round(r.x, 3) for r in few] == [0.265, 0.5, 0.735] and {r.y for r in few} == {0.5}
    radii = [3.0, 1.0, 2.0, 1.5, 0.5]
    spots = pt.packed_circles(radii)
    for i in range(5):
        for j in range(i):
            d = ((spots[i][0] - spots[j][0]) ** 2 + (spots[i][1] - spots[j][1]) ** 2) ** 0.5
            assert d >= radii[i] + radii[j] - 1e-6
    x, y, r = pt.enclosing([(*s, q) for s, q in zip(spots, radii, strict=True)])
    assert all(((s[0] - x) ** 2 + (s[1] - y) ** 2) ** 0.5 + q <= r + 1e-9 for s, q in zip(spots, radii, strict=True))
    dots = pt.sunflower(spark.range(50).withColumn("g", F.lit(1)), ["g"], [F.col("id")], 0.5).select("dx", "dy").collect()
    near = min((a.dx - b.dx) ** 2 + (a.dy - b.dy) ** 2 for i, a in enumerate(dots) for b in dots[:i])
    assert near > 0.5


def test_a_store_follows_its_listings(spark, tmp_path):
    kind = "record string, row_hash string, file_hash string, listed_at int"
    days = [[("a", "1", "f", 1), ("b", "1", "f", 1), ("b", "2", "f", 2)], [("a", "1", "f", 3), ("b", "3", "g", 3), ("c", "1", "f", 3)]]
    for day, rows in enumerate(days):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.read_stream(spark, str(tmp_path / "in"), kind, files=1)
        windows.follow_listing(stream, str(tmp_path / "store"), "record string, row_hash string, file_hash string, status string, attempts int", "record", str(tmp_path / "cp"))
        stored = plugins.published(spark, str(tmp_path / "store"), "records")
        got = sorted((r.record, r.row_hash, r.status) for r in stored.collect())
        assert got == ([("a", "1", "new"), ("b", "2", "new")] if day == 0 else [("a", "1", "new"), ("b", "3", "new"), ("c", "1", "new")])
