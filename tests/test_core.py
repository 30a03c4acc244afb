import datetime

from pyspark.sql import functions as F

import __spark_entry__
from corvane.functions import text as tx
from corvane.operators import relational as rel
from corvane.operators import statistics as st


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_core_query_has_an_oracle():
    from corvane.plans import catalog

    assert set(catalog.QUERIES) - catalog.WITHOUT_SQL == set(catalog.ORACLES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_upsert_is_idempotent(spark):
    listing = spark.createDataFrame([("a", "1", "f"), ("b", "2", "f"), ("c", "3", "g")], "k string, row_hash string, file_hash string")
    stored = spark.createDataFrame(
        [("b", "x", "f", "classified"), ("c", "x", "f", "classified"), ("d", "4", "f", "failed")],
        "k string, row_hash string, file_hash string, status string")
    assert rows(rel.upsert_diff(listing, stored, "k")) == [
        ("a", "insert", "new"), ("b", "update", "extracted"), ("c", "update", "new"), ("d", "keep", "failed")]
    again = rel.upsert_diff(listing, listing.withColumn("status", F.lit("new")), "k")
    assert {r["action"] for r in again.collect()} == {"unchanged"}


def test_dates_pivot_on_today(spark):
    df = spark.createDataFrame([("7/2/52",), ("3/23/26",), ("2/30/20",), ("N/A",), (None,)], "v string")
    found = [r[0] for r in df.select(tx.us_date(F.col("v"), 2026)).collect()]
    assert found == [datetime.date(1952, 7, 2), datetime.date(2026, 3, 23), None, None, None]


def test_repeats_are_numbered_in_order(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "k string, n int")
    out = rel.number_repeats(df, F.col("k"), [F.col("n")], "id").select("n", "id")
    assert rows(out) == [(1, "x"), (2, "x#2"), (3, "y")]


def test_lift_is_symmetric_in_naming(spark):
    items = [(u, i) for u in range(8) for i in ("a", "b")] + [(u, "c") for u in range(8, 16)]
    found = rows(st.cooccurrence(spark.createDataFrame(items, "u int, i string"), "u", "i"))
    assert found == [("a", "b", 8, 2.0)]


def test_waves_are_islands(spark):
    counts = [(y, 100 if y in (20, 21) else 2) for y in range(40)]
    out = st.waves(spark.createDataFrame(counts, "s long, n long"), "s").collect()
    assert [(r["first"], r["last"], r["total"], r["peak"]) for r in out] == [(20, 21, 200, 20)]
