"""Wide tables keep unlisted and null keys, shares of unknown totals are unknown, boxes hold their whiskers."""


from pyspark.sql import functions as F

from stockaudit.operators import aggregates, summaries, windows
from stockaudit.plans import accuracy


def test_rest_column_holds_unlisted_and_null(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 12, 7), ("a", 0, 2), ("a", None, 9)], "k string, f int, n int")
    row = aggregates.pivot_wide(df, ["k"], "f", {1: "one"}, "n", rest="other").first()
    assert (row.one, row.other) == (5, 18)
    row = aggregates.pivot_wide(df, ["k"], "f", {1: "one", None: "none"}, "n", rest="other").first()
    assert (row.one, row.none, row.other) == (5, 9, 9)


def test_regions_outside_the_list_count(spark):
    rows = [("BR", 10), ("UY", 90), (None, 5)]
    summary = spark.createDataFrame([(r, "A", "p", n) for r, n in rows], "region string, area string, period string, error_tuples int")
    table = accuracy.area_errors_by_region(summary, "p", "MZ").collect()
    assert [(r.area, r.br, r.other_region, r.total_errors) for r in table] == [("A", 10, 95, 105), ("Total", 10, 95, 105)]


def test_strict_shares(spark):
    df = spark.createDataFrame([("01", None), ("02", 30), ("03", 60)], "floor string, units int")
    order = [F.asc("floor")]
    strict = df.select(
        windows.share("units", strict=True).alias("s"), windows.cumulative_share("units", order, strict=True).alias("c")
    ).collect()
    assert [(r.s, r.c) for r in strict] == [(None, None)] * 3
    known = df.where("units IS NOT NULL").select(windows.cumulative_share("units", order, strict=True).alias("c")).collect()
    assert [round(r.c, 3) for r in known] == [0.333, 1.0]


def test_whiskers_reach_the_hinges(spark):
    df = spark.createDataFrame([("s", v) for v in (1, 10, 10, 10)], "g string, v int")
    row = summaries.box_stats(df, ["g"], "v").first()
    assert (row.q1, row.whisker_low, row.outliers) == (7.75, 7.75, 1)
