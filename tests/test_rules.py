"""Null, grouping and ordering rules on tables small enough to check by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from stockaudit.functions import scalars
from stockaudit.functions.stats import corr_pvalue, pairs, pearson
from stockaudit.operators import aggregates as agg
from stockaudit.operators import joins, ranking, summaries, windows
from stockaudit.plans import accuracy, density, divergence, layout, movement
from stockaudit.sources import schemas


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(df, column):
    return df.select(column.alias("x")).collect()[0]["x"]


def column(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


def detail(spark, *rows):
    """Rows of (site, area, level, address, sku, system, counted); the stated divergence is counted minus system."""
    full = [(*row, None if None in row[5:7] else row[6] - row[5], "2024-02-05", "c") for row in rows]
    return spark.createDataFrame(full, schemas.COUNT_DETAIL)


# --- nulls --------------------------------------------------------------------------------


def test_distinct_count_takes_null_as_a_value(spark):
    df = table(spark, "k string, x int", ("a", 1), ("a", None), ("a", 1), ("b", None), ("c", 2))
    got = df.groupBy("k").agg(agg.n_distinct("x").alias("n"))
    assert column(got, "k", "n") == [("a", 2), ("b", 1), ("c", 1)]
    assert df.where("false").agg(agg.n_distinct("x").alias("n")).collect()[0]["n"] == 0


def test_distinct_then_count_equals_sum_of_distinct_counts(spark):
    df = table(
        spark, "k string, a string, x int",
        ("p", "a1", 1), ("p", "a1", 1), ("p", "a1", None), ("p", "a2", 1), ("q", "a3", None), ("q", "a3", None),
    )
    got = agg.distinct_then_count(df, ["k"], ["a", "x"], "n")
    assert column(got, "k", "n") == [("p", 3), ("q", 1)]


def test_weighted_count_skips_nulls_and_gives_zero_for_none(spark):
    df = table(spark, "k string, w int", ("a", 1), ("a", None), ("b", None), (None, 4))
    got = agg.weighted_count(df, ["k"], "w")
    assert column(got, "k", "n") == sorted([("a", 1), ("b", 0), (None, 4)], key=repr)


def test_strict_aggregates_are_null_with_one_null(spark):
    df = table(spark, "k string, x int", ("a", 1), ("a", 3), ("b", 1), ("b", None))
    got = df.groupBy("k").agg(
        agg.sum_strict("x").alias("s"), agg.max_strict("x").alias("hi"), agg.min_strict("x").alias("lo"),
        agg.mean_strict("x").alias("m"),
    )
    assert column(got, "k", "s", "hi", "lo", "m") == [("a", 4, 3, 1, 2.0), ("b", None, None, None, None)]


def test_labels_of_unknown_divergence_are_null(spark):
    df = table(spark, "c int, s int", (3, 2), (1, 2), (2, 2), (None, 2))
    difference = scalars.divergence(F.col("c"), F.col("s"))
    got = df.select(
        scalars.divergence_type(difference).alias("t"), scalars.flag(difference != 0, "error", "ok").alias("f")
    ).collect()
    assert [tuple(row) for row in got] == [("Found", "error"), ("Lost", "error"), ("ok", "ok"), (None, None)]


def test_market_of_null_site_is_the_default(spark):
    df = table(spark, "s string", ("BR01",), ("MX9",), ("AR01",), (None,))
    got = [row[0] for row in df.select(scalars.market_of(F.col("s"))).collect()]
    assert got == ["BR", "MX", "OTHER", "OTHER"]
    for market in ("BR", "MX", "OTHER"):
        by_label = df.where(scalars.market_of(F.col("s")) == market)
        assert column(df.where(scalars.in_market(F.col("s"), market)), "s") == column(by_label, "s")


def test_membership_matches_null_with_null(spark):
    df = table(spark, "s string, n int", ("a", 1), (None, 2), ("b", 3))
    values = table(spark, "v string", ("a",), (None,), ("a",))
    assert column(joins.keep_matching(df, "s", values), "n") == [(1,), (2,)]


def test_membership_without_broadcast_gives_the_same(spark):
    df = table(spark, "s string, n int", ("a", 1), (None, 2), ("b", 3))
    values = table(spark, "v string", ("a",), (None,))
    shuffled = joins.keep_matching(df, "s", values, max_rows=1)
    assert column(shuffled, "n") == [(1,), (2,)]


def test_attach_matches_null_keys_and_keeps_unmatched_rows(spark):
    df = table(spark, "k string, n int", ("a", 1), (None, 2), ("z", 3))
    got = joins.attach(df, table(spark, "k string, t int", ("a", 10), (None, 20)), ["k"])
    assert column(got, "k", "n", "t") == sorted([("a", 1, 10), (None, 2, 20), ("z", 3, None)], key=repr)


def test_division_by_zero_is_null(spark):
    assert one(spark.range(1), scalars.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("text,number", [("05", 5.0), ("", None), ("XX", None), ("1.5", 1.5), (None, None)])
def test_number_parse(spark, text, number):
    assert one(spark.range(1), scalars.parse_number(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize("text,moment", [
    ("15/01/2024 10:11:12", datetime.datetime(2024, 1, 15, 10, 11, 12)),
    ("n/a", None), ("", None), ("31/02/2024 00:00:00", None), ("2024-01-15 10:11:12", None), (None, None),
    ("1/2/2024 3:04:05", datetime.datetime(2024, 2, 1, 3, 4, 5)), ("01-02-24 03.04.05", datetime.datetime(2024, 2, 1, 3, 4, 5)),
    ("01022024 030405", datetime.datetime(2024, 2, 1, 3, 4, 5)), ("01/02/69 00:00:00", datetime.datetime(1969, 2, 1)),
    ("1/2/2024 25:00:00", None),
])
def test_timestamp_parse(spark, text, moment):
    assert one(spark.range(1), scalars.parse_timestamp(F.lit(text).cast("string"))) == moment


@pytest.mark.parametrize("text,date", [
    ("2024-02-29", datetime.date(2024, 2, 29)), ("2023-02-29", None), ("x", None), ("", None), (None, None),
    ("20240201", datetime.date(2024, 2, 1)), ("2024/02/01", datetime.date(2024, 2, 1)), ("2024.2.1", datetime.date(2024, 2, 1)),
    ("24-02-01", datetime.date(2024, 2, 1)), ("690201", datetime.date(1969, 2, 1)), ("2024/13/01", None),
])
def test_date_parse(spark, text, date):
    assert one(spark.range(1), scalars.parse_date(F.lit(text).cast("string"))) == date


def test_error_reports_follow_the_stated_divergence(spark):
    rows = [
        ("BR01", "MZ", 1, "MZ-a", 1, 5, 5, 2, "2024-02-05", "c"), ("BR01", "MZ", 1, "MZ-a", 2, 5, 9, 0, "2024-02-05", "c"),
        ("BR01", "MZ", 1, "MZ-a", 3, 5, None, -1, "2024-02-05", "c"), ("BR01", "MZ", 1, "MZ-a", 4, 5, 6, None, "2024-02-05", "c"),
    ]
    df = spark.createDataFrame(rows, schemas.COUNT_DETAIL)
    assert column(divergence.address_errors(df), "error_skus", "ok_skus") == [(2, 1)]
    assert column(divergence.market_totals(df), "addresses", "skus") == [(1, 2)]
    found = divergence.level_type_share(df, "BR", 2)
    assert column(found, "divergence_type", "n") == [("Found", 2)]


@pytest.mark.parametrize("fraction", [0.001, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0])
@pytest.mark.parametrize("in_order", [1, 7, 100_000])
def test_top_fraction_by_brackets(spark, fraction, in_order):
    """Heavy ties at both ends and in the middle, nulls, and brackets down to one row."""
    values = [None] * 50 + [1.0] * 400 + [500.5] * 300 + [9000.0] * 200 + [float(i * 37 % 1009) for i in range(1050)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted(r.v for r in ranking.top_fraction_ties(df, "v", fraction, in_order).collect())
    known = sorted((v for v in values if v is not None), reverse=True)
    allowed = math.floor(fraction * len(values))
    assert got == sorted(v for v in known if known.index(v) + 1 <= allowed)


@pytest.mark.parametrize("text,word", [("Put away", "Put"), (" adjustment", None), ("", None), ("One", "One")])
def test_first_word(spark, text, word):
    assert one(spark.range(1), scalars.first_word(F.lit(text))) == word


def test_address_parts_past_the_end_are_empty(spark):
    df = table(spark, "address_id string", ("MZ-1-002-003-04",), ("RK-0-000-000-XX",), ("MZ",), (None,))
    got = scalars.parse_address(df, numeric_floor=True).select("area", "zone", "aisle", "module", "floor").collect()
    assert [tuple(row) for row in got] == [
        ("MZ", "1", "002", "003", 4.0), ("RK", "0", "000", "000", None), ("MZ", "", "", "", None), (None,) * 5,
    ]


@pytest.mark.parametrize("value,digits,label", [
    (0.0625, 1, "6.2%"), (0.0635, 1, "6.4%"), (0.5, 0, "50%"), (0.005, 0, "0%"), (0.015, 0, "2%"), (None, 1, None),
    (1.0, 2, "100.00%"),
])
def test_percent_label_rounds_half_even(spark, value, digits, label):
    assert one(spark.range(1), scalars.pct_label(F.lit(value).cast("double"), digits)) == label


def test_month_labels(spark):
    df = table(spark, "m int", (1,), (2,), (12,), (None,))
    assert [row[0] for row in df.select(scalars.month_label(F.col("m"))).collect()] == ["jan", "fev", "dez", None]


# --- correlation --------------------------------------------------------------------------


def correlation(spark, points):
    df = spark.createDataFrame(points, "x double, y double")
    got = df.agg(pearson(F.col("x"), F.col("y")).alias("r"), pairs(F.col("x"), F.col("y")).alias("n"))
    return got.select("r", "n", corr_pvalue(F.col("r"), F.col("n")).alias("p")).collect()[0]


def test_correlation_of_a_constant_or_of_two_points_is_null(spark):
    assert tuple(correlation(spark, [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)])) == (None, 3, None)
    assert tuple(correlation(spark, [(1.0, 1.0), (2.0, 2.0)])) == (None, 2, None)


def test_correlation_skips_incomplete_pairs(spark):
    got = correlation(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 9.0), (9.0, None)])
    assert (round(got["r"], 12), got["n"]) == (1.0, 3)


def test_perfect_correlation_has_p_zero(spark):
    df = spark.createDataFrame([(1.0, 5), (-1.0, 4)], "r double, n long")
    assert [row[0] for row in df.select(corr_pvalue(F.col("r"), F.col("n"))).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("df,t", [(1, 12.7062), (2, 4.3027), (3, 3.1824), (4, 2.7764), (5, 2.5706), (10, 2.2281), (15, 2.1314)])
def test_p_value_at_tabulated_critical_values(spark, df, t):
    r = t / math.sqrt(df + t * t)
    got = one(spark.range(1), corr_pvalue(F.lit(r), F.lit(df + 2)))
    assert got == pytest.approx(0.05, abs=1e-4)


# --- grouping and ordering ----------------------------------------------------------------


def test_share_is_within_the_remaining_keys(spark):
    df = table(spark, "s string, l int, n int", ("a", 1, 1), ("a", 2, 3), ("b", 1, 5))
    got = df.withColumn("share", windows.share("n", ["s"]))
    assert column(got, "s", "l", "share") == [("a", 1, 0.25), ("a", 2, 0.75), ("b", 1, 1.0)]


def test_share_of_nothing_is_null(spark):
    df = table(spark, "n int", (0,), (0,))
    assert column(df.withColumn("share", windows.share("n")), "share") == [(None,), (None,)]


def test_total_of_skips_nulls(spark):
    df = table(spark, "s string, n int", ("a", None), ("a", 2), ("b", None))
    got = df.withColumn("t", windows.total_of("n", ["s"]))
    assert sorted(row["t"] for row in got.collect()) == [0, 2, 2]


def test_first_k_follows_the_given_order(spark):
    df = table(spark, "s string, k int", ("a", 3), ("a", 1), ("a", 2), ("b", 9))
    assert column(windows.first_k(df, ["s"], [F.asc("k")], 2), "s", "k") == [("a", 1), ("a", 2), ("b", 9)]


@pytest.mark.parametrize("values,flags", [
    ([9, 9, 5], {9: True, 5: False}),
    ([9, 5, 5], {9: True, 5: False}),
    ([9, 9, 9], {9: True}),
    ([9, 9, 9, 9], {9: False}),
    ([9, 5, 1], {9: True, 5: True, 1: False}),
])
def test_top_two_by_average_rank(spark, values, flags):
    df = spark.createDataFrame([("a", v) for v in values], "s string, v int")
    got = df.withColumn("top", windows.top_flag("v", ["s"], 2)).collect()
    assert {row["v"]: row["top"] for row in got} == flags


def test_order_index_breaks_ties_by_name(spark):
    df = table(spark, "c string, v int", ("b", 2), ("a", 1), ("a", 1), ("c", 5), (None, 0))
    got = windows.order_index(df, "c", "v", "i")
    assert dict(column(got, "c", "i")) == {"c": 1, "a": 2, "b": 3, None: 4}
    mean_up = windows.order_index(df, "c", "v", "i", aggregate=F.avg, descending=False)
    assert dict(column(mean_up, "c", "i")) == {None: 1, "a": 2, "b": 3, "c": 4}


def test_running_share_goes_row_by_row(spark):
    df = table(spark, "k string, n int", ("a", 2), ("b", 2), ("c", 4))
    order = [F.desc("n"), F.asc("k")]
    got = df.withColumn("r", windows.cumulative_share("n", order))
    assert column(got, "k", "r") == [("a", 0.75), ("b", 1.0), ("c", 0.5)]


def test_fixed_order(spark):
    df = table(spark, "t string", ("Lost",), ("Found",), ("ok",))
    got = [row[0] for row in df.select(windows.fixed_order(F.col("t"), ("Lost", "Found"))).collect()]
    assert got == [1, 2, None]


def test_pivot_fills_or_leaves_null(spark):
    df = table(spark, "k string, c string, n int", ("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 7))
    columns = {"x": "cx", "y": "cy", None: "none"}
    assert column(agg.pivot_wide(df, ["k"], "c", columns, "n"), "k", "cx", "cy", "none") == [
        ("a", 1, 2, None), ("b", 3, None, 7),
    ]
    assert column(agg.pivot_wide(df, ["k"], "c", columns, "n", fill=0), "k", "cx", "cy", "none") == [
        ("a", 1, 2, 0), ("b", 3, 0, 7),
    ]


def test_total_row(spark):
    df = table(spark, "k string, n int, other int", ("a", 1, 5), ("b", 2, 6))
    got = agg.with_total_row(df, {"k": "all"}, {"n": F.sum("n")})
    assert column(got, "k", "n", "other") == [("a", 1, 5), ("all", 3, None), ("b", 2, 6)]


# --- top-k and top fraction ---------------------------------------------------------------


def test_top_n_keeps_ties_and_drops_nulls(spark):
    df = spark.createDataFrame([(v,) for v in (5, 4, 4, 4, 3, None)], "v int")
    assert sorted(row[0] for row in ranking.top_n_ties(df, "v", 2).collect()) == [4, 4, 4, 5]
    assert sorted(row[0] for row in ranking.top_n_ties(df, "v", 50).collect()) == [3, 4, 4, 4, 5]


@pytest.mark.parametrize("values,fraction", [
    ([5, 4, 4, 4, 3, None, None, None, None, None], 0.2),
    ([5, 4, 4, 4, 3, None, None, None, None, None], 0.1),
    ([5, 4, 4, 4, 3], 0.1),
    ([1, 2, 3], 1.0),
    ([None, None, 7], 1.0),
    ([i % 37 for i in range(400)], 0.155),
    ([7] * 300 + list(range(100)), 0.5),
])
def test_top_fraction_against_plain_ranks(spark, values, fraction):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    known = [v for v in values if v is not None]
    expected = sorted(v for v in known if 1 + sum(w > v for w in known) <= fraction * len(values))
    assert sorted(row[0] for row in ranking.top_fraction_ties(df, "v", fraction).collect()) == expected


# --- summaries ----------------------------------------------------------------------------


def test_numeric_summary_by_hand(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10, None)] + [("b", 4), ("c", None)], "k string, v int")
    got = {row["k"]: row for row in summaries.numeric_summary(df, ["k"], ["v"]).collect()}
    names = ("min", "q1", "median", "mean", "q3", "max", "nulls")
    assert tuple(got["a"][n] for n in names) == (1, 1.75, 2.5, 4.0, 4.75, 10, 1)
    assert tuple(got["b"][n] for n in names) == (4, 4.0, 4.0, 4.0, 4.0, 4, 0)
    assert tuple(got["c"][n] for n in names) == (None, None, None, None, None, None, 1)


def test_box_statistics_by_hand(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 5, 30)] + [("b", 2), ("b", 99)], "k string, v int")
    got = {row["k"]: row for row in summaries.box_stats(df, ["k"], "v").collect()}
    a = got["a"]
    assert (a["q1"], a["median"], a["q3"]) == (2.25, 3.5, 4.75)
    assert (a["whisker_low"], a["whisker_high"], a["outliers"], a["rows"]) == (1, 5, 1, 6)
    cut = {row["k"]: row["rows"] for row in summaries.box_stats(df, ["k"], "v", upper=20).collect()}
    assert cut == {"a": 5, "b": 1}


# --- reports ------------------------------------------------------------------------------


def test_density_counts_wrong_and_right_apart(spark):
    df = detail(
        spark,
        ("BR01", "MZ", 1, "MZ-a", 1, 5, 6), ("BR01", "MZ", 1, "MZ-a", 1, 5, 5), ("BR01", "MZ", 1, "MZ-a", None, 5, 6),
        ("BR01", "MZ", 1, "MZ-b", 2, 5, None),
    )
    got = divergence.address_errors(df)
    assert column(got, "address_id", "error_skus", "ok_skus", "density") == [("MZ-a", 2, 1, 3), ("MZ-b", 0, 0, 0)]


def test_first_densities_take_those_with_errors_first(spark):
    rows = []
    for n in (1, 2, 3):  # address of density n; only density 3 has an error
        for sku in range(n):
            rows.append(("MX01", "MZ", 1, f"MZ-{n}", sku, 5, 6 if n == 3 and sku == 0 else 5))
    got = divergence.density_accuracy(detail(spark, *rows), "MZ", "MX", first=2)
    assert column(got, "density", "error_tuples", "ok_tuples") == [(1, 0, 1), (3, 3, 0)]


def test_absent_cells_stay_null_in_density_tuples(spark):
    df = detail(spark, ("BR01", "MZ", 1, "MZ-a", 1, 5, 6), ("BR01", "MZ", 1, "MZ-b", 2, 5, 5), ("BR01", "MZ", 1, "MZ-b", 3, 5, 5))
    got = divergence.density_tuples(df, "MZ")
    assert column(got, "density", "tuples_error", "tuples_ok", "addresses_error", "addresses_ok") == [
        (1, 1, None, 1, None), (2, None, 2, None, 1),
    ]


def test_uncounted_lines_have_a_null_type(spark):
    df = detail(spark, ("MX01", "MZ", 1, "MZ-a", 1, 5, None), ("MX01", "MZ", 1, "MZ-a", 2, 5, 4))
    got = divergence.level_type_tuples(df, "MX", "MZ")
    assert column(got, "divergence_type", "tuples") == sorted([("Lost", 1), (None, 1)], key=repr)


def test_missing_stock_share_gives_no_label(spark):
    df = detail(spark, ("BR01", "MZ", 1, "MZ-a", 1, 5, 6))
    share = spark.createDataFrame([("BR02", 0.5)], "site_id string, share_ge double")
    row = divergence.bucket_errors(df, share, "MZ").collect()[0]
    assert (row["errors"], row["stock_share_ge"], row["site_label"]) == (1, None, None)


def summary(spark, *rows):
    """Rows of (site, area, population, p_hat, accurate, target_site)."""
    full = [
        (f"c{i}", site, area, 1, "BR", "2024 | 02", "closed", population, p, accurate, 1, target, 0.8)
        for i, (site, area, population, p, accurate, target) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.CYCLE_SUMMARY)


def test_site_table_by_hand(spark):
    df = summary(
        spark, ("BR01", "MZ", 10, 0.5, 5, 0.9), ("BR01", "MZ", 30, 0.1, 27, 0.9), ("BR02", "MZ", 60, 0.0, 60, 0.9),
        ("BR02", "MZ", 99, None, 1, 0.9), ("BR03", "PW", 7, 0.1, 6, 0.9),
    )
    got = accuracy.site_table(df, "BR", "2024 | 02", "MZ", "BR total")
    rows = [(r["site_id"], r["population"], round(r["accurate"], 9), r["target"], round(r["accuracy"], 9), r["goal"], r["site_weight"]) for r in got.collect()]
    assert rows == [
        ("BR total", 100, 92.0, 0.8, 0.92, None, None),
        ("BR02", 60, 60.0, 0.9, 1.0, "OK", 0.6),
        ("BR01", 40, 32.0, 0.9, 0.8, "NotOK", 0.4),
    ]


def test_impact_orders_areas_by_total_times_rows(spark):
    # MZ has errors 10 on one stratum, PW 6 on two: 10 * 1 < 6 * 2.
    df = summary(
        spark, ("BR01", "MZ", 20, 0.5, 10, 0.4), ("BR01", "PW", 10, 0.3, 7, 0.4), ("BR02", "PW", 10, 0.3, 7, 0.9),
    )
    got = {(r["site_id"], r["area"]): r for r in accuracy.impact(df, "BR", "2024 | 02").collect()}
    assert {key[1]: row["area_order"] for key, row in got.items()} == {"PW": 1, "MZ": 2}
    row = got["BR01", "MZ"]
    assert row["area_label"] == "MZ(62.5%)"
    assert row["site_label"] == "BR01    (81.2%)\nTarget 40.00%\n***** INAC 56.67%"
    assert (row["meets_target"], row["site_part"], row["site_order"]) == (True, 10 / 17, 2)
    assert got["BR02", "PW"]["goal_mark"] == ""


def test_shares_precede_the_density_cut(spark):
    df = spark.createDataFrame(
        [("BR01", "MZ-a", 1), ("BR01", "MZ-b", 9), ("BRTR1", "MZ-c", 1), ("BR02", "MZ-d", 1)], schemas.ADDRESS_DENSITY
    )
    got = density.share_histogram(df, ("BR01", "BRTR1"), "BR", "TR")
    assert column(got, "site_id", "sku_count", "share", "density_order") == [("BR01", 1, 0.5, 1)]


def test_an_address_with_unknown_units_adds_nothing_to_its_floor(spark):
    rows = [
        ("BR01", "MZ-0-000-000-01", 1, 4, "n/a", 1, None), ("BR01", "MZ-0-000-001-01", 1, 2, "n/a", 1, None),
        ("BR01", "MZ-0-000-001-01", 2, None, "n/a", 1, None), ("BR01", "MZ-0-000-002-02", 1, 12, "n/a", 1, None),
    ]
    got = layout.floor_share_wide(spark.createDataFrame(rows, schemas.ADDRESS_STOCK), "MZ", floors=(1, 2))
    assert column(got, "floor_1", "floor_2", "floor_none") == [(0.25, 0.75, None)]


def test_one_unreadable_update_hides_the_last_update(spark):
    rows = [
        ("BR01", "MZ-a", 1, 1, "01/02/2024 00:00:00", 1, None), ("BR01", "MZ-a", 2, 1, "n/a", 1, None),
        ("BR01", "MZ-b", 1, 1, "01/02/2024 00:00:00", 1, None), ("BR01", "MZ-b", 1, 1, "03/01/2024 00:00:00", 1, None),
    ]
    got = layout.tuple_base(spark.createDataFrame(rows, schemas.ADDRESS_STOCK))
    assert column(got, "address_id", "skus", "last_update") == [
        ("MZ-a", 2, None), ("MZ-b", 1, datetime.datetime(2024, 2, 1)),
    ]


def test_touches_keep_empty_destinations(spark):
    rows = [("Put away", 1, 1, "MZ-0-000-000-01", "", "15/01/2024 00:00:00", 1)]
    got = movement.touches(spark.createDataFrame(rows, schemas.MOVEMENTS))
    assert column(got, "process", "place", "floor", "area") == [("Put", "", "", ""), ("Put", "MZ-0-000-000-01", "01", "MZ")]
