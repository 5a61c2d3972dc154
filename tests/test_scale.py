"""Operators that bound what one task sees: sets of numbers, top groups, quantiles, set filters, p-values."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockaudit.functions.stats import corr_pvalue
from stockaudit.operators import joins, ranking, sets, summaries
from stockaudit.operators.aggregates import distinct_then_count
from stockaudit.plans import divergence, layout, registry
from stockaudit.sources import derived, schemas
from stockaudit.sources.dates import with_update_times

COUNTED_TWICE = ["stock_overview", "stock_zone_summary", "stock_area_summary", "stock_floor_cumulative", "div_market_totals"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


# --- sets -----------------------------------------------------------------------------------


def test_sets_count_null_and_unite(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["x", "y"]), draw.choice([None, *range(40)]), draw.choice([None, "", "q", "r"]), draw.choice([1, 2, None] if i % 50 == 0 else [1, 2])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, j string, n long, t string, u int").repartition(5)
    numbered = sets.numbered(df, {"n": "n_no", "t": "t_no"})
    want = defaultdict(lambda: (set(), set(), []))
    for k, _, n, t, u in rows:
        for group, value in zip(want[k], (n, t)):
            group.add(value)
        want[k][2].append(u)
    want = {k: (len(n), len(t), None if None in u else sum(u)) for k, (n, t, u) in want.items()}
    got = sets.distinct_totals(numbered, ["k"], {"ns": "n_no", "ts": "t_no"}, strict_sum="u")
    assert {r.k: (r.ns, r.ts, r.u) for r in got.collect()} == want
    fine = sets.value_sets(numbered, ["k", "j"], "n_no")
    coarse = sets.set_sizes(sets.united(fine, ["k"]), ["k"], "ns")
    assert {r.k: r.ns for r in coarse.collect()} == {k: v[0] for k, v in want.items()}
    assert sets.set_sizes(fine, ["k"], "ns").where("k = 'a'").first().ns > want["a"][0]


def test_sets_over_many_buckets(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("v"), F.col("id") % 70_001).alias("v"))
    got = sets.distinct_totals(sets.numbered(df, {"v": "no"}), ["k"], {"n": "no"})
    assert {r.k: r.n for r in got.collect()} == {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert sets.value_sets(sets.numbered(df, {"v": "no"}), [], "no").count() >= 3


def test_empty_sets(spark):
    df = spark.createDataFrame([], "k string, n long, u int")
    numbered = sets.numbered(df, {"n": "no"})
    assert sets.distinct_totals(numbered, ["k"], {"ns": "no"}, strict_sum="u").collect() == []
    assert [tuple(r) for r in sets.distinct_totals(numbered, [], {"ns": "no"}, strict_sum="u").select("u", "ns").collect()] == [(None, 0)]


@pytest.mark.parametrize("name", COUNTED_TWICE)
def test_two_distinct_counts_expand_no_row(name, spark, sf_dir):
    text = plan(registry.REPORTS[name](spark, sf_dir))
    assert "Expand" not in text and "Generate" not in text and "bitmap" in text


def test_reports_without_numbers_give_the_same(spark, sf_dir):
    stock = derived.address_stock(spark, sf_dir)
    bare = stock.drop("address_no", "sku_no", "updated_at")
    in_area = (layout.sku_rollup, layout.aisle_top, layout.sku_summary, layout.sku_histogram, layout.site_tuples)
    for report in (layout.area_summary, lambda s: layout.floor_cumulative(s, "MU"), layout.tuple_top, *(lambda s, r=r: r(s, "MZ") for r in in_area)):
        assert sorted(report(stock).collect(), key=repr) == sorted(report(bare).collect(), key=repr)
    detail = derived.count_detail(spark, sf_dir)
    bare = detail.drop("address_no", "sku_no")
    in_area = (divergence.density_frequency, divergence.bucket_totals, divergence.level_top, divergence.density_tuples)
    for report in (divergence.market_totals, divergence.address_errors, *(lambda d, r=r: r(d, "MZ") for r in in_area)):
        assert sorted(report(detail).collect(), key=repr) == sorted(report(bare).collect(), key=repr)


def test_landed_numbers_stand_for_values(spark, sf_dir):
    for name in schemas.NUMBERED:
        lines = derived.table(spark, sf_dir, name)
        for column, number in schemas.NUMBERS.items():
            pairs = lines.select(column, number).distinct()
            known = pairs.where(F.col(column).isNotNull())
            assert known.count() == known.select(column).distinct().count() == known.select(number).distinct().count()
            assert {r[1] for r in pairs.where(F.col(column).isNull()).collect()} <= {sets.NULL_NUMBER}


# --- top groups -----------------------------------------------------------------------------


def test_top_groups_compute_their_counts_once(spark, sf_dir):
    stock = derived.address_stock(spark, sf_dir)
    counts = distinct_then_count(stock, ["address_no"], ["sku_no"], "skus")
    text = final_plan(ranking.top_n_ties(counts, "skus", 50))
    pairs = [keys for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text) if "sku_no" in keys]
    assert "ReusedExchange" in text and "TakeOrderedAndProject" in text
    assert len(pairs) <= 1 and text.count("FileScan") <= 1


def test_only_updates_of_top_groups_are_aggregated(spark, sf_dir):
    text = plan(layout.tuple_top(derived.address_stock(spark, sf_dir)))
    assert "BroadcastHashJoin" in text and text.count("FileScan") == 1
    assert "sku_id" not in text and "updated_text" not in text


@pytest.mark.parametrize("name", ["tuple_base", "tuple_top50"])
def test_update_times_are_typed_on_landing(name, spark, sf_dir):
    text = plan(registry.REPORTS[name](spark, sf_dir))
    for pattern in ("regexp", "RLIKE", "rlike", "updated_text"):
        assert pattern not in text


def test_top_groups_with_nulls_and_ties(spark):
    rows = [(None, 1, 5), (None, 2, None), ("a", 1, 7), ("a", 2, 9), ("b", 1, 3), ("c", 1, 1), ("c", 1, 2)]
    lines = spark.createDataFrame(rows, "g string, s int, t int")
    counts = distinct_then_count(lines, ["g"], ["s"], "n")
    got = ranking.top_groups_ties(counts, "g", "n", 1, lines, {"last": F.max("t"), "rows": F.count(F.lit(1))})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 2, 5, 2), ("a", 2, 9, 2)], key=repr)
    stock = with_update_times(spark.createDataFrame([("s", "MZ-1", 1, 1, "01/02/2024 00:00:00", 1, 1.0), ("s", "MZ-1", 2, 1, "n/a", 1, 1.0)], schemas.ADDRESS_STOCK))
    assert [(r.skus, r.last_update) for r in layout.tuple_top(stock).collect()] == [(2, None)]


# --- quantiles ------------------------------------------------------------------------------


def numpy_summary(values):
    known = np.array([v for v in values if v is not None], float)
    if not len(known):
        return (None,) * 6 + (len(values),)
    return (known.min(), *np.quantile(known, [0.25, 0.5]), known.mean(), np.quantile(known, 0.75), known.max(), len(values) - len(known))


def test_quantiles_of_a_continuous_measure_in_bounded_parts(spark, tmp_path):
    """A million different values, a third of all in one group."""
    import pyarrow.parquet as pq

    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("g")
    spark.range(1_000_000).select(group, F.randn(5).alias("v")).write.parquet(str(tmp_path / "t"))
    df, written = spark.read.parquet(str(tmp_path / "t")), pq.read_table(str(tmp_path / "t"))
    values, groups = written["v"].to_numpy(), written["g"].to_numpy()
    parts = summaries.sorted_parts(summaries.value_counts(df, ["g"], ["v"]), ["g", "measure"])
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * len(values) / len(sizes)
    # Values are ranked within a part; only totals per part are windowed per group.
    windows = re.findall(r"Window \[.*", plan(summaries.quantiles(parts, ["g", "measure"])))
    assert windows and all("part#" in line or "_rows#" in line for line in windows)
    got = {r.g: r for r in summaries.numeric_summary(df, ["g"], ["v"]).collect()}
    for g in range(50):
        want = numpy_summary(values[groups == g])
        assert np.allclose([float(x) for x in got[g][2:]], want, rtol=1e-9, atol=1e-9)
    box = {r.g: r for r in summaries.box_stats(df, ["g"], "v").collect()}
    for g in (0, 7, 49):
        mine = values[groups == g]
        q1, q3 = np.quantile(mine, [0.25, 0.75])
        inside = mine[(mine >= q1 - 1.5 * (q3 - q1)) & (mine <= q3 + 1.5 * (q3 - q1))]
        assert (box[g].whisker_low, box[g].whisker_high, box[g].outliers) == (inside.min(), inside.max(), len(mine) - len(inside))


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_of_random_groups(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["a", "b", None, "c"]), draw.choice([None, None, 0, -3, draw.randrange(5), draw.randrange(100)])) for _ in range(draw.choice([1, 5, 60, 400]))]
    rows.append(("nothing", None))
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    got = {r.g: tuple(r)[2:] for r in summaries.numeric_summary(df, ["g"], ["v"]).collect()}
    for g in {r[0] for r in rows}:
        want = numpy_summary([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(want) if want[0] is not None else got[g] == want


def test_summaries_of_empty_tables(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert summaries.numeric_summary(df, ["g"], ["v"]).collect() == [] and summaries.box_stats(df, ["g"], "v").collect() == []
    assert summaries.numeric_summary(df, [], ["v"]).collect() == []


# --- set filters ----------------------------------------------------------------------------


def test_a_large_set_filters_the_scan(spark, tmp_path):
    spark.range(50_000).select(F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), "id")).alias("s"), "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    values = spark.range(0, 50_000, 50).select(F.when(F.col("id") % 500 != 0, F.concat(F.lit("v"), F.col("id") + 1)).alias("v"))
    few = joins.keep_matching(df, "s", values, max_rows=5)
    many = joins.keep_matching(df, "s", values)
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in many.collect())
    text = plan(few)
    scan_filter = text[: text.index("FileScan")].rsplit("Filter", 1)[1]
    assert "xxhash64" in scan_filter and "Subquery" in scan_filter and "LeftSemi" in text
    assert "xxhash64" not in plan(many)
    words = joins.filter_words(901)
    passed = df.where(joins.may_be_in(F.col("s"), joins.membership_filter(values, words), words)).count()
    assert few.count() <= passed < 1.1 * few.count() + 500


def test_filters_are_bounded():
    assert [joins.filter_words(n) for n in (0, 1, 6, 1000, 10**9)] == [1, 1, 2, 256, joins.FILTER_WORDS]


# --- p-values -------------------------------------------------------------------------------


def exact_pvalue(r: float, n: int) -> float:
    """The finite sum for an even number of degrees of freedom, in extended precision."""
    sine, cosine_sq = np.longdouble(abs(r)), 1 - np.longdouble(r) ** 2
    j = np.arange(1, (n - 2) // 2, dtype=np.longdouble)
    terms = np.concatenate(([np.longdouble(1)], np.cumprod((2 * j - 1) / (2 * j) * cosine_sq)))
    return float(1 - sine * terms.sum())


def test_p_values_do_not_depend_on_the_number_of_pairs(spark):
    cases = [(0.0, 10)] + [(t / math.sqrt(n - 2 + t * t), n) for n in (4, 10, 1000, 100_000, 10_000_000) for t in (1e-4, 0.2, 0.9, 1.1, 1.7, 2.6, 4.0)]
    df = spark.createDataFrame(cases, "r double, n long").select("r", "n", corr_pvalue(F.col("r"), F.col("n")).alias("p"))
    for row in df.collect():
        assert row.p == pytest.approx(exact_pvalue(row.r, row.n), abs=1e-10)
