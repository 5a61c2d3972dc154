"""Relations that must hold within and between reports on the test data."""

import pytest
from pyspark.sql import functions as F

from stockaudit.plans import registry
from stockaudit.sources import derived


@pytest.fixture(scope="module")
def report(spark, sf_dir):
    return lambda name: registry.REPORTS[name](spark, sf_dir)


@pytest.mark.parametrize("name,by,share", [
    ("acc_site_table", [], "site_weight"), ("div_level_type_share", ["site_id", "level"], "share"),
    ("density_freq", ["market", "site_id"], "share"), ("div_level_share", ["site_id"], "share"),
    ("aisle_top10", ["site_id"], "share"), ("category_pareto", [], "share"), ("floor_top5", [], "share"),
    ("sku_hist20", [], "share"), ("stock_floor_cumulative", [], "units_share"), ("mov_touch_levels", [], "share"),
])
def test_shares_add_up(report, name, by, share):
    for row in report(name).groupBy(*by).agg(F.sum(share).alias("total")).collect():
        assert row["total"] is None or row["total"] == pytest.approx(1.0)


@pytest.mark.parametrize("name,running", [
    ("category_pareto", "running_share"), ("sku_hist20", "running_share"), ("spread_tail", "running_share"),
    ("rest_floor_cumulative", "units_running"), ("mz_floor_cumulative", "skus_running"),
])
def test_running_shares_end_at_one(report, name, running):
    assert report(name).agg(F.max(running)).collect()[0][0] == pytest.approx(1.0)


def test_divergence_types_cover_all_lines(report):
    counts = {r["divergence_type"]: r["count"] for r in report("count_base").groupBy("divergence_type").count().collect()}
    assert set(counts) == {"Lost", "Found", "ok", None}
    assert sum(counts.values()) == report("count_base").count()


def test_total_row_is_the_sum_of_rows(report):
    rows = {row["area"]: row for row in report("err_area_by_region").collect()}
    total = rows.pop("Total")
    for name in ("br", "mx", "other", "total_errors"):
        assert total[name] == sum(row[name] for row in rows.values())


@pytest.mark.parametrize("name,k,column", [("sku_spread_top", 123, "addresses"), ("tuple_top50", 50, "skus"), ("onhand_top6", 6, "units")])
def test_top_k_has_at_least_k_rows_and_stops_at_the_kth(report, name, k, column):
    values = sorted((row[column] for row in report(name).select(column).collect()), reverse=True)
    assert len(values) >= k and values[k - 1] == values[-1]


def test_touches_are_two_per_move(report, spark, sf_dir):
    assert report("mov_touch").count() == 2 * derived.movements(spark, sf_dir).count()


def test_tuples_agree_between_reports(report):
    by_site = {row["site_id"]: row["tuples"] for row in report("site_tuples").collect()}
    summed = report("address_summary").groupBy("site_id").agg(F.sum("skus").alias("n")).collect()
    assert by_site == {row["site_id"]: row["n"] for row in summed}


def test_a_hot_address_and_sku_give_the_same_result(spark):
    """A third of the lines in one address and a third of one SKU, against plain counting."""
    from stockaudit.plans import layout
    from stockaudit.sources import schemas

    rows = []
    for i in range(3000):
        address = "MZ-0-000-000-01" if i % 3 == 0 else f"MZ-0-000-{i % 50:03d}-02"
        rows.append(("BR01", address, 7 if i % 3 == 1 else i % 400, 1, "n/a", 1, float(i % 5)))
    stock = spark.createDataFrame(rows, schemas.ADDRESS_STOCK).repartition(6)
    skus = {}
    for _, address, sku, *_ in rows:
        skus.setdefault(address, set()).add(sku)
    got = {r["address_id"]: (r["skus"], r["units"]) for r in layout.address_summary(stock, "MZ").collect()}
    assert got == {a: (len(s), sum(r[1] == a for r in rows)) for a, s in skus.items()}
    assert layout.site_tuples(stock, "MZ").collect()[0]["tuples"] == sum(len(s) for s in skus.values())
    top = [r["insured_value"] for r in layout.insured_top_fraction(stock, 0.3).collect()]
    values = [row[6] for row in rows]
    assert top == sorted(v for v in values if 1 + sum(other > v for other in values) <= 0.3 * len(values))
