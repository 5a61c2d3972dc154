"""Every registered report against its SQL counterpart."""

import pytest

import __spark_entry__ as driver
from oracle.sql import ORACLE
from stockaudit.plans import registry
from tests.compare import connect, differences, misplaced

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_report_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_report_matches_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


# The reports whose rows come in an order, with that order.
ORDERS = {
    "acc_site_table": ["population DESC NULLS LAST", "goal IS NULL", "site_id"],
    "category_pareto": ["n DESC", "category ASC NULLS LAST"],
    "density_error_corr": ["correlation ASC NULLS LAST", "site_id ASC NULLS FIRST"],
    "div_market_totals": ["market ASC NULLS LAST", "skus DESC NULLS LAST"],
    "err_area_by_region": ["area = 'Total'", "total_errors DESC", "area ASC NULLS LAST"],
    "insured_top_frac": [
        "insured_value ASC", "sku_id ASC NULLS FIRST", "seller_id ASC NULLS FIRST", "units ASC NULLS FIRST"
    ],
    "mov_process_totals": ["units DESC NULLS LAST", "process ASC NULLS LAST"],
    "mu_floor_cumulative": ["floor ASC NULLS LAST"],
    "mz_floor_cumulative": ["floor ASC NULLS LAST"],
    "rest_floor_cumulative": ["units DESC NULLS LAST", "floor ASC NULLS LAST"],
    "spread_area_counts": ["lines DESC", "area ASC NULLS LAST"],
    "stock_area_summary": ["units DESC NULLS LAST", "area ASC NULLS LAST"],
    "stock_floor_cumulative": ["units DESC NULLS LAST", "floor ASC NULLS LAST"],
    "stock_zone_summary": ["units DESC NULLS LAST", "zone ASC NULLS LAST"],
    "tuple_top50": ["skus DESC", "address_id ASC NULLS FIRST"],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(name, spark, sf_dir, con):
    assert misplaced(QUERIES[name](spark, sf_dir), con, ORACLE[name], ORDERS[name]) is None


def test_tables_can_show_faults(spark, sf_dir):
    """Floors outside the listed ones and no floor, unknown units, SKUs, dates, regions and sites, and a hot site."""
    from pyspark.sql import functions as F

    from stockaudit.sources import derived

    stock = derived.address_stock(spark, sf_dir)
    total = stock.count()
    by_site = {r.site_id: r["count"] for r in stock.groupBy("site_id").count().collect()}
    assert by_site["BR01"] > 0.3 * total and by_site[None] > 0
    floors = {r[0] for r in stock.select(F.substring("address_id", 14, 2)).distinct().collect()}
    assert floors == {*(f"{n:02d}" for n in range(13)), "XX"}
    unknown = stock.where("units IS NULL").select(F.substring("address_id", 1, 2).alias("area"), F.substring("address_id", 14, 2).alias("floor"))
    assert {tuple(r) for r in unknown.distinct().collect()} == {("MZ", "12")} and stock.where("sku_id IS NULL").count()
    detail = derived.count_detail(spark, sf_dir)
    assert 0 < detail.where("counted_on IS NOT NULL AND count_date IS NULL").count() < total / 20
    summary = derived.cycle_summary(spark, sf_dir)
    assert {r.region for r in summary.select("region").distinct().collect()} == {"BR", "MX", "OTHER", "CL", None}


def test_flagship_runs(spark):
    assert driver.entry(spark).count() > 0
