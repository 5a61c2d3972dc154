"""What the plans must look like for the reports to hold at a large scale."""

import re

import pytest

import __spark_entry__ as driver
from stockaudit.plans import registry
from stockaudit.sources import derived

REPORTS = sorted(registry.REPORTS)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line]


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    built = {}
    # Shows filters of a scan in full.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def get(name):
        if name not in built:
            built[name] = plan(registry.REPORTS[name](spark, sf_dir))
        return built[name]

    return get


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_cross_join_or_pair_expansion(name, plans):
    text = plans(name)
    for operator in ("ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


@pytest.mark.parametrize("name", REPORTS)
def test_windows_sit_on_aggregates(name, plans):
    """Below every window there is an aggregate, or a table stored after one."""
    lines = plans(name).splitlines()
    windows = [i for i, line in enumerate(lines) if re.search(r"[-+: ]Window \[", line)]
    for i in windows:
        below = "\n".join(lines[i:])
        first_scan = min((below.find(scan) for scan in ("FileScan", "Scan ExistingRDD") if scan in below), default=-1)
        assert first_scan > 0
        assert "HashAggregate" in below[:first_scan] or "Scan ExistingRDD" in below


@pytest.mark.parametrize("name", ["density_freq", "site_tuples", "address_summary", "stock_zone_summary", "mu_summary_stats"])
def test_area_filter_reaches_the_scan(name, plans):
    assert all("StringStartsWith(address_id,M" in scan for scan in scans(plans(name)))


@pytest.mark.parametrize("name,partition", [
    ("div_level_share", "StartsWith(site_id"), ("density_hist", "= MX01"), ("density_market_counts", "StartsWith(site_id"),
    ("category_pareto", "= MX01"), ("stock_parsed", "= BR01"),
])
def test_site_filter_prunes_partitions(name, partition, plans):
    found = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plans(name))
    assert found and any(re.sub(r"#\d+", "", filters).count(partition) for filters in found)


@pytest.mark.parametrize("name,columns", [
    ("site_tuples", "struct<address_id:string,address_no:bigint,sku_no:bigint>"),
    ("insured_mean", "struct<insured_value:double>"),
    ("mov_process_totals", "struct<process:string,units:bigint,item_id:bigint>"),
    ("stock_site_units", "struct<units:int>"),
    ("density_freq", "struct<address_id:string,divergence_stored:int,address_no:bigint,sku_no:bigint>"),
])
def test_scan_reads_only_needed_columns(name, columns, plans):
    assert all(f"ReadSchema: {columns}" in scan for scan in scans(plans(name)))


def test_first_k_is_limited_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans("density_freq") and "Partial" in plans("density_freq")


def test_top_k_does_not_sort_all_rows(plans):
    for name in ("onhand_top6", "sku_spread_top"):
        assert "TakeOrderedAndProject" in plans(name)


def test_membership_is_a_broadcast_semi_join_when_small(plans):
    assert "LeftSemi" in plans("stock_overview") and "BroadcastHashJoin" in plans("stock_overview")


def test_distinct_counts_shuffle_on_the_value_too(plans):
    """A hot address is spread over reducers by its SKUs."""
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plans("address_summary"))
    assert any("sku_id" in keys for keys in exchanges)


def test_top_fraction_is_a_filter_on_the_scan(plans):
    assert all("GreaterThanOrEqual(insured_value," in scan for scan in scans(plans("insured_top_frac")))


@pytest.mark.parametrize("name", ["div_level_type_share", "div_site_level_type"])
def test_month_filter_reaches_the_scan(name, plans):
    assert all("EqualTo(month,2)" in scan for scan in scans(plans(name)))


@pytest.mark.parametrize("name", ["mov_day_origin", "mov_level_process"])
def test_day_filter_prunes_partitions(name, plans):
    found = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plans(name))
    assert found and all("moved_on" in filters and "2024-01-15" in filters for filters in found)


def test_cutoffs_store_nothing(plans):
    assert "Scan ExistingRDD" not in plans("insured_top_frac")


def test_touches_scan_once(plans):
    assert len(scans(plans("mov_touch"))) == 1


def test_reports_are_registered_for_the_driver(spark, sf_dir):
    assert set(registry.REPORTS) <= set(driver.queries())
    assert set(derived.BUILDERS) == {
        "count_detail", "cycle_summary", "address_stock", "onhand", "address_density", "movements"
    }
