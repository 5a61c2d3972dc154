"""Every report by name, with the parameter values it is registered under."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockaudit.plans import accuracy, density, divergence, layout, movement
from stockaudit.sources import derived

Query = Callable[[SparkSession, str], DataFrame]

AREA, OUTSIDE, MOBILE, STAGING = "MZ", "MU", "MU", "PW"
MARKET, OTHER_MARKET, PERIOD, MONTH, SITE = "BR", "MX", "2024 | 02", 2, "MX01"
SITES = ("BR01", "BR02", "BRTR1")
DAY = datetime.date(2024, 1, 15)


def portable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, dates and timestamps as text, for comparison by value."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "double":
            column = F.round(column, 6)
        elif kind in ("date", "timestamp_ntz", "timestamp"):
            column = column.cast("string")
        columns.append(column.alias(name))
    return df.select(*columns)


def _on(table: Callable[..., DataFrame], report: Callable[..., DataFrame], **parameters) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(table(spark, sf_dir), **parameters)

    return query


def _summary(report, **parameters) -> Query:
    return _on(derived.cycle_summary, report, **parameters)


def _detail(report, **parameters) -> Query:
    return _on(derived.count_detail, report, **parameters)


def _stock(report, **parameters) -> Query:
    return _on(derived.address_stock, report, **parameters)


def _stock_in_areas(report, **parameters) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        areas = accuracy.areas(derived.cycle_summary(spark, sf_dir))
        return report(derived.address_stock(spark, sf_dir), areas, **parameters)

    return query


def _moves(report, **parameters) -> Query:
    return _on(derived.movements, report, **parameters)


def _density(report, **parameters) -> Query:
    return _on(derived.address_density, report, **parameters)


def _bucket_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock_share = density.ge_share(derived.address_density(spark, sf_dir), AREA)
    return divergence.bucket_errors(derived.count_detail(spark, sf_dir), stock_share, AREA)


def _stock_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parsed(derived.address_stock_sources(spark, sf_dir))


REPORTS: dict[str, Query] = {
    # Cycle-count accuracy
    "acc_areas": _summary(accuracy.areas),
    "acc_levels": _summary(accuracy.levels),
    "acc_status": _summary(accuracy.open_counts),
    "acc_site_table": _summary(accuracy.site_table, region=MARKET, period=PERIOD, area=AREA, total_label="TOTAL"),
    "acc_impact": _summary(accuracy.impact, region=MARKET, period=PERIOD),
    "err_area_by_region": _summary(accuracy.area_errors_by_region, period=PERIOD, without_area=AREA),
    # Count divergence
    "count_base": _detail(divergence.count_base),
    "div_area_month": _detail(divergence.area_month),
    "div_level_type_share": _detail(divergence.level_type_share, market=MARKET, month=MONTH),
    "div_site_level_type": _detail(
        divergence.site_level_type, market=OTHER_MARKET, area=AREA, site=SITE, month=MONTH
    ),
    "div_market_totals": _detail(divergence.market_totals),
    "density_freq": _detail(divergence.density_frequency, area=AREA),
    "density_bucket_totals": _detail(divergence.bucket_totals, area=AREA),
    "density_bucket_errors": _bucket_errors,
    "div_level_share": _detail(divergence.level_share, market=MARKET, area=AREA),
    "div_level_top2": _detail(divergence.level_top, area=AREA),
    "address_error_pivot": _detail(divergence.address_errors),
    "density_inac": _detail(divergence.density_accuracy, area=AREA, market=OTHER_MARKET),
    "density_error_share": _detail(
        divergence.density_error_share, area=AREA, market=OTHER_MARKET, site=SITE
    ),
    "level_type_tuples": _detail(divergence.level_type_tuples, market=OTHER_MARKET, area=AREA),
    "density_tuples": _detail(divergence.density_tuples, area=AREA),
    "density_error_corr": _detail(divergence.density_error_correlation, area=AREA),
    "density_flag_counts": _detail(divergence.density_flag_counts, area=AREA, market=MARKET),
    "category_pareto": _detail(divergence.category_pareto, area=AREA, site=SITE),
    # Stock layout
    "stock_parsed": _stock_parsed,
    "stock_site_units": _stock(layout.site_units),
    "stock_address_rollup": _stock(layout.address_rollup, area=AREA),
    "stock_sku_rollup": _stock(layout.sku_rollup, area=AREA),
    "floor_share_wide": _stock(layout.floor_share_wide, area=AREA),
    "box_sku_per_address": _stock(layout.box_skus_per_address, area=AREA),
    "box_units_per_address": _stock(layout.box_units_per_address, area=AREA),
    "box_units_per_sku": _stock(layout.box_units_per_sku, area=AREA),
    "box_addresses_per_sku": _stock(layout.box_addresses_per_sku, area=AREA),
    "aisle_top10": _stock(layout.aisle_top, area=AREA),
    "stock_overview": _stock_in_areas(layout.overview),
    "sku_spread": _stock_in_areas(layout.sku_spread),
    "sku_spread_top": _stock_in_areas(layout.sku_spread_top),
    "spread_area_counts": _stock_in_areas(layout.spread_area_counts),
    "spread_tail": _stock_in_areas(layout.spread_tail),
    "tuple_base": _stock(layout.tuple_base),
    "tuple_top50": _stock(layout.tuple_top),
    "floor_top5": _stock_in_areas(layout.floor_top),
    "insured_mean": _stock(layout.insured_mean),
    "insured_top_frac": _stock(layout.insured_top_fraction),
    "stock_zone_summary": _stock(layout.zone_summary, area=AREA),
    "stock_area_summary": _stock(layout.area_summary),
    "stock_floor_cumulative": _stock(layout.floor_cumulative, without_area=OUTSIDE),
    "mz_floor_cumulative": _stock(layout.area_floor_cumulative, area=AREA),
    # The same for areas whose units are all known.
    "mu_floor_cumulative": _stock(layout.area_floor_cumulative, area=MOBILE),
    "rest_floor_cumulative": _stock(layout.floor_cumulative, without_area=AREA),
    "address_summary": _stock(layout.address_summary, area=AREA),
    "address_summary_stats": _stock(layout.address_summary_stats, area=AREA),
    "address_site_counts": _stock(layout.address_site_counts, area=AREA),
    "sku_summary": _stock(layout.sku_summary, area=AREA),
    "sku_summary_stats": _stock(layout.sku_summary_stats, area=AREA),
    "sku_hist20": _stock(layout.sku_histogram, area=AREA),
    "mu_summary_stats": _stock(layout.mobile_unit_stats, area=MOBILE),
    "onhand_parsed": _on(derived.onhand, layout.onhand_parsed),
    "onhand_site_stats": _on(derived.onhand, layout.onhand_site_stats),
    "onhand_top6": _on(derived.onhand, layout.onhand_top),
    "site_tuples": _stock(layout.site_tuples, area=AREA),
    # SKU density extract
    "density_ge5_share": _density(density.ge_share, area=AREA),
    "density_hist": _density(density.histogram, site=SITE),
    "density_share_hist": _density(density.share_histogram, sites=SITES, prefix="BR", without="TR"),
    "density_market_counts": _density(density.market_counts, market=OTHER_MARKET, area=AREA),
    # Movement log
    "mov_process_totals": _moves(movement.process_totals),
    "mov_parsed": _moves(movement.parsed),
    "mov_unassigned_origin": _moves(movement.unassigned_origin, area=STAGING),
    "mov_touch": _moves(movement.touches),
    "mov_touch_levels": _moves(movement.touch_levels, area=AREA),
    "mov_day_origin": _moves(movement.day_origin, day=DAY, area=AREA),
    "mov_level_process": _moves(movement.level_process, day=DAY, area=AREA),
    "mov_count_daily": _moves(movement.count_daily),
    "mov_count_lines": _moves(movement.count_lines),
    "mov_putaway": _moves(movement.putaway, area=MOBILE),
    "mov_putaway_level": _moves(movement.putaway_level, area=MOBILE),
}


def queries() -> dict[str, Query]:
    """The reports in comparable form."""

    def comparable(report: Query) -> Query:
        return lambda spark, sf_dir: portable(report(spark, sf_dir))

    return {name: comparable(report) for name, report in REPORTS.items()}
