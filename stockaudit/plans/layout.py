"""How stock lies in the warehouse (inputs: ``ADDRESS_STOCK`` and ``ONHAND``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit import fixed_values as fixed
from stockaudit.functions.scalars import address_part, parse_address
from stockaudit.operators.aggregates import (
    distinct_then_count,
    max_strict,
    mean_strict,
    min_strict,
    n_distinct,
    pivot_wide,
    row_count,
    sum_strict,
    weighted_count,
)
from stockaudit.operators.joins import keep_matching
from stockaudit.operators.ranking import top_fraction_ties, top_groups_ties, top_n_ties
from stockaudit.operators.sets import distinct_totals, numbered, told_by
from stockaudit.operators.summaries import box_stats, numeric_summary
from stockaudit.operators.windows import cumulative_share, first_k, share
from stockaudit.sources import schemas
from stockaudit.sources.dates import with_update_times
from stockaudit.sources.readers import union_sources


# Counts of distinct values and the columns that number them.
DISTINCT = {"skus": schemas.NUMBERS["sku_id"], "addresses": schemas.NUMBERS["address_id"]}


def _part(name: str) -> Column:
    return address_part(F.col("address_id"), name).alias(name)


def _address(stock: DataFrame) -> str:
    return told_by(stock, "address_id", schemas.NUMBERS)


def _sku(stock: DataFrame) -> str:
    return told_by(stock, "sku_id", schemas.NUMBERS)


def _in_area(stock: DataFrame, area: str) -> DataFrame:
    # The area is the head of the address, so this test can reach the scan.
    return stock.where(F.col("address_id").startswith(area))


def parsed(sources: Mapping[str, DataFrame], tag: str = "site_id") -> DataFrame:
    """Like extracts stacked and tagged, every line with its address parts."""
    return parse_address(union_sources(sources, tag))


def site_units(stock: DataFrame) -> DataFrame:
    """Units per site."""
    return weighted_count(stock, ["site_id"], "units", "units")


def address_summary(stock: DataFrame, area: str) -> DataFrame:
    """Distinct SKUs and units per site and address of one area."""
    return _in_area(stock, area).groupBy("site_id", "address_id").agg(
        n_distinct("sku_id").alias("skus"), sum_strict("units").alias("units")
    )


def address_rollup(stock: DataFrame, area: str) -> DataFrame:
    """``address_summary`` with the address parts, the floor as a number."""
    return parse_address(address_summary(stock, area), numeric_floor=True)


def sku_rollup(stock: DataFrame, area: str) -> DataFrame:
    """Units and distinct addresses per site and SKU of one area."""
    return _in_area(stock, area).groupBy("site_id", "sku_id").agg(
        sum_strict("units").alias("units"), n_distinct(_address(stock)).alias("addresses")
    )


def floor_share_wide(stock: DataFrame, area: str, floors: Sequence[int] = tuple(range(1, 10))) -> DataFrame:
    """Part of each site's units per floor, one column per floor, and two for other floors and for no floor number."""
    # Summed per address first: an address with an unknown quantity counts for nothing.
    by_floor = weighted_count(address_rollup(stock, area), ["site_id", "floor"], "units", "units")
    shares = by_floor.withColumn("share", share("units", ["site_id"]))
    columns = {**{float(floor): f"floor_{floor}" for floor in floors}, None: "floor_none"}
    return pivot_wide(shares, ["site_id"], "floor", columns, "share", rest="floor_other")


def box_skus_per_address(stock: DataFrame, area: str) -> DataFrame:
    return box_stats(address_summary(stock, area), ["site_id"], "skus")


def box_units_per_address(stock: DataFrame, area: str, upper: int = fixed.BOX_UPPER) -> DataFrame:
    return box_stats(address_summary(stock, area), ["site_id"], "units", upper)


def box_units_per_sku(stock: DataFrame, area: str, upper: int = fixed.BOX_UPPER) -> DataFrame:
    return box_stats(sku_rollup(stock, area), ["site_id"], "units", upper)


def box_addresses_per_sku(stock: DataFrame, area: str, upper: int = fixed.BOX_UPPER) -> DataFrame:
    return box_stats(sku_rollup(stock, area), ["site_id"], "addresses", upper)


def aisle_top(stock: DataFrame, area: str, first: int = fixed.FIRST_AISLES) -> DataFrame:
    """The first aisles of each site by code: tuples, shares and running shares among them."""
    tuples = [_address(stock), _sku(stock)]
    lines = _in_area(stock, area).select("site_id", *tuples, _part("aisle"))
    aisles = distinct_then_count(lines, ["site_id", "aisle"], tuples, "skus")
    order = [F.asc_nulls_last("aisle")]
    return first_k(aisles, ["site_id"], order, first).withColumns({
        "share": share("skus", ["site_id"]),
        "running_share": cumulative_share("skus", order, ["site_id"]),
    })


def _in_areas(stock: DataFrame, areas: DataFrame) -> DataFrame:
    return keep_matching(stock.withColumn("area", address_part(F.col("address_id"), "area")), "area", areas)


def overview(stock: DataFrame, areas: DataFrame) -> DataFrame:
    """Units, distinct SKUs and addresses within the areas listed in a one-column table."""
    lines = _in_areas(numbered(stock, schemas.NUMBERS), areas)
    return distinct_totals(lines, [], DISTINCT, strict_sum="units")


def sku_spread(stock: DataFrame, areas: DataFrame) -> DataFrame:
    """Distinct addresses per SKU within the listed areas."""
    return distinct_then_count(_in_areas(stock, areas), ["sku_id"], [_address(stock)], "addresses")


def sku_spread_top(stock: DataFrame, areas: DataFrame, k: int = fixed.TOP_SPREAD_SKUS) -> DataFrame:
    """The most spread SKUs, ties kept."""
    return top_n_ties(sku_spread(stock, areas), "addresses", k)


def spread_area_counts(stock: DataFrame, areas: DataFrame, k: int = fixed.TOP_SPREAD_SKUS) -> DataFrame:
    """Lines per area of the most spread SKUs."""
    top = sku_spread_top(stock, areas, k).select("sku_id")
    lines = keep_matching(stock.select("sku_id", _part("area")), "sku_id", top)
    return row_count(lines, ["area"], "lines").orderBy(F.desc("lines"), F.asc_nulls_last("area"))


def spread_tail(stock: DataFrame, areas: DataFrame, skip: int = fixed.SKIPPED_SPREAD_ROWS) -> DataFrame:
    """SKUs per number of addresses with shares of all, without the first ``skip`` rows."""
    counts = row_count(sku_spread(stock, areas), ["addresses"], "skus")
    order = [F.asc("addresses")]
    counts = counts.withColumns({
        "share": share("skus"),
        "running_share": cumulative_share("skus", order),
        "_row": F.row_number().over(Window.orderBy(*order)),
    })
    return counts.where(F.col("_row") > skip).drop("_row")


def tuple_base(stock: DataFrame) -> DataFrame:
    """Distinct SKUs and last update per address; an unreadable update makes it unknown."""
    lines = with_update_times(stock).select("address_id", "sku_id", F.col("updated_at").alias("updated"))
    # One row a SKU first: both measures then come from one shuffle by address and SKU and one of partial results.
    skus = lines.groupBy("address_id", "sku_id").agg(
        F.max("updated").alias("updated"), F.bool_or(F.col("updated").isNull()).alias("unknown")
    )
    addresses = skus.groupBy("address_id").agg(
        F.count(F.lit(1)).alias("skus"), F.when(~F.bool_or("unknown"), F.max("updated")).alias("last_update")
    )
    return addresses.withColumn("area", address_part(F.col("address_id"), "area"))


def tuple_top(stock: DataFrame, k: int = fixed.TOP_ADDRESSES) -> DataFrame:
    """The densest addresses, ties kept, densest first. Cutoff and choice need SKUs alone; only the chosen ones' updates are read."""
    stock = numbered(with_update_times(stock), schemas.NUMBERS)
    counts = distinct_then_count(stock, ["address_no"], ["sku_no"], "skus")
    # A number stands for one address.
    rest = {"address_id": F.max("address_id"), "last_update": max_strict("updated_at")}
    top = top_groups_ties(counts, "address_no", "skus", k, stock.select("address_no", "address_id", "updated_at"), rest)
    return top.drop("address_no").withColumn("area", address_part(F.col("address_id"), "area")).orderBy(F.desc("skus"), "address_id")


def floor_top(stock: DataFrame, areas: DataFrame, k: int = fixed.TOP_FLOORS) -> DataFrame:
    """The floors with most units and their parts of the units on these floors."""
    lines = _in_areas(stock, areas).select("units", _part("floor"))
    floors = weighted_count(lines, ["floor"], "units", "units")
    top = floors.orderBy(F.desc("units"), F.asc_nulls_last("floor")).limit(k)
    return top.withColumn("share", share("units"))


def insured_mean(stock: DataFrame) -> DataFrame:
    """Mean insured value of the lines that have one."""
    return stock.agg(F.avg("insured_value").alias("insured_mean"))


def insured_top_fraction(stock: DataFrame, fraction: float = fixed.TOP_INSURED_FRACTION) -> DataFrame:
    """The most valuable part of all lines, ties kept, cheapest first.

    The further sort keys spread lines of one common value over several sorting tasks.
    """
    lines = stock.select("seller_id", "insured_value", "sku_id", "units")
    return top_fraction_ties(lines, "insured_value", fraction).orderBy(
        F.asc_nulls_last("insured_value"), "sku_id", "seller_id", "units"
    )


def _totals(stock: DataFrame, by: str) -> DataFrame:
    lines = numbered(stock, schemas.NUMBERS).withColumn(by, _part(by))
    return distinct_totals(lines, [by], DISTINCT, strict_sum="units")


def zone_summary(stock: DataFrame, area: str) -> DataFrame:
    """Units, SKUs and addresses per zone of one area, most units first."""
    return _totals(_in_area(stock, area), "zone").orderBy(F.desc_nulls_last("units"), F.asc_nulls_last("zone"))


def area_summary(stock: DataFrame) -> DataFrame:
    """Units, SKUs and addresses per area, most units first."""
    return _totals(stock, "area").orderBy(F.desc_nulls_last("units"), F.asc_nulls_last("area"))


def floor_cumulative(stock: DataFrame, without_area: str) -> DataFrame:
    """Totals per floor outside one area, with running shares from most units down."""
    floors = _totals(stock.where(address_part(F.col("address_id"), "area") != without_area), "floor")
    order = [F.desc_nulls_last("units"), F.asc_nulls_last("floor")]
    return floors.withColumns({
        "units_share": share("units", strict=True),
        "units_running": cumulative_share("units", order, strict=True),
        "skus_share": share("skus"),
        "skus_running": cumulative_share("skus", order),
    }).orderBy(*order)


def area_floor_cumulative(stock: DataFrame, area: str) -> DataFrame:
    """SKUs and units per floor of one area, with running shares in floor order."""
    floors = _in_area(stock, area).select("sku_id", "units", _part("floor")).groupBy("floor").agg(
        n_distinct("sku_id").alias("skus"), sum_strict("units").alias("units")
    )
    order = [F.asc_nulls_last("floor")]
    return floors.withColumns({
        "units_share": share("units", strict=True),
        "units_running": cumulative_share("units", order, strict=True),
        "skus_share": share("skus"),
        "skus_running": cumulative_share("skus", order),
    }).orderBy(*order)


def address_summary_stats(stock: DataFrame, area: str) -> DataFrame:
    """Numeric summary of SKUs and units per address, per site."""
    return numeric_summary(address_summary(stock, area), ["site_id"], ["skus", "units"])


def address_site_counts(stock: DataFrame, area: str) -> DataFrame:
    """Addresses per site."""
    addresses = _in_area(stock, area).select("site_id", "address_id").distinct()
    return row_count(addresses, ["site_id"], "addresses")


def sku_summary(stock: DataFrame, area: str) -> DataFrame:
    """Distinct addresses and units per SKU of one area."""
    return _in_area(stock, area).groupBy("sku_id").agg(
        n_distinct(_address(stock)).alias("addresses"), sum_strict("units").alias("units")
    )


def sku_summary_stats(stock: DataFrame, area: str) -> DataFrame:
    """Numeric summary of addresses and units per SKU."""
    return numeric_summary(sku_summary(stock, area), [], ["addresses", "units"])


def sku_histogram(stock: DataFrame, area: str, first: int = fixed.FIRST_SPREAD_ROWS) -> DataFrame:
    """SKUs per number of addresses, the first values, with shares among them."""
    spread = distinct_then_count(_in_area(stock, area), ["sku_id"], [_address(stock)], "addresses")
    order = [F.asc("addresses")]
    counts = row_count(spread, ["addresses"], "skus").orderBy(*order).limit(first)
    return counts.withColumns({"share": share("skus"), "running_share": cumulative_share("skus", order)})


def mobile_unit_stats(stock: DataFrame, area: str) -> DataFrame:
    """Numeric summary of SKUs and units per address of the mobile-unit area."""
    units = _in_area(stock, area).groupBy("address_id").agg(
        n_distinct("sku_id").alias("skus"), sum_strict("units").alias("units")
    )
    return numeric_summary(units, [], ["skus", "units"])


def onhand_parsed(onhand: DataFrame) -> DataFrame:
    """Every stock line with area, zone and floor number."""
    return parse_address(onhand, parts=("area", "zone", "floor"), numeric_floor=True)


def onhand_site_stats(onhand: DataFrame) -> DataFrame:
    """Mean, lines, units, minimum and maximum per site; unknown if any line is unknown."""
    return onhand.groupBy("site_id").agg(
        mean_strict("units").alias("mean_units"),
        F.count(F.lit(1)).alias("lines"),
        sum_strict("units").alias("units"),
        min_strict("units").alias("min_units"),
        max_strict("units").alias("max_units"),
    )


def onhand_top(onhand: DataFrame, k: int = fixed.TOP_ONHAND_LINES) -> DataFrame:
    """The largest stock lines, ties kept."""
    return top_n_ties(onhand_parsed(onhand), "units", k)


def site_tuples(stock: DataFrame, area: str) -> DataFrame:
    """Tuples per site: distinct SKUs within each address, summed."""
    return distinct_then_count(_in_area(stock, area), ["site_id"], [_address(stock), _sku(stock)], "tuples")
