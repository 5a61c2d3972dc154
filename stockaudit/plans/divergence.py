"""Lost, found and matching lines of cycle counts (input: ``COUNT_DETAIL``).

Markets are derived from the site code after each aggregation, so they never widen a
shuffle, and are filtered as code prefixes, which reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockaudit import fixed_values as fixed
from stockaudit.functions.scalars import (
    divergence,
    divergence_type,
    density_bucket,
    flag,
    in_market,
    label,
    market_of,
    month_label,
    pct_label,
    ratio,
)
from stockaudit.functions.stats import corr_pvalue, pairs, pearson
from stockaudit.operators.aggregates import (
    distinct_then_count,
    pivot_sums,
    pivot_wide,
    row_count,
    weighted_count,
)
from stockaudit.operators.joins import attach
from stockaudit.operators.sets import numbered, side_by_side, told_by, united, value_sets
from stockaudit.operators.windows import (
    cumulative_share,
    first_k,
    fixed_order,
    order_by_level,
    order_index,
    share,
    top_flag,
    total_of,
)
from stockaudit.sources import schemas
from stockaudit.sources.dates import with_count_dates
from stockaudit.sources.readers import relocate

ERROR, MATCH = "error", "ok"


def _difference() -> Column:
    return divergence(F.col("qty_counted"), F.col("qty_system"))


def _stored() -> Column:
    """The divergence as the extract states it, which need not be counted minus system."""
    return F.col("divergence_stored")


def _with_market(df: DataFrame) -> DataFrame:
    return df.withColumn("market", market_of(F.col("site_id")))


def _wrong(detail: DataFrame) -> DataFrame:
    """Lines whose stated divergence is known and not zero."""
    return detail.where(_stored() != 0)


def _counted_wrong(detail: DataFrame, month: int) -> DataFrame:
    """Lines of a month counted above or below the system."""
    return with_count_dates(detail).where((_difference() != 0) & (F.col("month") == month))


def _error_label(total: str) -> Column:
    return label(fixed.SITE_ERRORS_LABEL, site=F.col("site_id"), errors=F.col(total))


def count_base(detail: DataFrame) -> DataFrame:
    """Every counted line with market, divergence, its type, the count date and month."""
    base = with_count_dates(detail).withColumns({
        "market": market_of(F.col("site_id")),
        "divergence": _difference(),
        "divergence_type": divergence_type(_difference()),
        "month_label": month_label(F.col("month")),
    })
    return relocate(base, "market", before="site_id").drop(*schemas.NUMBERS.values())


def area_month(detail: DataFrame) -> DataFrame:
    """Lines per area, one column per month and one for lines without a readable date."""
    lines = row_count(with_count_dates(detail), ["area", "month"])
    return pivot_wide(lines, ["area"], "month", {**dict(enumerate(fixed.MONTH_LABELS, start=1)), None: "month_none"}, "n")


def level_type_share(detail: DataFrame, market: str, month: int) -> DataFrame:
    """Lost and found lines per site and level, and their parts of the level."""
    lines = _counted_wrong(detail, month).where(in_market(F.col("site_id"), market))
    counts = row_count(
        lines.withColumn("divergence_type", divergence_type(_difference())), ["site_id", "level", "divergence_type"]
    )
    return counts.withColumn("share", share("n", ["site_id", "level"]))


def site_level_type(detail: DataFrame, market: str, area: str, site: str, month: int) -> DataFrame:
    """Lost and found lines per level of one site, with display orders."""
    lines = _counted_wrong(detail, month).where(
        in_market(F.col("site_id"), market) & (F.col("area") == area) & (F.col("site_id") == site)
    )
    counts = row_count(
        lines.withColumn("divergence_type", divergence_type(_difference())), ["site_id", "level", "divergence_type"]
    )
    counts = counts.withColumn("site_errors", total_of("n", ["site_id"]))
    counts = counts.withColumn("site_label", _error_label("site_errors"))
    counts = order_by_level(counts, "site_label", "site_errors", "site_order")
    return counts.withColumn("type_order", fixed_order(F.col("divergence_type"), fixed.DIVERGENCE_ORDER))


def market_totals(detail: DataFrame) -> DataFrame:
    """Distinct addresses and SKUs with a divergence per market, SKUs as percent of all."""
    lines = _wrong(numbered(detail, schemas.NUMBERS))
    sets = {
        name: united(_with_market(value_sets(lines, ["site_id"], number)), ["market"])
        for name, number in (("addresses", "address_no"), ("skus", "sku_no"))
    }
    totals = side_by_side(["market"], sets)
    return totals.withColumn("skus_pct", share("skus") * 100).orderBy(
        F.asc_nulls_last("market"), F.desc_nulls_last("skus")
    )


def _told_by(detail: DataFrame, column: str) -> str:
    return told_by(detail, column, schemas.NUMBERS)


def address_errors(
    detail: DataFrame, area: str | None = None, market: str | None = None, address: str = "address_id"
) -> DataFrame:
    """Distinct SKUs counted wrong and right per address, and their sum, the density.

    A SKU counted both ways counts twice; lines without a stated divergence leave a density of 0.
    The distinct shuffles on the whole row, so a hot address is spread out, and the second
    step combines partial counts. ``address`` is the column that names an address in the result.
    """
    lines = detail
    if area is not None:
        lines = lines.where(F.col("address_id").startswith(area))
    if market is not None:
        lines = lines.where(in_market(F.col("site_id"), market))
    outcome = flag(_stored() != 0, ERROR, MATCH).alias("outcome")
    addresses = (
        lines.select("site_id", address, outcome, _told_by(detail, "sku_id"))
        .distinct()
        .groupBy("site_id", address)
        .agg(
            F.count(F.when(F.col("outcome") == ERROR, 1)).alias("error_skus"),
            F.count(F.when(F.col("outcome") == MATCH, 1)).alias("ok_skus"),
        )
    )
    return _with_market(addresses).withColumn("density", F.col("error_skus") + F.col("ok_skus"))


def _addresses(detail: DataFrame, area: str, market: str | None = None) -> DataFrame:
    """``address_errors`` for reports that count addresses and do not name them."""
    return address_errors(detail, area, market, _told_by(detail, "address_id"))


def density_frequency(
    detail: DataFrame, area: str, first: int = fixed.FIRST_DENSITIES, top: int = fixed.FLAGGED_RANKS
) -> DataFrame:
    """Wrong tuples by address density, the first densities of each site, largest flagged."""
    site = ["market", "site_id"]
    counts = weighted_count(_addresses(detail, area), [*site, "density"], "error_skus", "errors")
    counts = first_k(counts, site, [F.asc("density")], first)
    counts = counts.withColumns({"share": share("errors", site), "site_errors": total_of("errors", site)})
    counts = counts.withColumns({
        "density_label": F.col("density").cast("string"),
        "site_label": _error_label("site_errors"),
        "is_top": top_flag("errors", site, top),
    })
    return order_by_level(counts, "site_label", "site_errors", "site_order")


def bucket_totals(detail: DataFrame, area: str, edge: int = fixed.DENSE_FROM) -> DataFrame:
    """All tuples of a site in dense and in sparse addresses, and the dense part."""
    buckets = _addresses(detail, area).withColumn("bucket", density_bucket(F.col("density"), edge))
    wide = pivot_wide(
        buckets, ["market", "site_id"], "bucket", {"ge": "tuples_ge", "lt": "tuples_lt"}, "density", fill=0
    )
    return wide.withColumn("share_ge", ratio(F.col("tuples_ge"), F.col("tuples_lt") + F.col("tuples_ge")))


def bucket_errors(detail: DataFrame, stock_share: DataFrame, area: str, edge: int = fixed.DENSE_FROM) -> DataFrame:
    """Wrong tuples of a site in dense and sparse addresses, next to the dense part of its stock.

    ``stock_share`` is the result of ``density.ge_share``.
    """
    site = ["market", "site_id"]
    buckets = _addresses(detail, area).withColumn("bucket", density_bucket(F.col("density"), edge))
    counts = weighted_count(buckets, [*site, "bucket"], "error_skus", "errors")
    counts = counts.withColumns({"share": share("errors", site), "site_errors": total_of("errors", ["site_id"])})
    counts = attach(counts, stock_share.withColumnRenamed("share_ge", "stock_share_ge"), ["site_id"])
    counts = counts.withColumns({
        "site_label": label(
            fixed.SITE_STOCK_LABEL, site=F.col("site_id"), errors=F.col("site_errors"), edge=str(edge),
            share=pct_label(F.col("stock_share_ge"), 0),
        ),
        "bucket_label": label(fixed.BUCKET_LABEL, errors=F.col("errors"), share=pct_label(F.col("share"), 0)),
    })
    return order_by_level(counts, "site_label", "site_errors", "site_order")


def _level_errors(detail: DataFrame, area: str, max_level: int, market: str | None) -> DataFrame:
    lines = _wrong(detail).where((F.col("level") <= max_level) & (F.col("area") == area))
    if market is not None:
        lines = lines.where(in_market(F.col("site_id"), market))
    tuples = [_told_by(detail, "address_id"), _told_by(detail, "sku_id")]
    return _with_market(distinct_then_count(lines, ["site_id", "level"], tuples, "errors"))


def level_share(detail: DataFrame, market: str, area: str, max_level: int = fixed.MAX_LEVEL) -> DataFrame:
    """Wrong tuples per site and level of one market, as parts of the site."""
    levels = _level_errors(detail, area, max_level, market).withColumn("share", share("errors", ["site_id"]))
    return order_index(levels, "site_id", "errors", "site_order", aggregate=F.avg, descending=False)


def level_top(
    detail: DataFrame, area: str, max_level: int = fixed.MAX_LEVEL, top: int = fixed.FLAGGED_RANKS
) -> DataFrame:
    """Wrong tuples per site and level of all markets, the largest levels flagged."""
    site = ["market", "site_id"]
    levels = _level_errors(detail, area, max_level, None)
    levels = levels.withColumns({"share": share("errors", site), "site_errors": total_of("errors", site)})
    levels = levels.withColumns({
        "level_label": F.col("level").cast("string"),
        "site_label": _error_label("site_errors"),
        "is_top": top_flag("errors", site, top),
    })
    return order_by_level(levels, "site_label", "site_errors", "site_order")


def _address_flag() -> Column:
    return flag(F.col("error_skus") != 0, ERROR, MATCH)


def density_accuracy(detail: DataFrame, area: str, market: str, first: int = fixed.FIRST_DENSITIES) -> DataFrame:
    """Tuples in addresses with and without errors by density, and the accuracy.

    The first rows per site are taken with densities that have errors ahead of the rest.
    """
    site = ["market", "site_id"]
    flagged = _addresses(detail, area, market).withColumn("outcome", _address_flag())
    wide = pivot_wide(
        flagged, [*site, "density"], "outcome", {ERROR: "error_tuples", MATCH: "ok_tuples"}, "density", fill=0
    )
    rate = ratio(F.col("error_tuples"), F.col("error_tuples") + F.col("ok_tuples"))
    wide = wide.withColumn("accuracy", 1 - rate)
    return first_k(wide, site, [F.asc(F.col("error_tuples") == 0), F.asc("density")], first)


def density_error_share(
    detail: DataFrame, area: str, market: str, site: str, first: int = fixed.FIRST_DENSITIES
) -> DataFrame:
    """The densities of one site with their parts of its tuples in error."""
    rows = density_accuracy(detail, area, market, first).where(F.col("site_id") == site)
    return rows.withColumn("error_share", share("error_tuples")).withColumnRenamed("density", "sku_per_address")


def level_type_tuples(detail: DataFrame, market: str, area: str) -> DataFrame:
    """Tuples per site, level and divergence type, uncounted ones under a null type."""
    lines = detail.where(in_market(F.col("site_id"), market) & (F.col("area") == area))
    lines = lines.withColumn("divergence_type", divergence_type(_difference()))
    tuples = distinct_then_count(
        lines, ["site_id", "level", "divergence_type"], [_told_by(detail, "address_id"), _told_by(detail, "sku_id")], "tuples"
    )
    return order_index(tuples, "site_id", "tuples", "site_order")


def density_tuples(
    detail: DataFrame, area: str, market: str | None = None, max_density: int = fixed.MAX_DENSITY
) -> DataFrame:
    """Tuples and addresses with and without errors per site and density, side by side."""
    flagged = _addresses(detail, area, market).where(F.col("density") <= max_density)
    flagged = flagged.withColumn("outcome", _address_flag())
    tuples = pivot_sums("outcome", {ERROR: "tuples_error", MATCH: "tuples_ok"}, "density")
    addresses = pivot_sums("outcome", {ERROR: "addresses_error", MATCH: "addresses_ok"}, F.lit(1))
    return flagged.groupBy("market", "site_id", "density").agg(
        *[column.alias(name) for name, column in {**tuples, **addresses}.items()]
    )


def density_error_correlation(detail: DataFrame, area: str, max_density: int = fixed.MAX_DENSITY) -> DataFrame:
    """Correlation of density with tuples in error per site, and its p-value."""
    x, y = F.col("tuples_error"), F.col("density")
    sites = density_tuples(detail, area, max_density=max_density).groupBy("site_id").agg(
        pearson(x, y).alias("correlation"), pairs(x, y).alias("pairs")
    )
    return (
        sites.withColumn("p_value", corr_pvalue(F.col("correlation"), F.col("pairs")))
        .drop("pairs")
        .orderBy(F.asc_nulls_last("correlation"), "site_id")
    )


def density_flag_counts(detail: DataFrame, area: str, market: str, max_density: int = fixed.MAX_DENSITY) -> DataFrame:
    """Tuples per site, error flag of the address and density."""
    flagged = _addresses(detail, area, market).where(F.col("density") <= max_density)
    return weighted_count(
        flagged.withColumn("outcome", _address_flag()), ["market", "site_id", "outcome", "density"], "density", "tuples"
    )


def category_pareto(detail: DataFrame, area: str, site: str) -> DataFrame:
    """Divergent lines per category of one site, with running shares from the largest down."""
    lines = _wrong(detail).where((F.col("area") == area) & (F.col("site_id") == site))
    counts = row_count(lines, ["category", "site_id"])
    order = [F.desc("n"), F.asc_nulls_last("category")]
    return counts.withColumns({"share": share("n"), "running_share": cumulative_share("n", order)}).orderBy(*order)
