"""Cycle-count accuracy against targets (input: ``CYCLE_SUMMARY``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stockaudit import fixed_values as fixed
from stockaudit.functions.scalars import flag, label, pct_label, ratio
from stockaudit.operators.aggregates import (
    max_strict,
    pivot_wide,
    row_count,
    sum_or_zero,
    weighted_count,
    with_total_row,
)
from stockaudit.operators.joins import attach, is_small, stored
from stockaudit.operators.windows import order_by_level, share, total_of


def areas(summary: DataFrame) -> DataFrame:
    """The distinct areas."""
    return summary.select("area").distinct()


def levels(summary: DataFrame) -> DataFrame:
    """Strata per level."""
    return row_count(summary, ["level"])


def open_counts(summary: DataFrame) -> DataFrame:
    """The distinct cycle counts still being worked on."""
    working = summary.where(F.col("status") == fixed.WORKING)
    return working.select("cycle_count_id", "site_id", "region", "status").distinct()


def site_table(summary: DataFrame, region: str, period: str, area: str, total_label: str) -> DataFrame:
    """Weighted accuracy per site against its target, with a re-derived total row.

    The total's target is the highest regional target of the whole table.
    """
    kept = summary.where(
        (F.col("region") == region) & (F.col("period") == period) & (F.col("area") == area)
    )
    accurate = (1 - F.col("p_hat")) * F.col("population_size")
    # One pass gives the sites and their total, whose ratio is taken of its own sums.
    table = (
        kept.withColumn("accurate", accurate)
        .where(F.col("accurate").isNotNull())
        .rollup("site_id")
        .agg(
            sum_or_zero("population_size").alias("population"),
            F.coalesce(F.sum("accurate"), F.lit(0.0)).alias("accurate"),
            max_strict("target_site").alias("target"),
            F.grouping("site_id").alias("_total"),
        )
    )
    is_site = F.col("_total") == 0
    accuracy = ratio(F.col("accurate"), F.col("population"))
    goal = flag(F.col("target") <= accuracy, fixed.TARGET_MET, fixed.TARGET_MISSED)
    region_target = summary.agg(max_strict("target_region")).scalar()
    table = table.withColumns({
        "site_id": F.when(is_site, F.col("site_id")).otherwise(total_label),
        "target": F.when(is_site, F.col("target")).otherwise(region_target),
        "accuracy": accuracy,
        "goal": F.when(is_site, goal),
        "site_weight": F.when(is_site, share("population", ["_total"])),
    })
    return table.orderBy(F.desc_nulls_last("population"), "_total", F.asc_nulls_last("site_id")).drop("_total")


def impact(summary: DataFrame, region: str, period: str) -> DataFrame:
    """Every stratum of a region and month with its projected errors and what they weigh.

    Totals per site and area are derived from one aggregate of the strata and joined back;
    the strata themselves are not shuffled while that aggregate is small.
    """
    strata = summary.where((F.col("region") == region) & (F.col("period") == period))
    strata = strata.withColumn("projected_errors", F.col("p_hat") * F.col("population_size"))
    cells = stored(
        strata.groupBy("site_id", "area", "target_site").agg(
            F.count(F.lit(1)).alias("strata"),
            sum_or_zero("accurate_tuples").alias("accurate"),
            sum_or_zero("population_size").alias("population"),
            F.coalesce(F.sum("projected_errors"), F.lit(0.0)).alias("errors"),
        )
    )
    # Both tables below have at most as many rows as the cells, which are counted.
    mark = F.broadcast if is_small(cells) else (lambda table: table)
    strata = attach(strata, mark(_site_totals(cells)), ["site_id", "target_site"])
    strata = attach(strata, mark(_area_totals(cells)), ["area"])
    site_share = ratio(F.col("accurate_tuples"), F.col("site_accurate"))
    return strata.withColumns({
        "site_part": site_share,
        "site_part_label": pct_label(site_share, 1),
        "target_region_label": pct_label(F.col("target_region"), 1),
    })


def _site_totals(cells: DataFrame) -> DataFrame:
    sites = cells.groupBy("site_id", "target_site").agg(
        *[F.sum(name).alias(name) for name in ("accurate", "population", "errors")]
    )
    # A site whose strata carry different targets has one row and one label for each.
    sites = sites.withColumns({
        "site_accurate": total_of("accurate", ["site_id"]),
        "site_population": total_of("population", ["site_id"]),
        "site_errors": total_of("errors", ["site_id"]),
        "region_accurate": total_of("accurate"),
        "region_population": total_of("population"),
        "total_errors": total_of("errors"),
    }).drop("accurate", "population", "errors")
    sites = sites.withColumns({
        "site_accuracy": ratio(F.col("site_accurate"), F.col("site_population")),
        "site_error_share": ratio(F.col("site_errors"), F.col("total_errors")),
        "region_accuracy_label": pct_label(ratio(F.col("region_accurate"), F.col("region_population")), 1),
    })
    meets = F.col("site_accuracy") >= F.col("target_site")
    sites = sites.withColumns({"meets_target": meets, "goal_mark": flag(meets, fixed.GOAL_MARK, "")})
    sites = sites.withColumn("site_label", label(
        fixed.SITE_IMPACT_LABEL, site=F.col("site_id"), error_share=pct_label(F.col("site_error_share"), 1),
        target=pct_label(F.col("target_site"), 2), goal=F.col("goal_mark"),
        accuracy=pct_label(F.col("site_accuracy"), 2),
    ))
    return order_by_level(sites, "site_label", "site_error_share", "site_order", descending=False)


def _area_totals(cells: DataFrame) -> DataFrame:
    areas = cells.groupBy("area").agg(F.sum("errors").alias("area_errors"), F.sum("strata").alias("_strata"))
    areas = areas.withColumn("area_error_share", ratio(F.col("area_errors"), total_of("area_errors")))
    share_label = pct_label(F.col("area_error_share"), 1)
    areas = areas.withColumn(
        "area_label", label(fixed.AREA_IMPACT_LABEL, area=F.col("area"), error_share=share_label)
    )
    # Areas are ordered by their total summed over the rows that show it.
    areas = areas.withColumn("_shown", F.round(F.col("area_errors") * F.col("_strata"), 6))
    return order_by_level(areas, "area_label", "_shown", "area_order").drop("_strata", "_shown")


def area_errors_by_region(
    summary: DataFrame, period: str, without_area: str, regions: Sequence[str] = fixed.MARKETS
) -> DataFrame:
    """Wrong tuples per area, one column per region and one for all others, with totals, shares and a total row."""
    kept = summary.where((F.col("period") == period) & (F.col("area") != without_area))
    counts = weighted_count(kept.fillna({"area": fixed.MISSING}), ["region", "area"], "error_tuples")
    names = {region: region.lower() for region in regions}
    rest = "other_region"
    wide = pivot_wide(counts, ["area"], "region", names, "n", fill=0, rest=rest)
    total = F.col(rest)
    for name in names.values():
        total = total + F.col(name)
    wide = wide.withColumn("total_errors", total)
    wide = wide.withColumn("share", share("total_errors"))
    columns = [*names.values(), rest, "total_errors"]
    table = with_total_row(wide, {"area": fixed.TOTAL_LABEL}, {
        **{name: sum_or_zero(name) for name in columns},
        "share": ratio(F.sum("total_errors"), F.sum("total_errors")),
    })
    return table.orderBy(F.col("area") == fixed.TOTAL_LABEL, F.desc("total_errors"), F.asc_nulls_last("area"))
