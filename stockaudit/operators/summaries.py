"""Five-number summaries and box statistics from exact value counts.

Values are counted per group first, which is a plain two-step aggregation whatever the group sizes. The counts are
sorted by range over all groups and stored, so that a group with many distinct values lies in many sorted parts. Totals
per group and part give each part's place in its group, and from it the parts that hold a wanted rank; only those
are ranked, each on its own. Nothing sees more of a group than one part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.fixed_values import WHISKER_REACH
from stockaudit.operators.joins import BROADCAST_ROWS, attach, is_small, size_checked, stored

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def value_counts(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows per group, measure and value: (by.., measure, value, n)."""
    long = df.unpivot([F.col(key) for key in by], [F.col(m) for m in measures], "measure", "value")
    return long.groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def sorted_parts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., value, n), stored, with the number of a ``part`` in which a group's values follow those of earlier parts.

    More than ``BROADCAST_ROWS`` counts are sorted by range, null values first. Fewer are one part, in one task, which
    spares the steps that follow their shuffles.
    """
    counts = stored(counts)
    if is_small(counts, BROADCAST_ROWS):
        return counts.coalesce(1).withColumn("part", F.lit(0))
    order = [F.asc_nulls_first(name) for name in (*by, "value")]
    parts = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(parts.withColumn("part", F.spark_partition_id()))


def _known() -> Column:
    return F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)


def _wanted(quantiles: Mapping[str, float]) -> Column:
    """The ranks (from 0) on either side of each quantile of a group of ``_all`` values."""
    ranks = []
    for name, probability in quantiles.items():
        position = (F.col("_all") - 1) * F.lit(probability)
        for side, rank in (("below", F.floor(position)), ("above", F.ceil(position))):
            ranks.append(F.struct(F.lit(f"{name}_{side}").alias("name"), rank.alias("rank")))
    return F.array(*ranks)


def quantiles(
    parts: DataFrame, by: Sequence[str], wanted: Mapping[str, float] = QUARTILES,
    totals: Mapping[str, Column] | None = None, merged: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, all chosen at once from ``sorted_parts``; null without values.

    ``totals`` are further aggregates per group and part, ``merged`` those over them per group.
    """
    totals = {"_rows": F.sum(_known()), **(totals or {})}
    per_part = parts.groupBy(*by, "part").agg(*[aggregate.alias(name) for name, aggregate in totals.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_part.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_all": F.sum("_rows").over(group),
    })
    here = F.filter(
        _wanted(wanted),
        lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_rows")),
    )
    holders = placed.withColumn("_picks", here).where(F.size("_picks") > 0)
    holders = holders.select(*[F.col(key).alias(f"_{key}") for key in by], F.col("part").alias("_part"), "_before", "_all", "_picks")
    same = F.col("part") == F.col("_part")
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    inside = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = parts.where(F.col("value").isNotNull()).join(holders, same)
    ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    picked = F.filter("_picks", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("n")))
    found = ranked.select(*by, "_all", "value", F.explode(picked).alias("_pick"))
    found = found.select(*by, "_all", "value", F.col("_pick.name").alias("_name"))

    def at(name: str, side: str) -> Column:
        return F.max(F.when(F.col("_name") == f"{name}_{side}", F.col("value")))

    columns = []
    for name, probability in wanted.items():
        position = (F.max("_all") - 1) * F.lit(probability)
        below, above = at(name, "below"), at(name, "above")
        columns.append((below + (position - F.floor(position)) * (above - below)).alias(name))
    # Groups without a known value have totals only.
    told = found.unionByName(per_part.drop("part"), allowMissingColumns=True)
    return told.groupBy(*by).agg(*columns, *[aggregate.alias(name) for name, aggregate in (merged or {}).items()])


def numeric_summary(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and null count of each measure per group."""
    keys = [*by, "measure"]
    parts = sorted_parts(value_counts(df, by, measures), keys)
    totals = {
        "_min": F.min("value"), "_max": F.max("value"), "_sum": F.sum(F.col("value") * F.col("n")),
        "_nulls": F.sum(F.col("n") - _known()),
    }
    merged = {
        "min": F.min("_min"), "mean": F.try_divide(F.sum("_sum"), F.sum("_rows")), "max": F.max("_max"), "nulls": F.sum("_nulls"),
    }
    summary = quantiles(parts, keys, QUARTILES, totals, merged)
    return summary.select(*keys, "min", "q1", "median", "mean", "q3", "max", "nulls")


def box_stats(df: DataFrame, by: Sequence[str], measure: str, upper: int | None = None) -> DataFrame:
    """Box-plot statistics per group: quartiles, whisker ends and outlier count.

    Whiskers end at the extreme values within ``WHISKER_REACH`` interquartile ranges of the box, but not
    inside the box; values above ``upper`` are left out beforehand. The fences are known after the quartiles, so the
    stored counts are read once more, next to the quartiles of their group.
    """
    df = df.where(F.col(measure).isNotNull() if upper is None else F.col(measure) <= upper)
    counts = df.groupBy(*by, F.col(measure).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = sorted_parts(counts, by)
    boxes = size_checked(quantiles(parts, by))
    reach = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return attach(parts, boxes, by).groupBy(*by).agg(
        F.least(F.min(F.when(inside, F.col("value"))), F.max("q1")).alias("whisker_low"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.greatest(F.max(F.when(inside, F.col("value"))), F.max("q3")).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        F.sum("n").alias("rows"),
    )
