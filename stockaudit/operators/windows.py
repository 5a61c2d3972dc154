"""Shares, running shares, ranks and orderings over aggregated results.

These use windows, so they belong on report-sized inputs: one row per site and density,
floor, level and the like. Totals for unaggregated rows are in ``operators.joins``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.functions.scalars import ratio


def total_of(column: str, by: Sequence[str] = ()) -> Column:
    """Group total of a column on every row, nulls skipped, 0 when all are null."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by)), F.lit(0))


def _group_total(column: str, by: Sequence[str], strict: bool) -> Column:
    group = Window.partitionBy(*by)
    total = F.sum(column).over(group)
    return F.when(F.count(column).over(group) == F.count(F.lit(1)).over(group), total) if strict else total


def share(column: str, by: Sequence[str] = (), strict: bool = False) -> Column:
    """A row's part of its group total (of the grand total without ``by``).

    ``strict`` makes all shares of a group null if one of its values is: its total is unknown.
    """
    return ratio(F.col(column), _group_total(column, by, strict))


def cumulative_share(column: str, order: Sequence[Column], by: Sequence[str] = (), strict: bool = False) -> Column:
    """Running part of the group total, row by row. ``order`` must break all ties.

    The running sum of the measure is divided once, so whole numbers stay exact. ``strict`` as in ``share``.
    """
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ratio(F.sum(column).over(running), _group_total(column, by, strict))


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= k).drop("_position")


def average_rank(column: str, by: Sequence[str]) -> Column:
    """Descending rank in which tied rows share the mean of their positions."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(column))) + (ties - 1) / 2


def top_flag(column: str, by: Sequence[str], k: int) -> Column:
    """True for rows whose average descending rank is at most ``k``."""
    return average_rank(column, by) <= k


def order_index(df: DataFrame, category: str, value: str | Column, name: str,
                aggregate=F.sum, descending: bool = True) -> DataFrame:
    """Add the 1-based position of a category ordered by an aggregate of its rows."""
    value = F.col(value) if isinstance(value, str) else value
    leveled = df.withColumn("_level", aggregate(value).over(Window.partitionBy(category)))
    return order_by_level(leveled, category, "_level", name, descending).drop("_level")


def order_by_level(df: DataFrame, category: str, level: str, name: str, descending: bool = True) -> DataFrame:
    """Add the 1-based position of a category by a value that all its rows share.

    Ties go by category name. Fractional levels are rounded to nine digits first, so that
    the summation order cannot decide a tie.
    """
    exact = F.round(F.col(level).cast("double"), 9)
    direction = exact.desc_nulls_last() if descending else exact.asc_nulls_last()
    return df.withColumn(name, F.dense_rank().over(Window.orderBy(direction, F.asc_nulls_last(category))))


def fixed_order(column: Column, values: Sequence[str]) -> Column:
    """1-based position in a given list, null for values outside it."""
    chain = F.when(column == values[0], 1)
    for position, value in enumerate(values[1:], start=2):
        chain = chain.when(column == value, position)
    return chain
