"""Aggregates with explicit null rules, and the group-and-count shapes built on them.

All groupings aggregate map-side before their shuffle, and every distinct count shuffles on
(key, value), so one hot key is spread over many reducers and only its partial counts meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def n_distinct(column: str | Column) -> Column:
    """Distinct values of a column, null counted as one value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))


def strict(aggregate: Callable[[Column], Column], column: str | Column) -> Column:
    """An aggregate that is null as soon as one input is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(F.lit(1)) == F.count(column), aggregate(column))


def sum_strict(column: str | Column) -> Column:
    """Sum, null if any input is null."""
    return strict(F.sum, column)


def max_strict(column: str | Column) -> Column:
    return strict(F.max, column)


def min_strict(column: str | Column) -> Column:
    return strict(F.min, column)


def mean_strict(column: str | Column) -> Column:
    return strict(F.avg, column)


def sum_or_zero(column: str | Column) -> Column:
    """Sum over the non-null inputs, 0 when there are none."""
    return F.coalesce(F.sum(column), F.lit(0))


def row_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key; null keys form a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def weighted_count(df: DataFrame, keys: Sequence[str], weight: str, name: str = "n") -> DataFrame:
    """Sum of a weight per key, nulls skipped, 0 when all are null."""
    return df.groupBy(*keys).agg(sum_or_zero(weight).alias(name))


def distinct_then_count(df: DataFrame, keys: Sequence[str], within: Sequence[str], name: str) -> DataFrame:
    """Distinct values counted within a finer group, then summed to ``keys``.

    The sum over addresses of their distinct SKUs equals the number of distinct
    (address, SKU) rows, so one distinct and a partial count do the work of two
    distinct-count stages; null values count, as in ``n_distinct``.
    """
    return row_count(df.select(*keys, *within).distinct(), keys, name)


def pivot_wide(
    df: DataFrame,
    keys: Sequence[str],
    on: str,
    columns: dict,
    value: str | Column,
    fill: int | None = None,
    rest: str | None = None,
) -> DataFrame:
    """Spread ``value`` into one column per listed value of ``on``.

    ``columns`` maps values of ``on`` (None for null) to output names. Absent cells are null,
    or ``fill``. ``rest`` names a column for all other values of ``on``, so that none is lost; null is
    among them unless listed. Conditional sums need one shuffle and no job to discover the values.
    """
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in pivot_sums(on, columns, value, fill, rest).items()])


def pivot_sums(
    on: str, columns: dict, value: str | Column, fill: int | None = None, rest: str | None = None
) -> dict[str, Column]:
    """The conditional sums of ``pivot_wide``, to combine with other aggregates."""
    value = F.col(value) if isinstance(value, str) else value
    cases = {name: F.col(on).isNull() if key is None else F.col(on) == key for key, name in columns.items()}
    if rest is not None:
        listed = F.coalesce(F.col(on).isin([key for key in columns if key is not None]), F.lit(None in columns))
        cases[rest] = ~listed
    sums = {}
    for name, case in cases.items():
        cell = F.sum(F.when(case, value))
        sums[name] = cell if fill is None else F.coalesce(cell, F.lit(fill))
    return sums


def with_total_row(df: DataFrame, label: dict[str, str], totals: dict[str, Column]) -> DataFrame:
    """Append one row of aggregates over ``df``; columns not named become null.

    ``df`` is expected to be a finished report. Both branches of the union share its shuffle.
    """
    total = df.agg(*[column.alias(name) for name, column in totals.items()])
    total = total.withColumns({name: F.lit(text) for name, text in label.items()})
    return df.unionByName(total, allowMissingColumns=True)
