"""Top-k and top-fraction with ties kept, without moving all rows to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.operators.joins import size_checked

SKETCH_ERROR = 0.001
# Rows that one task may put in order.
ORDERED_ROWS = 100_000


def top_n_ties(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` largest, ties with the last one kept.

    Only ``k`` values per task reach the driver side of the top-k; the rows themselves are
    filtered where they are, however many tie. Nulls never qualify.
    """
    largest = df.select(column).where(F.col(column).isNotNull()).orderBy(F.desc(column)).limit(k)
    threshold = largest.agg(F.min(column))
    return df.where(F.col(column) >= threshold.scalar())


def top_groups_ties(
    counts: DataFrame, by: str, column: str, k: int, lines: DataFrame, rest: dict[str, Column]
) -> DataFrame:
    """The groups whose ``column`` is among the ``k`` largest, ties kept, with aggregates of their lines.

    ``counts`` has a row per group, all that the cutoff and the choice need, so that both come from one computation
    of it. The chosen groups are stored and counted, for as many may tie as there are groups; where they are few they
    are sent to the lines, and only theirs are aggregated. Null is a group like others.
    """
    chosen = size_checked(top_n_ties(counts, column, k).select(F.col(by).alias("_group"), column))
    found = lines.join(chosen, F.col(by).eqNullSafe(F.col("_group")))
    return found.groupBy(by, column).agg(*[aggregate.alias(name) for name, aggregate in rest.items()])


def top_fraction_ties(df: DataFrame, column: str, fraction: float, in_order: int = ORDERED_ROWS) -> DataFrame:
    """Rows whose minimum descending rank is at most ``fraction`` of the row count.

    Row count includes nulls, which never qualify themselves. ``df`` should be a scan or a stored table, as
    its one column is read several times. Nothing is stored: the driver sees single numbers, at most
    ``in_order`` rows are put in order by one task, and the final filter can reach the scan.
    """
    value = F.col(column)
    total, known = df.agg(F.count(F.lit(1)), F.count(column)).first()
    allowed = math.floor(fraction * total)
    if allowed == 0:
        return df.where(F.lit(False))
    if allowed >= known:
        return df.where(value.isNotNull())
    return df.where(value >= _cutoff(df.select(column).where(value.isNotNull()), column, known, allowed, in_order))


def _cutoff(values: DataFrame, column: str, known: int, allowed: int, in_order: int):
    """The smallest value with fewer than ``allowed`` of the ``known`` rows above it.

    A bracket around it is narrowed from both sides: a quantile sketch of the values inside proposes two of
    them, and counts of the rows above and at each tell on which side the cutoff lies, or that it is one of
    them. Each proposed value leaves the bracket, so that many rows of one value do not hold it open.
    """
    value = F.col(column)
    inside, above, below = values, 0, 0
    while known - above - below > in_order:
        rows = known - above - below
        place = 1 - (allowed - above) / rows
        proposed = inside.approxQuantile(
            column, [max(0.0, place - 2 * SKETCH_ERROR), min(1.0, place + 2 * SKETCH_ERROR)], SKETCH_ERROR
        )
        if not proposed:
            # The sketch leaves out what is not a number, and nothing else is left.
            return float("nan")
        counts = inside.agg(*[
            F.count_if(test).alias(f"{name}{i}")
            for i, p in enumerate(proposed) for name, test in (("more", value > p), ("equal", value == p))
        ]).first()
        low, high, over, under = None, None, above, below
        for i, p in enumerate(proposed):
            more, equal = counts[f"more{i}"], counts[f"equal{i}"]
            if above + more >= allowed:
                low, under = p, known - above - more
            elif above + more + equal >= allowed:
                return p
            elif high is None:
                high, over = p, above + more + equal
        if low is not None:
            inside = inside.where(value > low)
        if high is not None:
            inside = inside.where(value < high)
        above, below = over, under
    larger = above + F.sum("n").over(Window.orderBy(F.desc(column))) - F.col("n")
    counted = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("larger", larger)
    return counted.where(F.col("larger") < allowed).agg(F.min(column)).first()[0]
