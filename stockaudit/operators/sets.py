"""Exact sets of numbered values as bitmaps, counted and united without expanding rows.

Every distinct value of a column gets a number once, null among them, and rows carry it. A set is then a table of
4 KB bitmaps, one per group and ``bucket`` of numbers that occurs, which Spark merges map-side whatever the number of
rows; sets of finer groups unite to those of coarser ones. Two distinct counts of one grouping are two such
aggregations, each of which reads one number, instead of rows expanded once per count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockaudit.operators.joins import stored

# The number of null; values have numbers from 1.
NULL_NUMBER = 0


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``value, number`` of the distinct known values of a column; the caller stores it before use.

    Numbers are dense within each partition, and partitions start at multiples of a bitmap's size, so a value more
    costs a bit more. They depend on the order in which rows arrive, hence the storing.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.withColumn("number", F.monotonically_increasing_id() + 1)


def with_number(df: DataFrame, column: str, number: str, numbers: DataFrame) -> DataFrame:
    """Add the number of a column's value; ``numbers`` is a stored dictionary that has every known value."""
    named = numbers.select(F.col("value").alias("_value"), F.col("number").alias(number))
    joined = df.join(named, F.col(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(number, F.coalesce(number, F.lit(NULL_NUMBER)))


def numbered(df: DataFrame, numbers: Mapping[str, str]) -> DataFrame:
    """``df`` with a number column for each ``column: number``; those it has are taken as they are."""
    for column, number in numbers.items():
        if number not in df.columns:
            df = with_number(df, column, number, stored(dictionary(df, column)))
    return df


def told_by(df: DataFrame, column: str, numbers: Mapping[str, str]) -> str:
    """The column that tells the values of ``column`` apart: its number if ``df`` has one, which is shorter to shuffle."""
    return numbers[column] if numbers[column] in df.columns else column


def value_sets(df: DataFrame, keys: Sequence[str], number: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``keys, bucket, bits``: the set of numbers of each group; ``sums`` are further aggregates of the same rows."""
    extra = [aggregate.alias(name) for name, aggregate in (sums or {}).items()]
    return df.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"), *extra
    )


def united(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets of coarser groups from those of finer ones."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_sizes(sets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number of values in each group's set."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))


def side_by_side(keys: Sequence[str], sets: Mapping[str, DataFrame], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Sizes of several sets per group as columns, in one grouping of their bitmaps' counts.

    ``sums`` are aggregates over the columns that the first table has besides its bitmaps.
    """
    stacked = None
    for position, (name, table) in enumerate(sets.items()):
        counts = table.withColumn(name, F.bitmap_count("bits")).drop("bits", "bucket")
        stacked = counts if position == 0 else stacked.unionByName(counts, allowMissingColumns=True)
    sizes = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sets]
    return stacked.groupBy(*keys).agg(*[a.alias(n) for n, a in (sums or {}).items()], *sizes)


def distinct_totals(df: DataFrame, keys: Sequence[str], counts: Mapping[str, str], strict_sum: str | None = None) -> DataFrame:
    """Distinct values per group, ``counts`` from column names to number columns, null counted as a value.

    ``strict_sum`` adds the sum of a column, null if one of its values is.
    """
    sums = {}
    if strict_sum is not None:
        value = F.col(strict_sum)
        sums = {"_sum": F.sum(value), "_known": F.count(value), "_rows": F.count(F.lit(1))}
    sets = {
        name: value_sets(df, keys, number, sums if position == 0 else None)
        for position, (name, number) in enumerate(counts.items())
    }
    if strict_sum is None:
        return side_by_side(keys, sets)
    total = F.when(F.sum("_rows") == F.sum("_known"), F.sum("_sum"))
    return side_by_side(keys, sets, {strict_sum: total})
