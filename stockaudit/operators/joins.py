"""Joins against small derived tables, with the size checked before any broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockaudit.session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000
# A filter of a larger set has twelve bits a value and at most these 64-bit words (4 MB).
FILTER_BITS = 12
FILTER_PROBES = 3
FILTER_WORDS = 1 << 19


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def is_small(stored_df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most ``max_rows`` rows."""
    return stored_df.count() <= max_rows


def size_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute ``df`` once, then mark it for broadcast only if its counted size allows.

    Beyond the bound the join stays a shuffled one, whose skewed partitions adaptive
    execution splits.
    """
    table = stored(df)
    return F.broadcast(table) if is_small(table, max_rows) else table


def attach(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join a one-row-per-key table; null keys match null keys."""
    renamed = table.withColumnsRenamed({key: f"_{key}" for key in on})
    condition = F.lit(True)
    for position, key in enumerate(on):
        match = F.col(key).eqNullSafe(F.col(f"_{key}"))
        condition = match if position == 0 else condition & match
    return df.join(renamed, condition, "left").drop(*[f"_{key}" for key in on])


def filter_words(values: int) -> int:
    """64-bit words of the filter of so many values: a power of two, bounded."""
    words = 1
    while words * 64 < values * FILTER_BITS and words < FILTER_WORDS:
        words *= 2
    return words


def _filter_bits(value: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(probe)), F.lit(words * 64)) for probe in range(FILTER_PROBES)]


def _bit_mask(bit: Column) -> Column:
    # A shift of a long takes the low six bits of its distance.
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def membership_filter(values: DataFrame, words: int) -> DataFrame:
    """The Bloom filter of a one-column table, as one row with an array of ``words`` longs."""
    bits = values.select(F.explode(F.array(*_filter_bits(F.col(values.columns[0]), words))).alias("bit"))
    marked = bits.select(F.expr("bit div 64").alias("word"), _bit_mask(F.col("bit")).alias("mask"))
    empty = values.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    merged = marked.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return merged.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all")).select(F.col("all.mask"))


def may_be_in(column: Column, bloom: DataFrame, words: int) -> Column:
    """False only for values that are not in the set; the filter is computed once, before the scan that uses it."""
    lanes = bloom.scalar()
    test = None
    for bit in _filter_bits(column, words):
        hit = F.get(lanes, F.call_function("shiftright", bit, F.lit(6)).cast("int")).bitwiseAND(_bit_mask(bit)) != 0
        test = hit if test is None else test & hit
    return test


def keep_matching(df: DataFrame, column: str, values: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose ``column`` occurs in the one column of ``values``; null matches null.

    A set of up to ``max_rows`` values is broadcast. For a larger one the join is shuffled, of the rows only that pass
    a Bloom filter of the set at the scan; a set too large for a filter of ``FILTER_WORDS`` to tell has none.
    """
    allowed = stored(values.toDF("_value").distinct())
    size = allowed.count()
    if size <= max_rows:
        allowed = F.broadcast(allowed)
    elif df.schema[column].dataType == allowed.schema["_value"].dataType and size * FILTER_PROBES < FILTER_WORDS * 64:
        words = filter_words(size)
        df = df.where(may_be_in(F.col(column), membership_filter(allowed, words), words))
    return df.join(allowed, F.col(column).eqNullSafe(F.col("_value")), "left_semi")
