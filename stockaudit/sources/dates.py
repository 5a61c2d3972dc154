"""Dates typed once, from the texts of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockaudit.functions.scalars import parse_date, parse_timestamp
from stockaudit.sources import schemas


def _lacking(df: DataFrame, name: str) -> bool:
    return not set(schemas.TYPED[name].names) <= set(df.columns)


def with_count_dates(detail: DataFrame) -> DataFrame:
    """Add ``count_date`` and ``month`` to counted lines that lack them."""
    if not _lacking(detail, "count_detail"):
        return detail
    day = parse_date(F.col("counted_on"))
    return detail.withColumns({"count_date": day, "month": F.month(day)})


def with_move_times(moves: DataFrame) -> DataFrame:
    """Add ``moved_at`` and ``moved_on`` to movements that lack them."""
    if not _lacking(moves, "movements"):
        return moves
    moment = parse_timestamp(F.col("moved_text"))
    return moves.withColumns({"moved_at": moment, "moved_on": moment.cast("date")})


def with_update_times(stock: DataFrame) -> DataFrame:
    """Add ``updated_at`` to stock lines that lack it."""
    if not _lacking(stock, "address_stock"):
        return stock
    return stock.withColumn("updated_at", parse_timestamp(F.col("updated_text")))


TYPING = {"count_detail": with_count_dates, "address_stock": with_update_times, "movements": with_move_times}


def typed(df: DataFrame, name: str) -> DataFrame:
    """An input with the columns that are typed from its texts."""
    return TYPING[name](df) if name in TYPING else df
