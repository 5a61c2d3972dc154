"""Warehouse movements by process, place and day (input: ``MOVEMENTS``)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stockaudit import fixed_values as fixed
from stockaudit.functions.scalars import address_part, first_word
from stockaudit.operators.aggregates import n_distinct, row_count, sum_strict, weighted_count
from stockaudit.operators.windows import share
from stockaudit.sources import schemas
from stockaudit.sources.dates import with_move_times


def _from(area: str) -> Column:
    return F.col("origin").startswith(area)


def process_totals(moves: DataFrame) -> DataFrame:
    """Units and distinct items per process, most units first."""
    totals = moves.groupBy("process").agg(sum_strict("units").alias("units"), n_distinct("item_id").alias("items"))
    return totals.orderBy(F.desc_nulls_last("units"), F.asc_nulls_last("process"))


def parsed(moves: DataFrame) -> DataFrame:
    """Every movement with areas, quantity, time and day."""
    return with_move_times(moves).withColumns({
        "origin_area": address_part(F.col("origin"), "area"),
        "destination_area": address_part(F.col("destination"), "area"),
        "quantity": F.col("units"),
    })


def unassigned_origin(moves: DataFrame, area: str) -> DataFrame:
    """Units and days of moves out of an area that name no destination, per origin."""
    kept = with_move_times(moves).where((F.col("destination") == "") & _from(area))
    return kept.groupBy("origin").agg(
        sum_strict("units").alias("units"), n_distinct("moved_on").alias("days")
    )


def touches(moves: DataFrame) -> DataFrame:
    """One row per touched place: each move's origin and destination, in one pass."""
    places = moves.select(
        first_word(F.col("process")).alias("process"), F.explode(F.array("origin", "destination")).alias("place")
    )
    return places.withColumns({
        "floor": address_part(F.col("place"), "floor"),
        "area": address_part(F.col("place"), "area"),
    })


def touch_levels(moves: DataFrame, area: str) -> DataFrame:
    """Touches per floor of an area and their shares."""
    floors = row_count(touches(moves).where(F.col("area") == area), ["floor"], "touches")
    return floors.withColumn("share", share("touches"))


def day_origin(moves: DataFrame, day: datetime.date, area: str) -> DataFrame:
    """Units, items and moves of one day out of an area, per origin and process."""
    kept = with_move_times(moves).where((F.col("moved_on") == F.lit(day)) & _from(area))
    origins = kept.groupBy("origin", "process").agg(
        sum_strict("units").alias("units"), n_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("moves")
    )
    return origins.withColumns({
        part: address_part(F.col("origin"), part) for part in ("area", "zone", "floor")
    }).withColumnRenamed("area", "origin_area")


def level_process(moves: DataFrame, day: datetime.date, area: str) -> DataFrame:
    """Moves of one day out of an area, per floor and process."""
    return weighted_count(day_origin(moves, day, area), ["floor", "process"], "moves", "moves")


def count_lines(moves: DataFrame) -> DataFrame:
    """The movements that are cycle counts, in the columns of the extract."""
    return moves.where(F.col("process") == fixed.CYCLE_COUNT).select(*schemas.MOVEMENTS.names)


def count_daily(moves: DataFrame) -> DataFrame:
    """Items counted and people counting per day."""
    return with_move_times(moves).where(F.col("process") == fixed.CYCLE_COUNT).groupBy("moved_on").agg(
        n_distinct("item_id").alias("items"), n_distinct("worker_id").alias("people")
    )


def putaway(moves: DataFrame, area: str) -> DataFrame:
    """Put-away out of an area: units, items and moves per destination."""
    kept = moves.where(_from(area) & (F.col("process") == fixed.PUT_AWAY))
    places = kept.groupBy("destination", "process").agg(
        sum_strict("units").alias("units"), n_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("moves")
    )
    return places.withColumns({
        part: address_part(F.col("destination"), part) for part in ("area", "zone", "floor")
    }).withColumnRenamed("area", "destination_area")


def putaway_level(moves: DataFrame, area: str) -> DataFrame:
    """Items put away per floor, summed over the destinations that have an area."""
    kept = putaway(moves, area).where(F.col("destination_area") != "")
    return weighted_count(kept, ["floor"], "items", "items")
