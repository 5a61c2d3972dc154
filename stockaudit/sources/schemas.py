"""Schemas of the six input tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TEXT, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

# One cycle-count stratum: site x area x level x month.
CYCLE_SUMMARY = _struct(
    cycle_count_id=TEXT, site_id=TEXT, area=TEXT, level=INT, region=TEXT, period=TEXT, status=TEXT,
    population_size=LONG, p_hat=DOUBLE, accurate_tuples=LONG, error_tuples=LONG,
    target_site=DOUBLE, target_region=DOUBLE,
)

# One counted (address, SKU).
COUNT_DETAIL = _struct(
    site_id=TEXT, area=TEXT, level=INT, address_id=TEXT, sku_id=LONG, qty_system=INT, qty_counted=INT,
    divergence_stored=INT, counted_on=TEXT, category=TEXT,
)

# One (address, SKU) on hand; one extract per site or system.
ADDRESS_STOCK = _struct(
    site_id=TEXT, address_id=TEXT, sku_id=LONG, units=INT, updated_text=TEXT, seller_id=LONG,
    insured_value=DOUBLE,
)

# One stock line of the warehouse query.
ONHAND = _struct(address_id=TEXT, site_id=TEXT, units=INT)

# One address with its number of SKUs.
ADDRESS_DENSITY = _struct(site_id=TEXT, address_id=TEXT, sku_count=LONG)

# One movement event.
MOVEMENTS = _struct(
    process=TEXT, units=LONG, item_id=LONG, origin=TEXT, destination=TEXT, moved_text=TEXT, worker_id=LONG,
)

TABLES = {
    "cycle_summary": CYCLE_SUMMARY,
    "count_detail": COUNT_DETAIL,
    "address_stock": ADDRESS_STOCK,
    "onhand": ONHAND,
    "address_density": ADDRESS_DENSITY,
    "movements": MOVEMENTS,
}

# Columns typed from text when a table is read or landed, so that reports filter on them at the scan.
TYPED = {
    "count_detail": _struct(count_date=T.DateType(), month=INT),
    "address_stock": _struct(updated_at=T.TimestampNTZType()),
    "movements": _struct(moved_at=T.TimestampNTZType(), moved_on=T.DateType()),
}

# Columns whose distinct values are counted together, and the columns of landed inputs that number them.
NUMBERS = {"address_id": "address_no", "sku_id": "sku_no"}
NUMBERED = ("count_detail", "address_stock")


def with_typed(name: str) -> T.StructType:
    """Schema of a landed input: the table's columns, those typed from its texts and its numbers."""
    numbers = [T.StructField(number, LONG) for number in NUMBERS.values()] if name in NUMBERED else []
    return T.StructType([*TABLES[name].fields, *TYPED.get(name, T.StructType()).fields, *numbers])


IDENTIFIERS = ("sku_id", "seller_id", "item_id", "worker_id")


def as_extracted(name: str) -> T.StructType:
    """Schema of an input when it is read from a CSV extract.

    Identifiers are text there and accurate tuples may be fractional; the reports only
    count, compare and add them. Stock extracts are one per site and do not name it.
    """
    kinds = {identifier: TEXT for identifier in IDENTIFIERS} | {"accurate_tuples": DOUBLE}
    fields = {field.name: kinds.get(field.name, field.dataType) for field in TABLES[name]}
    if name == "address_stock":
        fields.pop("site_id")
    return _struct(**fields)
