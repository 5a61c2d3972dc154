"""The six input tables, derived from the star-schema test data by key arithmetic.

The tables take the place of the extracts a site would load: each is derived once per
application from all rows of its source, written to the shared folder as Parquet and read
from there, so reports scan typed files that can be filtered and pruned.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockaudit.operators import sets
from stockaudit.session import delete_at_end, ensure_checkpoint_dir
from stockaudit.sources import schemas
from stockaudit.sources.dates import typed

# A third of the lines lie in the first site, a twelfth in none.
SITE = """elt(cast(l_orderkey % 12 + 1 AS int), 'BR01', 'BR01', 'BR01', 'BR01', 'BR02', 'BR03', 'BRTR1', 'MX01', 'MX02', 'AR01',
      'CL01', null)"""
AREA = "elt(cast(l_orderkey div 8 % 6 + 1 AS int), 'MZ', 'MZ', 'MZ', 'PW', 'MU', 'RK')"
LEVEL = "cast(l_orderkey div 48 % 9 + 1 AS int)"
# Floors 00 to 12, and some that are no number.
FLOOR = "if(area = 'RK' OR l_orderkey % 97 = 0, 'XX', lpad(l_orderkey div 48 % 13, 2, '0'))"
ZONE = "l_orderkey % 3"
ADDRESS = f"""
    concat_ws('-', area, {ZONE}, lpad(l_orderkey div 1000 % 1000, 3, '0'), lpad(l_orderkey % 1000, 3, '0'), {FLOOR})"""
# Rows to tell apart in one task.
DISTINCT_ROWS = 500_000
SKU = "if((l_orderkey + l_linenumber) % 101 <> 0, l_partkey, null)"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(lines: DataFrame) -> DataFrame:
    """Line items with the place each stands for."""
    lines = lines.selectExpr("*", f"{SITE} AS site_id", f"{AREA} AS area", f"{LEVEL} AS level")
    return lines.selectExpr("*", f"{ADDRESS} AS address_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_source(spark, sf_dir, "lineitem"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "part").select("p_partkey", "p_type")


def _with_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    # One plan at every size: what it shuffles grows as its input does.
    return lines.join(parts.hint("merge"), lines["l_partkey"] == parts["p_partkey"], "left")


def _numbered_lines(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """``_lines`` with the numbers of their address and SKU and, if given, what ``parts`` has of each part.

    Numbers and parts are joined to the items as they are given, and what is derived of them comes after, so that two
    shuffles carry short rows: by part, for SKU numbers and parts in one, and by address, in which order they are landed.
    """
    skus = numbers(spark, sf_dir, "sku_id").select(F.col("value").alias("_sku"), F.col("number").alias("_number"))
    if parts is not None:
        skus = skus.join(parts.hint("merge"), skus["_sku"] == parts["p_partkey"], "full_outer").withColumn("_sku", F.coalesce("_sku", "p_partkey"))
    lines = _source(spark, sf_dir, "lineitem")
    lines = lines.join(skus.hint("merge"), lines["l_partkey"] == skus["_sku"], "left")
    lines = lines.withColumn("sku_no", F.expr(f"if({SKU} IS NULL, null, _number)")).drop("_sku", "_number")
    lines = lines.withColumn("sku_no", F.coalesce("sku_no", F.lit(sets.NULL_NUMBER)))
    addressed = _placed(lines).drop("site_id", "area", "level")
    addressed = sets.with_number(addressed, "address_id", "address_no", numbers(spark, sf_dir, "address_id").hint("merge"))
    return addressed.selectExpr("*", f"{SITE} AS site_id", f"{AREA} AS area", f"{LEVEL} AS level")


def _count_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_numbered_lines(spark, sf_dir, _parts(spark, sf_dir)), *schemas.NUMBERS.values())


def _counted(lines: DataFrame, *more: str) -> DataFrame:
    """Lines with their part as counted lines."""
    lines = lines.selectExpr("*", "(l_partkey * 7 + l_linenumber * 13 + l_suppkey) % 20 AS h")
    return lines.selectExpr(
        "site_id", "area", "level", "address_id",
        f"{SKU} AS sku_id",
        "cast(l_quantity AS int) AS qty_system",
        """if(h <> 4, cast(l_quantity AS int) + CASE h WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -2 ELSE 0
           END, null) AS qty_counted""",
        # What an extract says of the divergence: not always counted minus system, and known for some uncounted lines.
        """CASE WHEN (l_orderkey + l_suppkey) % 31 = 0 THEN 0 WHEN h = 4 AND l_linenumber = 1 THEN -1
             WHEN h = 4 THEN null ELSE CASE h WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -2 ELSE 0 END END
           AS divergence_stored""",
        "if((l_orderkey * 3 + l_linenumber) % 173 <> 0, cast(cast(l_shipdate AS date) AS string), 'n/a') AS counted_on",
        "if(l_partkey % 50 <> 0, p_type, null) AS category",
        *more,
    )


def _cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few columns of the lines are needed, and none of their numbers: they are read as given, not from the landed table.
    counted = typed(_counted(_placed(_with_parts(_source(spark, sf_dir, "lineitem"), _parts(spark, sf_dir)))), "count_detail")
    lines = counted.selectExpr(
        "site_id", "area", "level", "coalesce(lpad(month, 2, '0'), '00') AS month", "qty_counted - qty_system AS divergence"
    )
    lines.createOrReplaceTempView("stockaudit_counted_lines")
    return spark.sql("""
        SELECT concat_ws('-', site_id, area, level, month) AS cycle_count_id, site_id, area, level,
          CASE WHEN level = 9 THEN null WHEN site_id LIKE 'BR%' THEN 'BR' WHEN site_id LIKE 'MX%' THEN 'MX'
            WHEN site_id = 'CL01' THEN 'CL' ELSE 'OTHER' END AS region,
          concat('2024 | ', month) AS period,
          if(population_size % 3 = 0, 'working', 'closed') AS status,
          population_size,
          if(population_size % 11 <> 0, error_tuples / population_size, null) AS p_hat,
          accurate_tuples, error_tuples,
          CASE WHEN site_id LIKE 'BR%' THEN 0.82D WHEN site_id LIKE 'MX%' THEN 0.79D ELSE 0.77D END AS target_site,
          CASE WHEN site_id LIKE 'BR%' THEN 0.80D WHEN site_id LIKE 'MX%' THEN 0.78D ELSE 0.76D END AS target_region
        FROM (
          SELECT site_id, area, level, month, count(*) AS population_size,
            count_if(divergence = 0) AS accurate_tuples, count_if(divergence <> 0) AS error_tuples
          FROM stockaudit_counted_lines GROUP BY site_id, area, level, month)""")


def _address_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).selectExpr(
        "site_id", "address_id", f"{SKU} AS sku_id",
        # Unknown in one zone of one area on one floor.
        f"if(area = 'MZ' AND {ZONE} = 2 AND {FLOOR} = '12' AND l_linenumber = 1, null, cast(l_quantity AS int)) AS units",
        """if((l_orderkey + l_linenumber) % 211 = 0, 'n/a', concat(
             substring(cast(l_shipdate AS string), 9, 2), '/', substring(cast(l_shipdate AS string), 6, 2), '/',
             substring(cast(l_shipdate AS string), 1, 4), ' ', lpad(l_linenumber, 2, '0'), ':',
             lpad(l_suppkey % 60, 2, '0'), ':', lpad(l_partkey % 60, 2, '0'))) AS updated_text""",
        "l_suppkey AS seller_id",
        "if(l_partkey % 40 <> 0, l_extendedprice, null) AS insured_value",
        *schemas.NUMBERS.values(),
    )


def _onhand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(
        "address_id", "site_id",
        "if(site_id = 'CL01' AND l_linenumber = 7, null, cast(l_quantity AS int)) AS units",
    )


def _address_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKUs per address of all counted lines, which are the line items; parts do not matter to distinct ones."""
    items = _source(spark, sf_dir, "lineitem")
    # Tasks by the number of rows, so that none holds more distinct ones at any size.
    tasks = items.count() // DISTINCT_ROWS + 1
    lines = _placed(items).selectExpr("site_id", "address_id", f"{SKU} AS sku_id")
    lines = lines.repartition(tasks, "site_id", "address_id", "sku_id").distinct()
    return lines.groupBy("site_id", "address_id").agg({"sku_id": "count"}).toDF("site_id", "address_id", "sku_count")


def _movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _source(spark, sf_dir, "events").selectExpr(
        "*", "cast(ts AS string) AS moved",
        "elt(cast(event_id % 6 + 1 AS int), 'MZ', 'MZ', 'MZ', 'PW', 'MU', 'RK') AS origin_area",
        "elt(cast(event_id div 6 % 7 + 1 AS int), 'MZ', 'MZ', 'MZ', 'PW', 'MU', 'RK', '') AS destination_area",
    )
    return events.selectExpr(
        """CASE event_type WHEN 'click' THEN 'Put away' WHEN 'purchase' THEN 'Picking' WHEN 'view' THEN 'Cycle count'
           WHEN 'signup' THEN 'Stow transfer' WHEN 'error' THEN ' adjustment' END AS process""",
        "floor(value) + 1 AS units",
        "event_id % 500 AS item_id",
        """concat_ws('-', origin_area, event_id % 3, lpad(event_id div 50 % 20, 3, '0'), lpad(event_id % 50, 3, '0'),
           lpad(event_id div 12 % 9 + 1, 2, '0')) AS origin""",
        """if(destination_area = '', '', concat_ws('-', destination_area, event_id % 3,
           lpad(event_id div 60 % 20, 3, '0'), lpad(event_id % 40, 3, '0'), lpad(event_id div 18 % 9 + 1, 2, '0')))
           AS destination""",
        """concat(substring(moved, 9, 2), '/', substring(moved, 6, 2), '/', substring(moved, 1, 4), ' ',
           substring(moved, 12, 8)) AS moved_text""",
        "user_id AS worker_id",
    )


# Builder, schema, partition column and sort column of each table.
BUILDERS = {
    "count_detail": (_count_detail, schemas.with_typed("count_detail"), "site_id", "address_id"),
    "cycle_summary": (_cycle_summary, schemas.CYCLE_SUMMARY, None, None),
    "address_stock": (_address_stock, schemas.with_typed("address_stock"), "site_id", "address_id"),
    "onhand": (_onhand, schemas.ONHAND, "site_id", None),
    "address_density": (_address_density, schemas.ADDRESS_DENSITY, "site_id", "address_id"),
    "movements": (_movements, schemas.with_typed("movements"), "moved_on", "origin"),
}

_written: dict[tuple[str, str, str], str] = {}
# One lock a table, so that tables that do not need each other are written side by side.
_locks: dict[tuple[str, str, str], threading.Lock] = {}
_lending = threading.Lock()


def land(df: DataFrame, path: str, partition_by: str | None, sort_by: str | None = None, spread: bool = False) -> None:
    """Write a table as Parquet.

    Rows are rebalanced by the partition column first, which keeps files large and splits a
    site that holds most of the rows over several writers. Rows that come ``spread`` by a shuffle
    of their own are written from where they are. Sorting within a file lets a scan
    skip the pages of other areas, whose address prefix lies outside the filter.
    """
    if partition_by is None:
        df.write.parquet(path)
        return
    balanced = df if spread else df.hint("rebalance", partition_by)
    if sort_by is not None:
        balanced = balanced.sortWithinPartitions(partition_by, sort_by)
    balanced.write.partitionBy(partition_by).parquet(path)


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a table that ``write`` fills on first use by this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lending:
        lock = _locks.setdefault(key, threading.Lock())
    with lock:
        if key not in _written:
            ensure_checkpoint_dir(spark)
            folder = f"{spark.sparkContext.getCheckpointDir()}/stockaudit-{uuid.uuid4().hex}"
            write(f"{folder}/{name}")
            delete_at_end(spark, folder)
            _written[key] = f"{folder}/{name}"
    return _written[key]


def numbers(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """The dictionary of the addresses or SKUs of all lines."""

    def write(path: str) -> None:
        values = _lines(spark, sf_dir).selectExpr("address_id", f"{SKU} AS sku_id")
        sets.dictionary(values, column).write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, f"{column}_numbers", write))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, derived and written on first use by this application."""
    build, schema, partition_by, sort_by = BUILDERS[name]

    def write(path: str) -> None:
        # Numbered lines come from a join by address.
        land(typed(build(spark, sf_dir), name), path, partition_by, sort_by, spread=name in schemas.NUMBERED)

    return read_landed(spark, _once(spark, sf_dir, name, write), schema)


def land_all(spark: SparkSession, sf_dir: str) -> None:
    """Write all input tables that this application has not written yet, side by side; a table waits for those it reads."""
    with ThreadPoolExecutor(len(BUILDERS)) as pool:
        for done in [pool.submit(table, spark, sf_dir, name) for name in BUILDERS]:
            done.result()


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed table in its declared column order; the schema spares a pass over the files."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def count_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "count_detail")


def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cycle_summary")


def address_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "address_stock")


def address_stock_sources(spark: SparkSession, sf_dir: str) -> dict[str | None, DataFrame]:
    """The stock as one extract per site, without the site column; together, all rows, also those without a site."""
    stock = address_stock(spark, sf_dir).select(*schemas.ADDRESS_STOCK.names)
    sites = sorted((row.site_id for row in stock.select("site_id").distinct().collect()), key=lambda s: (s is None, s))
    here = {site: stock["site_id"].isNull() if site is None else stock["site_id"] == site for site in sites}
    return {site: stock.where(condition).drop("site_id") for site, condition in here.items()}


def onhand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "onhand")


def address_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "address_density")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "movements")
