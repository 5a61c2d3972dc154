"""SKUs per address from the pre-aggregated extract (input: ``ADDRESS_DENSITY``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stockaudit import fixed_values as fixed
from stockaudit.functions.scalars import density_bucket, in_market, ratio
from stockaudit.operators.aggregates import pivot_wide, row_count
from stockaudit.operators.windows import share


def ge_share(extract: DataFrame, area: str, edge: int = fixed.DENSE_FROM) -> DataFrame:
    """Part of a site's tuples held in addresses of at least ``edge`` SKUs."""
    buckets = extract.where(F.col("address_id").startswith(area)).withColumn(
        "bucket", density_bucket(F.col("sku_count"), edge)
    )
    wide = pivot_wide(buckets, ["site_id"], "bucket", {"ge": "ge", "lt": "lt"}, "sku_count", fill=0)
    return wide.select("site_id", ratio(F.col("ge"), F.col("lt") + F.col("ge")).alias("share_ge"))


def histogram(extract: DataFrame, site: str) -> DataFrame:
    """Addresses per density of one site."""
    return row_count(extract.where(F.col("site_id") == site), ["sku_count"], "addresses")


def share_histogram(
    extract: DataFrame, sites: Sequence[str], prefix: str, without: str, max_density: int = fixed.MAX_DENSITY
) -> DataFrame:
    """Addresses per site and density as parts of all the site's addresses, then the low densities.

    Sites are those listed that start with ``prefix`` and do not contain ``without``.
    """
    site = F.col("site_id")
    kept = extract.where(site.isin(*sites) & site.startswith(prefix) & ~site.contains(without))
    counts = row_count(kept, ["site_id", "sku_count"], "addresses").withColumns({
        "share": share("addresses", ["site_id"]),
        "density_order": F.dense_rank().over(Window.orderBy(F.asc_nulls_last("sku_count"))),
    })
    return counts.where(F.col("sku_count") <= max_density)


def market_counts(extract: DataFrame, market: str, area: str) -> DataFrame:
    """Addresses per density and site of one market and area."""
    kept = extract.where(in_market(F.col("site_id"), market) & F.col("address_id").startswith(area))
    return row_count(kept, ["sku_count", "site_id"], "addresses")
