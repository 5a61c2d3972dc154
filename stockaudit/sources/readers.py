"""CSV extracts to typed DataFrames, column names included."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockaudit.fixed_values import EXTRACT_COLUMNS, MISSING
from stockaudit.sources import schemas
from stockaudit.sources.dates import typed
from stockaudit.sources.dialects import BYTE_ORDER_MARK, Dialect, files_by_dialect, plain_number


def snake_case(name: str) -> str:
    """A header as a lower-case identifier: accents dropped, words joined by underscores."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    plain = plain.replace("%", " percent ").replace("#", " number ").replace("'", "")
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
    plain = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", plain)
    plain = re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower()
    return f"x{plain}" if not plain or plain[0].isdigit() else plain


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to unique snake_case; repeats get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def _read_text(spark: SparkSession, files: list[str], dialect: Dialect) -> DataFrame:
    # Text columns only: each one is typed by the caller, so that a bad value becomes null
    # instead of failing the job, and no pass over the data infers types.
    df = spark.read.csv(
        files, sep=dialect.separator, encoding=dialect.encoding, header=True, inferSchema=False, escape='"',
        enforceSchema=False,
    )
    return df.withColumnRenamed(df.columns[0], df.columns[0].removeprefix(BYTE_ORDER_MARK))


def _typed(df: DataFrame, schema: T.StructType, rename: Mapping[str, str], text: bool, decimal: str) -> DataFrame:
    """Select the schema's columns by name, typed; ``rename`` maps extract to schema names."""
    source = {rename.get(column, column): column for column in df.columns}
    missing = [field.name for field in schema if field.name not in source]
    if missing:
        raise ValueError(f"extract lacks columns {missing}; it has {df.columns}")
    return df.select(*[_cell(F.col(source[f.name]), f.dataType, text, decimal).alias(f.name) for f in schema])


def _cell(value: Column, kind: T.DataType, keep_empty: bool, decimal: str) -> Column:
    present = F.when(value != MISSING, value)
    if isinstance(kind, T.IntegralType):
        # A whole number may be written with decimals; a fraction is not a whole number.
        number = plain_number(present, decimal).try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number.try_cast(kind))
    if isinstance(kind, T.NumericType):
        return plain_number(present, decimal).try_cast(kind)
    if not isinstance(kind, T.StringType):
        return F.trim(present).try_cast(kind)
    # The reader gives null for an unquoted empty field and '' for a quoted one.
    if keep_empty:
        return F.when(value.isNull(), "").otherwise(present)
    return F.nullif(present, F.lit(""))


def _read(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, rename: Mapping[str, str] | None,
    text: bool, **known: str | None,
) -> DataFrame:
    """Files of each dialect and header read together and typed, then stacked."""
    stacked = None
    for dialect, files in files_by_dialect(spark, path, **known).items():
        df = _read_text(spark, files, dialect)
        df = _typed(clean_names(df) if text else df, schema, rename or {}, text, dialect.decimal)
        stacked = df if stacked is None else stacked.unionByName(df)
    if stacked is None:
        raise ValueError(f"no file with a header in {path}")
    return stacked


def read_summary(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, rename: Mapping[str, str] | None = None,
    separator: str | None = None, encoding: str | None = None, decimal: str | None = None,
) -> DataFrame:
    """CSV files whose empty and ``NA`` fields are null. Header names are kept as they are.

    ``path`` may name several files and folders. Each file's separator, decimal sign, encoding (UTF-8, else Latin-1)
    and column order are told from its beginning; those given here hold for all files.
    """
    return _read(spark, path, schema, rename, False, separator=separator, encoding=encoding, decimal=decimal)


def read_extract(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, rename: Mapping[str, str] | None = None,
    separator: str | None = None, encoding: str | None = None, decimal: str | None = None,
) -> DataFrame:
    """CSV extracts whose empty text fields stay ``''``; names are cleaned before renaming. Otherwise like ``read_summary``."""
    return _read(spark, path, schema, rename, True, separator=separator, encoding=encoding, decimal=decimal)


def read_input(spark: SparkSession, name: str, path: str | Sequence[str]) -> DataFrame:
    """One of the six inputs from CSV files that have the original column names, its dates typed."""
    read = read_summary if name == "cycle_summary" else read_extract
    return typed(read(spark, path, schemas.as_extracted(name), EXTRACT_COLUMNS[name]), name)


def read_address_stock(spark: SparkSession, paths: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """The stock of several sites from their extracts, given as site to path."""
    stock = union_sources({site: read_input(spark, "address_stock", path) for site, path in paths.items()}, "site_id")
    return relocate(stock, "site_id", before="address_id")


def with_source(df: DataFrame, name: str, value: str | None) -> DataFrame:
    """Tag every row with where it came from, null where that is unknown."""
    return df.withColumn(name, F.lit(value).cast("string"))


def union_sources(sources: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack like extracts by column name, each tagged with its key; absent columns are null."""
    tagged = [with_source(df, tag, value) for value, df in sources.items()]
    stacked = tagged[0]
    for df in tagged[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    return stacked


def relocate(df: DataFrame, column: str, before: str) -> DataFrame:
    """Move a column in front of another."""
    names = [name for name in df.columns if name != column]
    names.insert(names.index(before), column)
    return df.select(*names)
