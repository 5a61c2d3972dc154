"""Where the operators read the given tables and write what is read more than once."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockaudit.operators.joins import BROADCAST_ROWS, filter_words, may_be_in, membership_filter
from stockaudit.session import delete_at_end, ensure_checkpoint_dir

# Folders landed since the last chain of steps began.
_landed: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}/{name}"


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, its lineage cut.

    The folder goes when the application ends, or earlier by ``forget`` or ``reclaim``.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    folder = path.rsplit("/", 1)[0]
    delete_at_end(spark, folder)
    _landed.append(folder)
    table = spark.read.schema(df.schema).parquet(path)
    table._landed_folder = folder
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``landed`` has returned; nothing that still has to be computed may read them."""
    for table in tables:
        _delete(table.sparkSession, table._landed_folder)
        if table._landed_folder in _landed:
            _landed.remove(table._landed_folder)


def begin_chain() -> None:
    """From here on, what is landed belongs to a chain of steps whose results are written one after the other."""
    _landed.clear()


def reclaim(docs: DataFrame) -> None:
    """Delete what earlier steps of the chain have landed, if ``docs``, the input of the next one, does not read it.

    Spark is told to drop the shuffles that nothing refers to any more.
    """
    read_now = docs.inputFiles()
    for folder in list(_landed):
        # Its last part is unique; Spark may write the rest in another way.
        if not any(folder.rsplit("/", 1)[1] in file for file in read_now):
            _delete(docs.sparkSession, folder)
            _landed.remove(folder)
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


# Rows of a table with lists, whose size is not only that of its rows, that may be broadcast.
LISTED_ROWS = 20_000


def split_by_membership(df: DataFrame, key: str, values: DataFrame, few: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``df`` whose ``key`` may be in ``values``, rows whose key is surely not), where they are.

    ``values`` is a stored column of that name, of the same type, without nulls. For up to ``few`` values (by default
    ``BROADCAST_ROWS``) there is nothing to gain, and all rows are in the first part; else a Bloom filter parts them, so that only the first need a
    shuffled join.
    """
    size = values.count()
    if size <= (BROADCAST_ROWS if few is None else few):
        return df, None
    bits = filter_words(size)
    likely = may_be_in(F.col(key), membership_filter(values, bits), bits)
    return df.where(likely), df.where(~likely)


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores before it until no column (in any case) has that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
