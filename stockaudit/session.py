"""Session settings the reports are meant to run under, and where checkpoints go."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Adaptive execution sizes reducers, splits skewed join partitions and demotes
    # sort-merge joins whose measured side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Spares a Python stack walk per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "stockaudit", **overrides: str) -> SparkSession:
    """A session with ``SETTINGS``; pass ``master=`` for local runs, dots in keys as ``__``."""
    builder = SparkSession.builder.appName(name)
    if "master" in overrides:
        builder = builder.master(overrides.pop("master"))
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in overrides.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Make an existing folder go when the application ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; below the warehouse if local mode names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
        delete_at_end(spark, context.getCheckpointDir())
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
