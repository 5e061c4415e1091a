"""Session settings shared by the engine's queries, tests and benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed or shipped with --py-files.

    Only the worker environment is changed; nothing is set that a cluster's own configuration decides.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def local_session(cpus: int | str = "*", name: str = "paperloom") -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.legacy.parquet.nanosAsLong", "false")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of bounded size: a text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for driver and executors; only a local session falls back to one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, dealt once by the keys: windows, groups and joins on these, or on these and more, move none of them again.

    The number of parts is the session's, also where rows are few: what follows may make many rows of one.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only: the folder may lie in any store that Spark reaches."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str, group: Column, *order) -> DataFrame:
    """The rows with a running number from 1 in the given order, whose first part is ``group``: rows are numbered within
    their group, and groups are offset by the counts of those before them. Only these counts meet in one task.
    """
    rows = df.withColumn("_group", group)
    counts = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_group").alias("_of"), (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    return rows.withColumn(name, within).join(before, F.col("_group") == F.col("_of")).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_group", "_of", "_before")
