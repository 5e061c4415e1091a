"""What the corpus operators share: the cluster's shared folder, materialised steps and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Steps written by each driver thread.
_own = threading.local()

#: Arrow batches stay small: a document may be megabytes long.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Row groups of written steps: what a writer holds in memory.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own only where a local session names none (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    _written().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _written() -> list[str]:
    return _own.__dict__.setdefault("paths", [])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Remove written steps that nothing reads any more, in whichever file system they lie."""
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()[:1]}:
            _remove(frame.sparkSession, folder)


def steps() -> int:
    """How many steps this thread has written; for ``forget_since``."""
    return len(_written())


def forget_since(count: int, *kept: DataFrame) -> None:
    """Remove all steps that this thread has written since then, but for those that the kept frames read."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for frame in kept for f in frame.inputFiles()}
    paths = _written()
    for path in paths[count:]:
        if path.rpartition("/")[2] not in names:
            _remove(kept[0].sparkSession, path)
    del paths[count:]


def trim() -> None:
    """Give memory that a task has freed back to the system: workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


#: What operators keep in a worker from task to task, by operator: how it is dropped.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Tell that an operator keeps something in this worker, and how to drop it."""
    _kept[owner] = drop


def settle(owner: str | None = None) -> None:
    """Drop what other operators have kept in this worker: workers outlive a stage, and its caches would add to the next one's."""
    others = [_kept.pop(o) for o in list(_kept) if o != owner]
    for drop in others:
        drop()
    if others:
        trim()


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[list, list], pa.RecordBatch]],
    owner: str | None = None,
) -> DataFrame:
    """Apply a batch function to (ids, UTF-8 texts as bytes or None). ``make`` runs once per task, on the executor. ``owner``
    names the operator whose kept objects a worker may go on with.

    Only the two named columns are read, so other columns of the input can't clash with the result's.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(owner)
        work = make()
        for batch in batches:
            yield work(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
        trim()

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)
