"""Tables that a stream writes batch by batch, so that a batch which is run again counts once.

A batch's rows go to folders named by its number, and become visible when its manifest, a small file of the same number, is
renamed into place. A batch whose manifest is there is skipped; one that failed before writes its folders anew. Readers take
the newest manifest: they see whole batches only. A table of keys is dealt to buckets, and a batch rewrites the buckets that
it touches; the manifest names each bucket's folder, so that its size is that of the bucket count. One stream writes a
table, as Structured Streaming numbers the batches of its checkpoint.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/manifests/{number:020d}.json"


def is_published(spark: SparkSession, root: str, number: int) -> bool:
    store, at = _store(spark, _manifest(root, number))
    return store.exists(at)


def publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Write a manifest beside its place and rename it: it is there whole, or not at all."""
    path = _manifest(root, number)
    store, draft = _store(spark, path.replace("/manifests/", "/drafts/"))
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    place = _store(spark, path)[1]
    store.mkdirs(place.getParent())
    if not store.rename(draft, place):
        raise OSError(f"the manifest {path} could not be put into place")


def manifests(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all published batches, ascending."""
    store, at = _store(spark, f"{root.rstrip('/')}/manifests")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in store.listStatus(at)) if store.exists(at) else []


def read_manifest(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(_manifest(root, number)).collect()))


# ---- append


def append_batch(batch: DataFrame, number: int, root: str) -> None:
    """Add the rows of a batch to a table, once."""
    spark = batch.sparkSession
    if is_published(spark, root, number):
        return
    folder = f"data/{number:020d}"
    batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{folder}")
    publish(spark, root, number, {"folders": [folder]})


def appended(spark: SparkSession, root: str, schema: str, since: int = -1) -> DataFrame:
    """The rows of all published batches with a greater number than ``since``, with their batch number: a poll takes those
    that it hasn't seen."""
    numbers = [n for n in manifests(spark, root) if n > since]
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    paths = [f"{root.rstrip('/')}/data/{n:020d}" for n in numbers]
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d{20})/", 1).cast("long"))


def append_stream(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- upsert


def upsert_batch(batch: DataFrame, number: int, root: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Put the rows of a batch into a table of keys: the row of the greatest ``order`` stays. Rows without a key are left out.

    Only the buckets that the batch touches are read and written again, beside the old ones.
    """
    spark = batch.sparkSession
    if is_published(spark, root, number):
        return
    root = root.rstrip("/")
    before = [n for n in manifests(spark, root) if n < number]
    folders: dict[str, str] = read_manifest(spark, root, before[-1])["folders"] if before else {}
    rows = batch.filter(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
    old = [f"{root}/{folders[str(b)]}" for b in touched if str(b) in folders]
    if old:
        known = spark.read.schema(batch.schema).parquet(*old)
        rows = rows.unionByName(known.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")))
    newest = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("_bucket", "r.*")
    folder = f"data/{number:020d}"
    newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{folder}")
    publish(spark, root, number, {"folders": folders | {str(b): f"{folder}/_bucket={b}" for b in touched}, "buckets": buckets})


def upserted(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table as its newest manifest says."""
    numbers = manifests(spark, root)
    folders = read_manifest(spark, root, numbers[-1])["folders"] if numbers else {}
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root.rstrip('/')}/{f}" for f in folders.values()))


def upsert_stream(rows: DataFrame, root: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS) -> StreamingQuery:
    return rows.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, number, root, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
