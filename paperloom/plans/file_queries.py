"""Queries that write rows of the tables to files and read them back through the file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import query
from paperloom.session import new_path, table
from paperloom.sources import registry_csv


@query("registry_csv_records", """
SELECT lpad(c_custkey::VARCHAR, 8, '0') AS vat, c_name || CASE WHEN c_custkey % 5 = 0 THEN ', "' || c_mktsegment || '"' ELSE '' END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'line ' || c_nationkey || chr(10) || chr(10) || '台北' WHEN c_custkey % 11 = 0 THEN '' ELSE 'street ' || c_nationkey END AS address FROM customer""")
def registry_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as quoted CSV, cells over several lines included, and read in ranges of bytes."""
    key = F.col("c_custkey")
    name = F.concat("c_name", F.when(key % 5 == 0, F.concat(F.lit(', ""'), "c_mktsegment", F.lit('""'))).otherwise(""))
    address = F.when(key % 7 == 0, F.concat(F.lit("line "), F.col("c_nationkey").cast("string"), F.lit("\n\n台北"))).when(key % 11 == 0, "").otherwise(F.concat(F.lit("street "), F.col("c_nationkey").cast("string")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lpad(key.cast("string"), 8, "0"), F.lit(',"'), name, F.lit('","'), address, F.lit('"')).alias("value"))
    folder = new_path(spark, "registry-csv")

    # each file of the export has its own header
    rows.mapInPandas(with_header, "value string").write.text(folder)
    return registry_csv.named(registry_csv.read_csv(spark, folder), {"vat": "統一編號", "name": "營業人名稱", "address": "營業地址"}).drop("path", "pos")


def with_header(frames):
    """The lines of a task behind a header line; a task without rows writes none."""
    first = True
    for frame in frames:
        if first and len(frame):
            first = False
            yield frame[["value"]].iloc[:1].assign(value="統一編號,營業人名稱,營業地址")
        yield frame[["value"]]
