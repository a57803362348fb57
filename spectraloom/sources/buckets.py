"""Tables that are merged in place: rows lie in buckets by their keys' hash, and a batch reads and rewrites the buckets it touches alone.

A batch writes its buckets beside the old ones (``data/batch=…/bucket=…``) and then, in one small file, that they hold (``log/batch=…``).
Readers take each bucket from the last batch that the log names, so they see a batch whole or not at all. A batch that failed before its log is written over
by its rerun, and one that is in the log is left out when it comes again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.session import removed

LOG = "batch bigint, bucket int"


def bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int")


def _log(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{path}/log")


def current(spark: SparkSession, path: str) -> dict[int, int]:
    """By bucket, the batch that holds it: a row a bucket, whatever the table."""
    return {r["bucket"]: r["batch"] for r in _log(spark, path).where("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def read(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets."""
    held = current(spark, path)
    paths = [f"{path}/data/batch={held[b]}/bucket={b}" for b in sorted(held if buckets is None else set(held) & set(buckets))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(path: str, incoming: DataFrame, batch: int, keys: list[str], schema: str, merged: Callable[[DataFrame, DataFrame], DataFrame], n: int = 256) -> list[int]:
    """Merges a batch: `merged` gets the stored rows of the buckets that `incoming` touches, and `incoming`, and returns those buckets' rows anew. Returns the buckets that were touched.

    `keys` are the columns by which rows are merged, here and there; `n` must stay as it was. A batch number
    that has been merged already changes nothing. Batches must come with rising numbers. An empty batch is noted alone.
    """
    spark = incoming.sparkSession
    if _log(spark, path).where(F.col("batch") == batch).limit(1).count():
        return []
    touched = sorted(r[0] for r in incoming.select(bucket(keys, n)).distinct().collect())  # n at most
    if touched:
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        made = merged(read(spark, path, schema, touched), incoming).select(*[F.col(f"`{c}`") for c in names])
        made.withColumn("bucket", bucket(keys, n)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/batch={batch}")
    rows = [(batch, b) for b in touched] or [(batch, -1)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return touched


def tidied(spark: SparkSession, path: str) -> None:
    """Removes the buckets that later batches have replaced; no reader of older plans may be at work."""
    held = current(spark, path)
    for r in _log(spark, path).where("bucket >= 0").collect():  # a row for each bucket that a batch has touched
        if held[r["bucket"]] != r["batch"]:
            removed(spark, f"{path}/data/batch={r['batch']}/bucket={r['bucket']}")
