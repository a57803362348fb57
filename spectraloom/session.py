"""Session helpers that every job shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "8", memory: str = "16g", name: str = "spectraloom") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. One of our own is made where that is unset on one machine; a cluster must name it."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-spectraloom-")
        _until_the_end(spark, named)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def _until_the_end(spark: SparkSession, path: str) -> None:
    """The folder is made, and removed when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, for what a query writes and reads again; it goes when the driver ends, as results are read lazily."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _until_the_end(spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that no later job reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: later jobs reread them, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows written to a folder of the shared one and read again, by which plans know their size. A checkpoint hands on its plan's estimate instead, the product of the sizes
    of all tables joined: where a loop joins its outcome with itself, its digits double each time, until they fill the driver."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpointed table in no more partitions than its rows need, so that jobs over a small one start few tasks."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def tidied(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage, upon which Spark's cleaner drops the shuffles, checkpoints and generated classes that no table needs: after many jobs, by which a driver grows."""
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches to so many rows where they are larger; they stay so, as plans are made when a DataFrame is used. It changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a 0-based rank over the whole table without one task holding it.

    Rows are range-partitioned, ranked inside each partition, and shifted by the
    counts of the partitions before; only one count a partition is gathered.
    Rows that tie in every order column keep an arbitrary order among them.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__part").count()
    starts = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    ranked = ranged.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__rank") + F.col("__start")).drop("__part", "__rank", "__start")


def running(df: DataFrame, by: list[str], order: list[str], amount: str | list[str], name: str | list[str], total: str | list[str] | None = None) -> DataFrame:
    """Adds the sum of `amount` over the rows before, within `by` and in ascending `order`, without one task holding a group; or those of several amounts.
    With `total`, also that of all rows of `by`, which a join by few groups would bring to few tasks.

    (by, order) must tell rows apart. Only one sum for each range and group in it is ranked in a window.
    """
    amounts, names = ([amount], [name]) if isinstance(amount, str) else (amount, name)
    totals = [] if total is None else [total] if isinstance(total, str) else total
    ranged = checkpointed(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = ranged.groupBy(*by, "__part").agg(*[F.sum(a).alias(f"__sum_{i}") for i, a in enumerate(amounts)])
    all_ = [F.sum(f"__sum_{i}").over(Window.partitionBy(*by)).alias(t) for i, t in enumerate(totals)]
    starts = sums.select(*by, "__part", *[zero(F.sum(f"__sum_{i}").over(before)).alias(f"__start_{i}") for i in range(len(amounts))], *all_)
    own = ranged.withColumns({f"__own_{i}": zero(F.sum(a).over(inside)) for i, a in enumerate(amounts)}).join(starts, [*by, "__part"])
    made = own.withColumns({n: F.col(f"__own_{i}") + F.col(f"__start_{i}") for i, n in enumerate(names)})
    return made.drop("__part", *[f"__{x}_{i}" for x in ("own", "start") for i in range(len(amounts))])
