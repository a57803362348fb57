"""Files in and out: delimited spectra, inventories, journals, canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.session import shuffle_width


def spectra_files(spark: SparkSession, path: str, pattern: str = "*.{csv,tsv,txt}") -> DataFrame:
    """(path, line_no, cells): lines of delimited files of any header; commas in csv, tabs in others."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    comma = F.lower("path").endswith(".csv")
    return named.select("path", (F.col("line_no") + 1).alias("line_no"), F.when(comma, F.split("line", ",")).otherwise(F.split("line", "\t")).alias("cells"))


def spectrum_points(lines: DataFrame, x: int = 0, y: int = 1) -> DataFrame:
    """(spectrum_id, x, y): the finite points of two columns, by file stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return lines.select(stem.alias("spectrum_id"), scalars.finite_double(F.get("cells", x)).alias("x"), scalars.finite_double(F.get("cells", y)).alias("y")).where("x is not null and y is not null")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, dataset, element): every file with its content's hash; the contents go no further than the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    hashed = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    parts = F.regexp_extract("path", r"(?i)(NF|RO)-([NO])(?=/)", 0)
    return hashed.withColumns({"dataset": F.nullif(F.upper(F.split_part(parts, F.lit("-"), F.lit(1))), F.lit("")), "element": F.nullif(F.upper(F.split_part(parts, F.lit("-"), F.lit(2))), F.lit(""))})


def with_missing(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected paths that no file has become rows with an error."""
    absent = expected.join(found, "path", "left_anti").withColumn("error", F.lit("missing"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)


JOURNAL = "task_id string, label string, kind string, status string, created_at string, finished_at string, progress map<string,string>, events array<map<string,string>>, _corrupt_record string"


def journals(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Task journals, one JSON file each, newest first; broken ones and those without a key are left out."""
    read = spark.read.schema(JOURNAL).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    kept = read.select("*", F.col("_metadata.file_modification_time").alias("modified")).where("_corrupt_record is null and task_id is not null and task_id <> ''")
    return kept.drop("_corrupt_record").orderBy(F.desc("modified"), "task_id")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """A canonical table as parquet, csv or json, partitioned where asked."""
    writer = df.write.mode("overwrite").partitionBy(*(by or []))
    getattr(writer.option("header", True) if kind == "csv" else writer, kind)(path)


def write_apart(df: DataFrame, path: str, kind: str, by: list[str]) -> None:
    """A new folder for each value of `by`, with one file in it.

    Making a file costs the same whatever it holds, so keys are dealt to all tasks however few bytes the table has (a width that is
    given is not lowered), and each task moves its own files into place, instead of the driver moving all. Read it only once it has ended.
    """
    spark = df.sparkSession
    width = max(shuffle_width(spark), 4 * spark.sparkContext.defaultParallelism)
    writer = df.repartition(width, *by).write.mode("overwrite").partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    getattr(writer.option("header", True) if kind == "csv" else writer.option("compression", "none"), kind)(path)


def export_sheets(tables: dict[tuple[str, str], DataFrame], path: str) -> None:
    """Source sheets as they are, with their workbook, sheet and row, one partition a sheet; columns that a sheet lacks are null."""
    from functools import reduce

    named = [df.select(F.lit(book).alias("_source_workbook"), F.lit(sheet).alias("_source_sheet"), *df.columns) for (book, sheet), df in tables.items()]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).write.mode("overwrite").partitionBy("_source_sheet").parquet(path)


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int]:
    """A page of a totally ordered table, and how many rows there are."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 500))), df.count()
