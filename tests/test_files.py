import re

from pyspark.sql import functions as F

from spectraloom.sources import files


def test_files_of_a_small_table_are_made_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).select(F.col("id").alias("k"), F.col("id").cast("string").alias("value")).coalesce(1)
    files.write_apart(rows, str(tmp_path / "in"), "text", ["k"])
    found = files.inventory(spark, str(tmp_path / "in"), "*.txt").collect()
    assert sorted(int(re.search(r"k=(\d+)/", r.path)[1]) for r in found) == list(range(64))
    assert len({re.search(r"part-(\d+)", r.path)[1] for r in found}) > 8  # few bytes, and yet not one task
