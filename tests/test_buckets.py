import os

import pytest

from spectraloom.operators import literature, tables
from spectraloom.sources import buckets

SCHEMA = "k string, v bigint"


def rows(spark, path):
    return {(r.k, r.v) for r in buckets.read(spark, path, SCHEMA).collect()}


def put(stored, incoming):
    return tables.replaced(stored, incoming, ["k"], ["v"])


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    at = str(tmp_path / "t")
    stored = {(f"k{i}", i) for i in range(2000)}
    assert len(buckets.merge(at, spark.createDataFrame(sorted(stored), SCHEMA), 0, ["k"], SCHEMA, put, n=64)) == 64
    news = [("k7", 70_000), ("k8", 80_000), ("new", 1)]
    touched = buckets.merge(at, spark.createDataFrame(news, SCHEMA), 1, ["k"], SCHEMA, put, n=64)
    assert len(touched) <= 3 and len(os.listdir(f"{at}/data/batch=1")) - 1 <= 4
    want = (stored - {("k7", 7), ("k8", 8)}) | set(news)
    assert rows(spark, at) == want and buckets.read(spark, at, SCHEMA).count() == 2001
    # what was read of the table are the touched buckets alone
    assert len(buckets.read(spark, at, SCHEMA, touched).inputFiles()) < 10
    # a rerun is harmless, whatever it brings
    assert buckets.merge(at, spark.createDataFrame([("k9", 0)], SCHEMA), 1, ["k"], SCHEMA, put, n=64) == []
    assert rows(spark, at) == want
    buckets.tidied(spark, at)
    assert rows(spark, at) == want and not any(os.path.exists(f"{at}/data/batch=0/bucket={b}") for b in touched)


def test_a_batch_that_failed_before_its_log_is_not_seen_and_can_run_again(spark, tmp_path, monkeypatch):
    at, df = str(tmp_path / "t"), spark.createDataFrame([("a", 1)], SCHEMA)
    buckets.merge(at, df, 0, ["k"], SCHEMA, put, n=4)

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(type(spark.range(1).write), "mode", lambda self, m, f=type(spark.range(1).write).mode: broken() if m == "append" else f(self, m))
    with pytest.raises(OSError):
        buckets.merge(at, spark.createDataFrame([("a", 5)], SCHEMA), 1, ["k"], SCHEMA, put, n=4)
    monkeypatch.undo()
    assert rows(spark, at) == {("a", 1)}  # its buckets are there, but the log doesn't name them
    buckets.merge(at, spark.createDataFrame([("a", 6)], SCHEMA), 1, ["k"], SCHEMA, put, n=4)
    assert rows(spark, at) == {("a", 6)}


def test_empty_tables_and_batches_and_null_keys(spark, tmp_path):
    at, none = str(tmp_path / "t"), spark.createDataFrame([], SCHEMA)
    assert buckets.read(spark, at, SCHEMA).count() == 0
    assert buckets.merge(at, none, 0, ["k"], SCHEMA, put) == [] and buckets.read(spark, at, SCHEMA).count() == 0
    firsts = lambda stored, incoming: tables.inserted(stored, incoming, ["k"], ["v"])
    buckets.merge(at, spark.createDataFrame([(None, 1), ("a", 1), ("a", 2)], SCHEMA), 1, ["k"], SCHEMA, firsts)
    buckets.merge(at, spark.createDataFrame([("a", 9), ("b", 3)], SCHEMA), 2, ["k"], SCHEMA, firsts)
    assert rows(spark, at) == {(None, 1), ("a", 1), ("b", 3)}


def test_queue_transitions_in_buckets_equal_those_of_the_whole_table(spark, tmp_path):
    at, schema = str(tmp_path / "q"), "doc_key string, status string, attempts bigint, last_error string"
    queue = spark.createDataFrame([(f"d{i}", "queued", i % 3, None) for i in range(300)], schema)
    outcomes = spark.createDataFrame([(f"d{i * 7}", s, "done" if s else "failed", None if s else "http") for i in range(60) for s in (0, 1)], "doc_key string, seq bigint, status string, error string")
    buckets.merge(at, queue, 0, ["doc_key"], schema, lambda stored, incoming: incoming)
    buckets.merge(at, outcomes, 1, ["doc_key"], schema, literature.queue_transitions)
    assert sorted(map(str, buckets.read(spark, at, schema).collect())) == sorted(map(str, literature.queue_transitions(queue, outcomes).collect()))
