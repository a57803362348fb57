import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import ledger
from spectraloom.streaming import jobs, keyed

T0 = dt.datetime(2024, 5, 1)
CHUNK = jobs.CHUNK + ", ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, path, parts, schema, job):
    """The rows of all parts, a file and a batch each, through `job`; its rows, and how many bytes of state each batch had written."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        for name in os.listdir(path / "in"):  # files are read in the order of their times
            if name.startswith("part") and not os.path.exists(path / name):
                os.utime(path / "in" / name, (1_000_000 + n, 1_000_000 + n))
                (path / name).touch()
    made = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in")))
    run = made.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).trigger(availableNow=True).outputMode("append").start()
    assert run.awaitTermination(120) and run.exception() is None
    return spark.read.schema(made.schema).parquet(str(path / "out")), run.recentProgress


def chunk(request, seq, content, minutes, finish=None, **more):
    named = dict.fromkeys(c.split()[0] for c in CHUNK.split(", "))
    named.update(request_id=request, seq=seq, content=content, finish_reason=finish, ts=at(minutes), **more)
    return tuple(named.values())


def test_one_final_row_a_request_whatever_comes_late_or_twice(spark, tmp_path):
    rows = [
        [chunk(1, 2, "b", 1), chunk(2, 1, "x", 1), chunk(None, 1, "z", 1)],
        [chunk(1, 1, "a", 0, tool_index=0, tool_id="t", fn_name="f", fn_args="{"), chunk(1, 3, "c", 2, "stop", prompt_tokens=7), chunk(1, 2, "b", 1)],
        [chunk(1, 4, None, 3, reasoning="r", tool_index=0, fn_args="}"), chunk(3, 1, "late", 30, "stop")],  # time goes on: 1 and 2 close
        [chunk(1, 5, "too late", 29), chunk(3, 2, "!", 31)],  # 1 is remembered
        [chunk(-1, 0, None, 500)],
    ]
    got, _ = stream(spark, tmp_path, rows, CHUNK, lambda s: keyed.answers(s, "10 minutes", "10 minutes"))
    made = {r.request_id: r for r in got.where("request_id > 0").collect()}
    assert got.where("request_id > 0").count() == 3
    one = made[1]
    assert (one.status, one.content, one.reasoning, one.n_chunks, one.prompt_tokens) == ("complete", "abc", "r", 4, 7)
    assert [(c.id, c.name, c.arguments) for c in one.calls] == [("t", "f", "{}")]
    assert (made[2].status, made[2].content, made[2].n_chunks) == ("incomplete", None, 1)
    assert (made[3].content, made[3].n_chunks) == ("late!", 2)
    every = spark.createDataFrame([r for part in rows[:3] for r in part if r[0] == 1][:3] + [rows[2][0]], CHUNK).drop("ts").dropDuplicates(["seq"])
    assert jobs.assemble_batch(every).first().content == "abc"


def test_a_batch_writes_its_new_fragments_alone(spark, tmp_path):
    parts = [[chunk(1, 100 * b + i, f"{i}", b) for i in range(50)] for b in range(4)] + [[chunk(-1, 0, None, 900)]]
    got, progress = stream(spark, tmp_path, parts, CHUNK, lambda s: keyed.answers(s, "60 minutes", "1 minute"))
    assert got.where("request_id = 1").first().n_chunks == 200
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"] == 50]
    assert len(updated) == 4 and max(updated) < 60  # 50 fragments and the key's own entries, however many were there before


def test_time_alone_interrupts_a_task(spark, tmp_path):
    schema = "task_id string, seq bigint, status string, ts timestamp, stage string"
    parts = [
        [("a", 1, "running", at(0), "s1"), ("b", 1, "running", at(0), "s1"), ("c", 1, "running", at(0), None)],
        [("a", 2, "running", at(100), "s2"), ("b", 2, "done", at(5), "s2")],  # the clock goes on: c is silent
        [("c", 1, "running", at(90), "again")],  # not newer
        [("d", 1, "running", at(500), "s1")],  # a is silent too
        [("a", 3, "running", at(480), "back")],
    ]
    log, _ = stream(spark, tmp_path, parts, schema, lambda s: keyed.progress(s, "60 minutes", "50 minutes"))
    assert {(r.task_id, r.seq, r.shown) for r in log.collect()} == {("a", 1, "running"), ("b", 1, "running"), ("c", 1, "running"), ("a", 2, "running"), ("b", 2, "done"), ("c", 1, "interrupted"), ("d", 1, "running"), ("a", 2, "interrupted"), ("a", 3, "running")}
    assert log.count() == 9  # grows with the updates
    assert {(r.task_id, r.shown, r.stage) for r in keyed.newest_progress(log).collect()} == {("a", "running", "back"), ("b", "done", "s2"), ("c", "interrupted", None), ("d", "running", "s1")}
    with pytest.raises(ValueError):
        keyed.progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", "2 hours")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_submissions_are_labelled_alike_in_any_order_of_files(spark, tmp_path, order):
    schema = "request_id bigint, seq bigint, owner string, payload string, ts timestamp"
    rows = [(i % 7, i, "ox"[i % 5 == 0], (None, "p", "q")[i % 3], at(i)) for i in range(60)] + [(None, 99, "o", "p", at(3))]
    parts = [rows[k * 15 : k * 15 + 15] for k in range(4)]
    got, _ = stream(spark, tmp_path, [parts[k] for k in order] + [[(-1, 0, "", "", at(5000))]], schema, lambda s: keyed.submissions(s, "2 hours"))
    want = ledger.submissions(spark.createDataFrame(rows[:60], schema)).select("request_id", "seq", "verdict")
    assert sorted(map(tuple, got.where(F.col("request_id") >= 0).collect())) == sorted(map(tuple, want.collect()))


class Counted:
    """A handle and its states, which count calls and hold nothing."""

    def __init__(self):
        self.calls = 0

    def __getattr__(self, name):
        def call(*args):
            if not name.endswith("State"):
                self.calls += 1
            return self if name.endswith("State") else None

        return call


@pytest.mark.parametrize(("job", "row"), [(keyed._Answers(1, 1), (1, 5, 0, *[None] * 9, T0)), (keyed._Admission(), (1, 5, 0, "o", "d", T0))])
def test_calls_of_state_do_not_grow_with_a_batch(job, row):
    made = []
    for n in (1, 500):
        handle = Counted()
        job.init(handle)
        assert not list(job.handleInputRows((1,), iter([(*row[:2], i, *row[3:]) for i in range(n)]), Counted()))
        made.append(handle.calls)
    assert made[0] == made[1] <= 5
