"""Structured Streaming jobs. Each equals its batch form once its input has ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spectraloom.operators.ledger import assembled
from spectraloom.operators.tables import latest

CHUNK = "request_id bigint, seq bigint, content string, reasoning string, tool_index int, tool_id string, fn_name string, fn_args string, finish_reason string, prompt_tokens bigint, completion_tokens bigint"
DONE = "request_id bigint, status string, content string, reasoning string, calls array<struct<tool_index: int, id: string, name: string, arguments: string>>, finish_reason string, prompt_tokens bigint, completion_tokens bigint, n_chunks bigint"
#: A chunk's columns but its key, as the state holds them.
HELD = CHUNK.split(", ", 1)[1]


def assemble_stream(chunks: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Rows (DONE) of a chunk stream (CHUNK): a request's answer whenever new fragments come once its finish marker is there, incomplete without content after `timeout_ms` of silence without one.

    A row with more chunks replaces the request's earlier ones (newest_answers), so the last
    is that of all fragments, in whatever order batches brought them. State is each open
    request's fragments, until `timeout_ms` of silence; later ones start anew.
    """
    names = [c.split()[0] for c in HELD.split(", ")]
    clean = lambda v: None if v is None or v != v else v

    def row(key: tuple, held: list[dict], done: bool) -> pd.DataFrame:
        held = sorted(held, key=lambda r: r["seq"])
        known = lambda c, rows=held: [r[c] for r in rows if r[c] is not None]
        last = lambda c: (known(c) or [None])[-1]
        calls = []
        for index in sorted(set(known("tool_index"))):
            own = [r for r in held if r["tool_index"] == index]
            calls.append({"tool_index": int(index), "id": (known("tool_id", own) or [None])[0], "name": "".join(known("fn_name", own)), "arguments": "".join(known("fn_args", own))})
        made = {"request_id": key[0], "status": "complete" if done else "incomplete", "content": "".join(known("content")) if done else None, "reasoning": "".join(known("reasoning")) if done else None, "calls": calls if done and calls else None}
        made |= {"finish_reason": last("finish_reason"), "prompt_tokens": last("prompt_tokens"), "completion_tokens": last("completion_tokens"), "n_chunks": len(held)}
        return pd.DataFrame({k: pd.Series([v], dtype="Int64" if k.endswith("tokens") else None if k in ("request_id", "n_chunks") else object) for k, v in made.items()})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [dict(zip(names, r, strict=True)) for r in zip(*state.get, strict=True)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            if not any(r["finish_reason"] is not None for r in held):
                yield row(key, held, False)
            return
        for pdf in batches:
            for values in zip(*[pdf[c].tolist() for c in names], strict=True):
                r = {c: clean(v) for c, v in zip(names, values, strict=True)}
                held.append({c: int(v) if v is not None and c in ("seq", "tool_index", "prompt_tokens", "completion_tokens") else v for c, v in r.items()})
        state.update(tuple([r[c] for r in held] for c in names))
        state.setTimeoutDuration(timeout_ms)
        if any(r["finish_reason"] is not None for r in held):
            yield row(key, held, True)

    kept = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in HELD.split(", "))
    return chunks.select("request_id", *names).groupBy("request_id").applyInPandasWithState(step, DONE, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def newest_answers(rows: DataFrame) -> DataFrame:
    """The last row (DONE) of each request that assemble_stream has given."""
    return latest(rows, ["request_id"], ["n_chunks"])


def assemble_batch(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("request_id").agg(F.count("*").alias("n_chunks"))
    return assembled(chunks).join(counts, "request_id").select("request_id", "status", "content", "reasoning", "calls", "finish_reason", "prompt_tokens", "completion_tokens", "n_chunks")


def latest_progress(updates: DataFrame, path: str, checkpoint: str, stale: str | None = None, status: str = "status", at: str = "ts"):
    """Keeps the last update of each task (task_id, seq, …) in `path`, one folder a batch with its merged state: start() it; the newest folder is the state.

    A batch that is run again after a failure overwrites its own folder from the one before, so it takes effect once.
    With `stale`, an interval, each state has `shown` too: a running task whose last update is older than that, against the newest of all, is shown as interrupted, until another comes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch if number == 0 else spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        last = latest(merged, ["task_id"], ["seq"])
        if stale:
            newest = merged.agg(F.max(at).alias("__newest"))  # one row
            old = (F.col(status) == "running") & (F.col(at) < F.col("__newest") - F.expr(f"INTERVAL {stale}"))
            last = last.crossJoin(newest).withColumn("shown", F.when(old, "interrupted").otherwise(F.col(status))).drop("__newest")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def admitted(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each request id once, on a stream with event time `ts`: repeats within the delay are dropped, and state older than it is let go."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])
