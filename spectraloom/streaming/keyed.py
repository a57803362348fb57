"""Streams on keyed state and timers: a batch adds a key's rows to its state in one call, and time alone lets things happen.

Time is event time: a timer goes off when the stream's watermark passes it, so a run with ``availableNow`` ends, and
a replay gives the same rows. Rows that come more than `delay` after later ones are dropped, as with any watermark.
A stream that falls silent needs a row from elsewhere (a clock's, with a key that nothing reads) for its time to go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spectraloom.operators.tables import latest
from spectraloom.streaming.jobs import DONE, HELD

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a fragment says, next to its number.
NAMES = [c.split()[0] for c in HELD.split(", ")][1:]


def prepared(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(ts: str) -> Column:
    """Event time in whole milliseconds, rounded up, as timers count it; what has no time comes before all."""
    return F.coalesce(F.ceil(F.unix_micros(ts) / 1000), F.lit(-(1 << 43))).cast("bigint").alias("__at")


class _Timed(StatefulProcessor):
    """One timer a key, which moves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def moved(self, old: int | None, new: int) -> None:
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def close(self) -> None:
        pass


class _Answers(_Timed):
    def __init__(self, silence: int, remember: int):
        self.silence, self.remember = silence, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getListState("parts", HELD)
        self.until = handle.getValueState("until", "at bigint, closed boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        at, closed = self.until.get() or (None, False)
        if not closed and at is not None and at <= timerValues.getCurrentWatermarkInMs():  # its time is over, though the timer goes off after these rows
            self.handle.deleteTimer(at)
            return self.closed(key, at)
        if not closed:
            newest, new = at, {}
            for _, time, seq, *rest, _ in rows:
                new.setdefault(seq, (seq, *rest))
                newest = max(newest or 0, time + self.silence)
            if newest is not None:
                self.parts.appendList(list(new.values()))  # all in one go
                self.moved(at, newest)
                self.until.update((newest, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        at, closed = self.until.get()
        if closed:  # its late fragments can't come any more
            self.until.clear()
            return iter(())
        return self.closed(key, at)

    def closed(self, key, at: int) -> Iterator[Row]:
        held = {}
        for seq, *part in self.parts.get():
            held.setdefault(seq, dict(zip(NAMES, part, strict=True)))  # a repeat of another batch counts once
        self.parts.clear()
        self.handle.registerTimer(at + self.remember)
        self.until.update((at + self.remember, True))
        return iter([_answer(key[0], [r for _, r in sorted(held.items())])])


def _answer(request: int, held: list[dict]) -> Row:
    known = lambda c, rows=held: [r[c] for r in rows if r[c] is not None]
    last = lambda c: (known(c) or [None])[-1]
    calls = []
    for index in sorted(set(known("tool_index"))):
        own = [r for r in held if r["tool_index"] == index]
        calls.append(Row(tool_index=index, id=(known("tool_id", own) or [None])[0], name="".join(known("fn_name", own)), arguments="".join(known("fn_args", own))))
    done = last("finish_reason") is not None
    made = {"request_id": request, "status": "complete" if done else "incomplete", "content": "".join(known("content")) if done else None, "reasoning": "".join(known("reasoning")) if done else None, "calls": calls if done and calls else None}
    made |= {"finish_reason": last("finish_reason"), "prompt_tokens": last("prompt_tokens"), "completion_tokens": last("completion_tokens"), "n_chunks": len(held)}
    return Row(**made)


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).value // 1_000_000)


def answers(chunks: DataFrame, silence: str = "10 minutes", delay: str = "1 minute", remember: str = "1 day") -> DataFrame:
    """One row (DONE) of each request of a chunk stream (CHUNK and its event time `ts`), when `silence` has passed since its last fragment: complete with a finish marker, else incomplete and without content.

    State is a list of fragments to which a batch adds its own in one call, without reading the others; a repeated fragment (same seq) counts once. A closed request is
    remembered for `remember`, and fragments that come in that time change nothing. Order and files of the input don't matter within `delay`.
    """
    prepared(chunks.sparkSession)
    timed = chunks.where("request_id is not null and seq is not null").withWatermark("ts", delay).select("request_id", _millis("ts"), "seq", *NAMES, "ts")
    return timed.groupBy("request_id").transformWithState(_Answers(_ms(silence), _ms(remember)), DONE, "append", "EventTime")


class _Progress(_Timed):
    def __init__(self, names: list[str], kinds: str, stale: int, delay: int):
        self.names, self.kinds, self.wait = names, kinds, stale - delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", f"{self.kinds}, timer bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        old = self.last.get()
        _, time, *new = max(rows, key=lambda r: r[2])
        if old is not None and old[0] >= new[0]:
            return iter(())
        timer, out = old[-1] if old is not None else None, []
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():  # overdue, though the timer goes off after these rows
            out.append(self.row(key, old[:-1], "interrupted"))
        if new[self.names.index("status")] == "running":
            at = time + self.wait + 1
            self.moved(timer, at)
        else:
            at = None
            if timer is not None:
                self.handle.deleteTimer(timer)
        self.last.update((*new, at))
        return iter([*out, self.row(key, new, new[self.names.index("status")])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        *held, _ = self.last.get()
        self.last.update((*held, None))
        return iter([self.row(key, held, "interrupted")])

    def row(self, key, held, shown: str) -> Row:
        return Row(**dict(zip(["task_id", *self.names, "shown"], [key[0], *held, shown], strict=True)))


def progress(updates: DataFrame, stale: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """A change log of each task's last update (task_id, seq, status, ts and any others): a row for each that comes, shown with its status, and one shown as interrupted when a running task has had none for `stale` of event time.

    An update with a smaller seq than the last changes nothing. What is written grows with the updates; `newest_progress` reads
    the state from the log. `delay` must not be longer than `stale`, against which it is reckoned.
    """
    prepared(updates.sparkSession)
    if _ms(delay) > _ms(stale):
        raise ValueError("delay must not be longer than stale")
    first = ["seq", "status", "ts"]
    names = first + [c for c in updates.columns if c not in ("task_id", *first)]
    kinds = dict(updates.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    timed = updates.where("task_id is not null and seq is not null").withWatermark("ts", delay).select("task_id", _millis("ts"), *names)
    out = f"task_id {kinds['task_id']}, {schema}, shown string"
    return timed.groupBy("task_id").transformWithState(_Progress(names, schema, _ms(stale), _ms(delay)), out, "append", "EventTime")


def newest_progress(log: DataFrame) -> DataFrame:
    """The last row of each task that `progress` has written."""
    return latest(log.withColumn("__late", F.col("shown") == "interrupted"), ["task_id"], ["seq", "__late"]).drop("__late")


class _Admission(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, owner string, digest string")
        self.first = handle.getValueState("first", "owner string, digest string, at bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        old = (self.timer.get() or (None,))[0]
        new = [tuple(r[1:-1]) for r in rows]  # without the key and `ts`, by which late rows are dropped
        self.waiting.appendList(new)  # all in one go
        soonest = min([r[0] for r in new] + ([] if old is None else [old]))
        self.moved(old, soonest)
        self.timer.update((soonest,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted({(at, seq): (owner, digest) for at, seq, owner, digest in self.waiting.get()}.items())
        due, later = [e for e in every if e[0][0] <= now], [e for e in every if e[0][0] > now]
        first, out = self.first.get(), []
        for (at, seq), said in due:
            if first is None:
                first, verdict = (*said, at), "accepted"
                self.first.update(first)
            else:
                verdict = "duplicate" if tuple(first[:2]) == said else "conflict"
            out.append(Row(request_id=key[0], seq=seq, verdict=verdict))
        if later:
            self.waiting.put([(*k, *v) for k, v in later])
            self.handle.registerTimer(later[0][0][0])
            self.timer.update((later[0][0][0],))
        else:
            self.waiting.clear()
            self.timer.clear()
        return iter(out)


def submissions(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(request_id, seq, verdict) of a request stream (request_id, seq, owner, payload, ts): of each id the first by event time, then seq, is accepted; later ones are duplicates if owner and payload agree with it, else conflicts.

    A request is told its verdict when the watermark passes it, so that the order of files within `delay` doesn't matter.
    Only the first one's owner and payload hash are kept of an id, as long as the stream lives: ids are admitted once for good.
    """
    prepared(requests.sparkSession)
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    timed = requests.where("request_id is not null and seq is not null").withWatermark("ts", delay).select("request_id", _millis("ts"), "seq", "owner", digest.alias("digest"), "ts")
    return timed.groupBy("request_id").transformWithState(_Admission(), "request_id bigint, seq bigint, verdict string", "append", "EventTime")
