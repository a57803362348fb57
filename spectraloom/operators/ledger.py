"""Ledgers: requests, conversations, task journals and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import scalars

#: A context takes at most so many turns and characters.
TURNS, CHARS = 20, 80_000
#: Updates a task keeps.
EVENTS = 40


def usage(ledger: DataFrame) -> DataFrame:
    """(model, status, requests, input_tokens, output_tokens)."""
    return ledger.groupBy("model", "status").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def context(turns: DataFrame, most_turns: int = TURNS, most_chars: int = CHARS) -> DataFrame:
    """The newest completed turns of each conversation that fit both limits, whole turns only, with `omitted`, how many completed ones don't.

    Both running sums only grow from the newest turn backwards, so the filter ends where a loop would.
    """
    done = turns.where("status = 'completed'").withColumn("size", F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit(""))))
    back = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    ranked = done.withColumns({"n": F.row_number().over(back), "chars": F.sum("size").over(back.rowsBetween(Window.unboundedPreceding, 0)), "all": F.count("*").over(Window.partitionBy("conversation_id"))})
    kept = ranked.where((F.col("n") <= most_turns) & (F.col("chars") <= most_chars))
    return kept.withColumn("omitted", F.col("all") - F.count("*").over(Window.partitionBy("conversation_id"))).drop("n", "chars", "all", "size")


def messages(kept: DataFrame) -> DataFrame:
    """(conversation_id, seq, role, content): a user and an assistant message of each turn."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return kept.select("conversation_id", "seq", F.explode(pair).alias("m")).select("conversation_id", "seq", "m.role", "m.content")


def titles(conversations: DataFrame, turns: DataFrame, default: str, length: int = 60) -> DataFrame:
    """Conversations whose title is still the default take the start of their first question."""
    first = turns.groupBy("conversation_id").agg(F.min_by("question", "seq").alias("__q"))
    named = F.when((F.col("title") == default) & F.col("__q").isNotNull(), F.substring(scalars.stripped("__q"), 1, length)).otherwise(F.col("title"))
    return conversations.join(first, "conversation_id", "left").select(*[c for c in conversations.columns if c != "title"], named.alias("title"))


def listing(conversations: DataFrame, turns: DataFrame, archived: bool) -> DataFrame:
    """Conversations with their turns and running turns, by the archived flag."""
    each = turns.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.count_if(F.col("status") == "running").alias("running"))
    both = conversations.where(F.col("archived") == archived).join(each, "conversation_id", "left")
    return both.withColumns({"turns": F.coalesce("turns", F.lit(0)), "running": F.coalesce("running", F.lit(0))})


def exported(turns: DataFrame) -> DataFrame:
    """(conversation_id, json, markdown): a whole conversation in order, as JSON and as text."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    each = turns.groupBy("conversation_id").agg(ordered.alias("t"))
    line = lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), F.coalesce(t["text"], F.lit("")))
    return each.select("conversation_id", F.to_json(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("json"), F.array_join(F.transform("t", line), "\n\n").alias("markdown"))


def admission(text: str, most: int, empty: bool = False) -> Column:
    """Why a text isn't admitted: length, or a credential that redaction finds; NULL if it is."""
    plain = scalars.stripped(F.coalesce(F.col(text), F.lit("")))
    short = F.lit(empty) | (plain != "")
    return F.when(~short | (F.length(plain) > most), "length").when(~scalars.redacted(plain, most).eqNullSafe(plain), "credential")


def timeline(updates: DataFrame, fields: list[str], keep: int = EVENTS) -> DataFrame:
    """Progress updates (task_id, at, seq, fields…) where a given field changed from what was known before; the last `keep` of each task.

    An update only names what it sets, so unset fields are carried forward first.
    """
    order = Window.partitionBy("task_id").orderBy("seq")
    carried = updates.withColumns({f"now_{f}": F.last(f, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for f in fields})
    before = carried.withColumns({f"was_{f}": F.lag(f"now_{f}").over(order) for f in fields})
    changed = reduce(lambda a, b: a | b, [F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"was_{f}")) for f in fields])
    kept = before.where(changed).withColumn("__back", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("seq")))).where(F.col("__back") <= keep)
    return kept.select("task_id", "seq", *[F.col(f"now_{f}").alias(f) for f in fields])


def monitored(stored: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """Stored tasks: running ones without a live owner are interrupted; their elapsed seconds, and the age of a running one's last update."""
    live = active.select("task_id", F.lit(True).alias("__live"))
    both = stored.join(live, "task_id", "left")
    stale = (F.col("status") == "running") & F.col("__live").isNull()
    made = both.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status"))).drop("__live")
    running = F.col("status") == "running"
    micros = lambda c: F.unix_micros(c)
    end = F.when(running, now).otherwise(F.col("finished_at"))
    spent = F.coalesce(F.greatest(F.lit(0.0), (micros(end) - micros("created_at")) / 1e6), F.lit(0.0))
    age = F.when(running, F.greatest(F.lit(0.0), (micros(now) - micros("updated_at")) / 1e6)).otherwise(0.0)
    return made.withColumns({"elapsed_seconds": spent, "update_age_seconds": age})


def overlaid(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored tasks under a live snapshot (task_id, status, progress): the live status and progress win, live tasks not stored come in."""
    s = live.select("task_id", F.col("status").alias("__s"), F.col("progress").alias("__p"))
    both = stored.join(s, "task_id", "full")
    return both.select(*[c for c in stored.columns if c not in ("status", "progress")], F.coalesce("__s", "status").alias("status"), F.coalesce("__p", "progress").alias("progress"))


def recovered(turns: DataFrame, runtime: str, journal: DataFrame) -> DataFrame:
    """Running turns of another runtime are interrupted, unless the journal (turn_id, status) knows how they ended."""
    both = turns.join(journal.select("turn_id", F.col("status").alias("__j")), "turn_id", "left")
    orphan = (F.col("status") == "running") & ~F.col("runtime_id").eqNullSafe(F.lit(runtime))
    ended = F.when(F.col("__j").isin("completed", "failed", "cancelled"), F.col("__j")).otherwise("interrupted")
    return both.select(*[c for c in turns.columns if c != "status"], F.when(orphan, ended).otherwise(F.col("status")).alias("status"))


def submissions(requests: DataFrame) -> DataFrame:
    """Requests (request_id, owner, payload, seq) with a verdict: the first of an id is accepted; later ones are duplicates if owner and payload agree, else conflicts."""
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    first = requests.groupBy("request_id").agg(F.min_by(F.struct("owner", digest.alias("digest"), "seq"), "seq").alias("__f"))
    same = F.col("owner").eqNullSafe(F.col("__f.owner")) & (digest == F.col("__f.digest"))
    verdict = F.when(F.col("seq") == F.col("__f.seq"), "accepted").when(same, "duplicate").otherwise("conflict")
    return requests.join(first, "request_id").withColumn("verdict", verdict).drop("__f")


def assembled(chunks: DataFrame) -> DataFrame:
    """One row a request from stream chunks (request_id, seq, content, reasoning, tool_index, tool_id, fn_name, fn_args, finish_reason, prompt_tokens, completion_tokens).

    Deltas are joined in order, tool-call fragments by their index, the last usage counts;
    content is only published where a finish marker arrived.
    """
    joined = lambda c, filter_=None: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() if filter_ is None else filter_, F.struct("seq", F.col(c).alias("v"))))), lambda x: x["v"]), "")
    text = chunks.groupBy("request_id").agg(
        joined("content").alias("content"), joined("reasoning").alias("reasoning"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
        F.max_by("prompt_tokens", F.when(F.col("prompt_tokens").isNotNull(), F.col("seq"))).alias("prompt_tokens"), F.max_by("completion_tokens", F.when(F.col("completion_tokens").isNotNull(), F.col("seq"))).alias("completion_tokens"),
    )
    calls = chunks.where("tool_index is not null").groupBy("request_id", "tool_index").agg(F.min_by("tool_id", F.when(F.col("tool_id").isNotNull(), F.col("seq"))).alias("id"), joined("fn_name").alias("name"), joined("fn_args").alias("arguments"))
    listed = calls.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("tool_index", "id", "name", "arguments"))).alias("calls"))
    both = text.join(listed, "request_id", "left")
    complete = F.col("finish_reason").isNotNull()
    published = lambda c: F.when(complete, F.col(c)).alias(c)
    return both.select("request_id", F.when(complete, "complete").otherwise("incomplete").alias("status"), published("content"), published("reasoning"), published("calls"), "finish_reason", "prompt_tokens", "completion_tokens")


def health(rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(severity, code, hits): each rule's rows counted; rules without a hit have no row."""
    each = [df.agg(F.count("*").alias("hits")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "hits") for severity, code, df in rules]
    return reduce(lambda a, b: a.unionByName(b), each).where("hits > 0")


def ready(issues: DataFrame) -> DataFrame:
    """One row: whether no issue is an error."""
    return issues.agg(F.coalesce(F.bool_and(F.col("severity") != "error"), F.lit(True)).alias("ready"))
