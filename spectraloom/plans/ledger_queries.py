"""Queries over ledgers, conversations, journals, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import ledger, tables
from spectraloom.plans.registry import pick, pick_sql, query
from spectraloom.plans.scalar_queries import SECRETS
from spectraloom.session import checkpointed, numbered, scratch, table
from spectraloom.sources import files
from spectraloom.streaming import jobs, keyed


@query("SELECT event_type AS model, CASE WHEN event_id % 3 = 0 THEN 'cache_hit' ELSE 'succeeded' END AS status, count(*) AS requests, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens FROM events GROUP BY ALL")
def a02_ledger_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 == 0, "cache_hit").otherwise("succeeded").alias("status"), (F.col("event_id") % 100).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return ledger.usage(rows)


TURNS_SQL = """(SELECT conv_id AS conversation_id, turn AS seq, conv_id || '-' || turn AS turn_id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role,
  CASE WHEN conv_id % 7 = 0 THEN 'failed' WHEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'running' ELSE 'completed' END AS status, CASE WHEN conv_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS runtime_id FROM conversations)"""


def turns(spark, sf_dir):
    from pyspark.sql import Window

    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("answer", answer)
    return rows.select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.col("text").alias("question"), "answer", "role",
        F.when(F.col("conv_id") % 7 == 0, "failed").when(F.col("answer").isNull(), "running").otherwise("completed").alias("status"), F.when(F.col("conv_id") % 2 == 0, "r1").otherwise("r2").alias("runtime_id"),
    )


CONTEXT_SQL = f"""(SELECT *, n_all - count(*) OVER (PARTITION BY conversation_id) AS omitted FROM (SELECT *, row_number() OVER w AS n, sum(length(question) + length(answer)) OVER (PARTITION BY conversation_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS chars, count(*) OVER (PARTITION BY conversation_id) AS n_all
  FROM (SELECT * FROM {TURNS_SQL} WHERE status = 'completed') WINDOW w AS (PARTITION BY conversation_id ORDER BY seq DESC)) WHERE n <= 3 AND chars <= 3000)"""


@query(f"SELECT conversation_id, seq, omitted FROM {CONTEXT_SQL}")
def w06_context_window(spark, sf_dir):
    """Limits are scaled down so that both bind on short conversations."""
    return ledger.context(turns(spark, sf_dir), 3, 3000).select("conversation_id", "seq", "omitted")


@query(f"SELECT conversation_id, seq, 'user' AS role, question AS content FROM {CONTEXT_SQL} UNION ALL SELECT conversation_id, seq, 'assistant', answer FROM {CONTEXT_SQL}")
def w06_context_messages(spark, sf_dir):
    return ledger.messages(ledger.context(turns(spark, sf_dir), 3, 3000))


CONVS_SQL = "(SELECT DISTINCT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'Named ' || conv_id ELSE 'New' END AS title, conv_id % 5 = 0 AS archived FROM conversations)"


def convs(spark, sf_dir):
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(c.alias("conversation_id"), F.when(c % 3 == 0, F.concat(F.lit("Named "), c)).otherwise("New").alias("title"), (c % 5 == 0).alias("archived")).distinct()


@query(rf"""
SELECT c.conversation_id, c.archived, CASE WHEN title = 'New' AND q IS NOT NULL THEN substr(regexp_replace(q, '^\s+|\s+$', '', 'g'), 1, 60) ELSE title END AS title FROM {CONVS_SQL} c LEFT JOIN (SELECT conversation_id, arg_min(question, seq) AS q FROM {TURNS_SQL} GROUP BY ALL) USING (conversation_id)""")
def f25_conversation_titles(spark, sf_dir):
    return ledger.titles(convs(spark, sf_dir), turns(spark, sf_dir), "New")


@query(f"SELECT c.*, coalesce(n, 0) AS turns, coalesce(r, 0) AS running FROM {CONVS_SQL} c LEFT JOIN (SELECT conversation_id, count(*) AS n, count(*) FILTER (status = 'running') AS r FROM {TURNS_SQL} GROUP BY ALL) USING (conversation_id) WHERE NOT archived")
def a18_conversation_listing(spark, sf_dir):
    return ledger.listing(convs(spark, sf_dir), turns(spark, sf_dir), False)


@query("SELECT conv_id AS conversation_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def s08_exported_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", "text")
    read = F.from_json("json", "array<struct<role:string, text:string>>")
    return ledger.exported(rows).select("conversation_id", "markdown", F.aggregate(read, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"])).alias("chars"))


@query(rf"""
SELECT event_id, CASE WHEN trim(t) = '' OR length(trim(t)) > 22 THEN 'length' WHEN regexp_matches(trim(t), '(?i)(api[_-]?key|access[_-]?token|insttoken|authorization)(\s*[=:]\s*)[^\s&,;]+|Bearer\s+[A-Za-z0-9._-]+') THEN 'credential' END AS refusal
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '  ' ELSE replace({pick_sql(SECRETS, "event_id")}, '{{}}', CAST(event_id AS VARCHAR)) END AS t FROM events)""")
def p09_text_admission(spark, sf_dir):
    text = F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.replace(pick(SECRETS, F.col("event_id")), F.lit("{}"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("t")).select("event_id", ledger.admission("t", 22).alias("refusal"))


UPDATES_SQL = "(SELECT user_id AS task_id, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN event_type END AS stage, CASE WHEN event_id % 4 = 0 THEN event_id // 400 END AS page FROM events)"


def updates(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), e.alias("seq"), F.when(e % 3 != 0, F.col("event_type")).alias("stage"), F.when(e % 4 == 0, F.floor(e / 400)).alias("page"))


@query(f"""
WITH c AS (SELECT *, last_value(stage IGNORE NULLS) OVER w AS s, last_value(page IGNORE NULLS) OVER w AS p FROM {UPDATES_SQL} WINDOW w AS (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, lag(s) OVER (PARTITION BY task_id ORDER BY seq) AS ws, lag(p) OVER (PARTITION BY task_id ORDER BY seq) AS wp FROM c)
SELECT task_id, seq, s AS stage, p AS page FROM b WHERE (stage IS NOT NULL AND stage IS DISTINCT FROM ws) OR (page IS NOT NULL AND page IS DISTINCT FROM wp) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) <= 40""")
def w07_timeline(spark, sf_dir):
    """The last forty updates a task are the feature."""
    return ledger.timeline(updates(spark, sf_dir), ["stage", "page"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def t02_recent_listing(spark, sf_dir):
    """A listing of at most fifty rows is the feature."""
    return files.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 0, 50)[0]


@query("SELECT o_orderkey, o_orderdate, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def s09_stable_page(spark, sf_dir):
    """A page is the feature."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    page, total = files.page(rows, [F.col("o_orderdate"), F.col("o_orderkey")], 50, 25)
    return page.withColumn("total", F.lit(total).cast("bigint"))


@query("SELECT o_orderkey, o_orderstatus = 'O' AS running, row_number() OVER (ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey) - 1 AS place FROM orders")
def t03_running_first(spark, sf_dir):
    """Every order's place in the listing; no task ranks the whole table."""
    running = F.col("o_orderstatus") == "O"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", running.alias("running"))
    return numbered(rows, [F.desc("running"), F.desc("o_orderdate"), F.asc("o_orderkey")], "place").select("o_orderkey", "running", "place")


@query("""
SELECT conv_id, list(w ORDER BY first) AS words FROM (
  SELECT conv_id, w, min((turn, i)) AS first FROM (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM conversations) GROUP BY ALL) GROUP BY conv_id""")
def u04_distinct_words(spark, sf_dir):
    """All turns' words, once each, in the order of their first use; words are told apart before they are gathered."""
    placed = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "w"))
    return tables.distinct_in_order(placed, ["conv_id"], "w", ["turn", "i"], "words")


RULES_SQL = """
SELECT * FROM (SELECT 'error' AS severity, 'duplicate keys' AS code, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS hits
UNION ALL SELECT 'warning', 'empty texts', (SELECT count(*) FROM documents WHERE length(text) < 50) UNION ALL SELECT 'error', 'bad totals', (SELECT count(*) FROM orders WHERE o_totalprice < 0)) WHERE hits > 0"""


def issues(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    repeated = t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return ledger.health([("error", "duplicate keys", repeated), ("warning", "empty texts", t("documents").where("length(text) < 50")), ("error", "bad totals", t("orders").where("o_totalprice < 0"))])


@query(RULES_SQL)
def u05_health_issues(spark, sf_dir):
    return issues(spark, sf_dir)


@query(f"SELECT coalesce(bool_and(severity <> 'error'), true) AS ready FROM ({RULES_SQL})")
def u05_ready_flag(spark, sf_dir):
    return ledger.ready(issues(spark, sf_dir))


JOURNAL_SQL = "(SELECT turn_id, CASE WHEN seq % 2 = 0 THEN 'completed' ELSE 'unknown' END AS status FROM {t} WHERE conversation_id % 3 = 0)"


@query(f"SELECT t.turn_id, CASE WHEN t.status = 'running' AND runtime_id <> 'r1' THEN CASE WHEN j.status = 'completed' THEN 'completed' ELSE 'interrupted' END ELSE t.status END AS status FROM {TURNS_SQL} t LEFT JOIN {JOURNAL_SQL.format(t=TURNS_SQL)} j USING (turn_id)")
def i06_orphans_recovered(spark, sf_dir):
    rows = turns(spark, sf_dir)
    journal = rows.where("conversation_id % 3 = 0").select("turn_id", F.when(F.col("seq") % 2 == 0, "completed").otherwise("unknown").alias("status"))
    return ledger.recovered(rows, "r1", journal).select("turn_id", "status")


TASKS_SQL = "(SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at, o_orderdate + (o_orderkey % 50 - 5) * INTERVAL 1 HOUR AS finished_at, o_orderdate + (o_orderkey % 9) * INTERVAL 1 DAY AS updated_at FROM orders)"


def tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda days: F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + days)
    return table(spark, sf_dir, "orders").select(k.alias("task_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), at((k % 50 - 5) * 3_600_000_000).alias("finished_at"), at(k % 9 * 86_400_000_000).alias("updated_at"))


@query(f"""
SELECT task_id, s AS status, greatest(0.0, epoch_us(CASE WHEN s = 'running' THEN TIMESTAMP '2005-01-01' ELSE finished_at END) / 1e6 - epoch_us(created_at) / 1e6) AS elapsed_seconds, CASE WHEN s = 'running' THEN greatest(0.0, epoch_us(TIMESTAMP '2005-01-01') / 1e6 - epoch_us(updated_at) / 1e6) ELSE 0.0 END AS update_age_seconds
FROM (SELECT *, CASE WHEN status = 'running' AND task_id % 4 <> 0 THEN 'interrupted' ELSE status END AS s FROM {TASKS_SQL})""")
def i07_stale_runs(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    now = F.lit("2005-01-01 00:00:00").cast("timestamp")
    return ledger.monitored(rows, rows.where("task_id % 4 = 0").select("task_id"), now).select("task_id", "status", "elapsed_seconds", "update_age_seconds")


@query(f"""
SELECT coalesce(s.task_id, l.task_id) AS task_id, coalesce(l.status, s.status) AS status, coalesce(l.progress, s.progress) AS progress FROM (SELECT task_id, status, task_id % 10 AS progress FROM {TASKS_SQL} WHERE task_id % 3 <> 0) s
FULL JOIN (SELECT task_id, 'live' AS status, task_id % 7 AS progress FROM {TASKS_SQL} WHERE task_id % 5 = 0) l ON l.task_id = s.task_id""")
def j12_live_overlay(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    stored = rows.where("task_id % 3 <> 0").select("task_id", "status", (F.col("task_id") % 10).alias("progress"))
    return ledger.overlaid(stored, rows.where("task_id % 5 = 0").select("task_id", F.lit("live").alias("status"), (F.col("task_id") % 7).alias("progress")))


REQUESTS_SQL = "(SELECT event_id % 4000 AS request_id, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE 'o' END AS owner, CASE WHEN event_id % 13 = 0 THEN 'p' ELSE 'q' END AS payload, event_id AS seq, ts FROM events)"


def requests(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select((e % 4000).alias("request_id"), F.when(e % 11 == 0, "x").otherwise("o").alias("owner"), F.when(e % 13 == 0, "p").otherwise("q").alias("payload"), e.alias("seq"))


@query(f"""
SELECT request_id, seq, CASE WHEN seq = f.seq0 THEN 'accepted' WHEN owner = f.o AND payload = f.p THEN 'duplicate' ELSE 'conflict' END AS verdict FROM {REQUESTS_SQL}
JOIN (SELECT request_id, min(seq) AS seq0, arg_min(owner, seq) AS o, arg_min(payload, seq) AS p FROM {REQUESTS_SQL} GROUP BY ALL) f USING (request_id)""")
def i09_submissions(spark, sf_dir):
    return ledger.submissions(requests(spark, sf_dir)).select("request_id", "seq", "verdict")


CHUNKS_SQL = "(SELECT event_id % 1500 AS request_id, event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN event_type || ' ' END AS content, CASE WHEN event_id % 5 = 0 THEN 'r' || event_id END AS reasoning, CASE WHEN event_id % 6 = 0 THEN CAST(event_id // 1500 % 2 AS INT) END AS tool_index, CASE WHEN event_id % 6 = 0 THEN 'a' || event_id END AS fn_args, CASE WHEN event_id % 7 = 0 THEN 'stop' END AS finish_reason, CASE WHEN event_id % 4 = 0 THEN user_id END AS prompt_tokens FROM events)"  # noqa: E501


def chunks(spark, sf_dir):
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        (e % 1500).alias("request_id"), e.alias("seq"), F.when(e % 5 != 0, F.concat("event_type", F.lit(" "))).alias("content"), F.when(e % 5 == 0, F.concat(F.lit("r"), e)).alias("reasoning"), F.when(e % 6 == 0, F.floor(e / 1500) % 2).cast("int").alias("tool_index"), none.alias("tool_id"), none.alias("fn_name"),
        F.when(e % 6 == 0, F.concat(F.lit("a"), e)).alias("fn_args"), F.when(e % 7 == 0, "stop").alias("finish_reason"), F.when(e % 4 == 0, F.col("user_id")).alias("prompt_tokens"), F.lit(None).cast("bigint").alias("completion_tokens"),
    )


@query(f"""
WITH c AS ({CHUNKS_SQL[1:-1]}), t AS (SELECT request_id, string_agg(tool_index || '=' || a, ';' ORDER BY tool_index) AS calls FROM (SELECT request_id, tool_index, string_agg(fn_args, '' ORDER BY seq) AS a FROM c WHERE tool_index IS NOT NULL GROUP BY ALL) GROUP BY ALL),
g AS (SELECT request_id, coalesce(string_agg(content, '' ORDER BY seq), '') AS content, coalesce(string_agg(reasoning, '' ORDER BY seq), '') AS reasoning, count(finish_reason) > 0 AS done, arg_max(prompt_tokens, seq) FILTER (prompt_tokens IS NOT NULL) AS prompt_tokens FROM c GROUP BY ALL)
SELECT request_id, CASE WHEN done THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN done THEN content END AS content, CASE WHEN done THEN reasoning END AS reasoning, CASE WHEN done THEN calls END AS calls, prompt_tokens FROM g LEFT JOIN t USING (request_id)""")
def r01_assembled_answers(spark, sf_dir):
    made = ledger.assembled(chunks(spark, sf_dir))
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws("=", c["tool_index"].cast("string"), c["arguments"])), ";")
    return made.select("request_id", "status", "content", "reasoning", calls.alias("calls"), "prompt_tokens")


def _stream_folder(spark, df, kind: str) -> str:
    """The rows as files of the shared folder, for a file stream to read."""
    at = scratch(spark, kind)
    df.write.parquet(f"{at}/in")
    return at


@query(f"""
WITH c AS ({CHUNKS_SQL[1:-1]}), t AS (SELECT request_id, string_agg(tool_index || '=' || a, ';' ORDER BY tool_index) AS calls FROM (SELECT request_id, tool_index, string_agg(fn_args, '' ORDER BY seq) AS a FROM c WHERE tool_index IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT request_id, 'complete' AS status, coalesce(string_agg(content, '' ORDER BY seq), '') AS content, coalesce(string_agg(reasoning, '' ORDER BY seq), '') AS reasoning, any_value(calls) AS calls, arg_max(prompt_tokens, seq) FILTER (prompt_tokens IS NOT NULL) AS prompt_tokens, count(*) AS n_chunks
FROM c LEFT JOIN t USING (request_id) GROUP BY request_id HAVING count(finish_reason) > 0""")
def r01_assembled_by_stream(spark, sf_dir):
    """The stream's complete answers; the incomplete ones only time out when time passes."""
    at = scratch(spark, "chunks")
    rows = chunks(spark, sf_dir)
    # in parts, a batch each, so that requests span batches; availableNow doesn't end where processing time may time out
    for part in range(3):
        rows.where(F.floor(F.col("seq") / 1500) % 3 == part).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        # no request may time out between two batches
        run = jobs.assemble_stream(stream, timeout_ms=86_400_000).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).outputMode("append").start()
        run.awaitTermination()
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws("=", c["tool_index"].cast("string"), c["arguments"])), ";")
    return jobs.newest_answers(spark.read.schema(jobs.DONE).parquet(f"{at}/out")).where("status = 'complete'").select("request_id", "status", "content", "reasoning", calls.alias("calls"), "prompt_tokens", "n_chunks")


@query(f"""
SELECT task_id, seq, stage, CASE WHEN status = 'running' AND ts < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'interrupted' ELSE status END AS shown
FROM (SELECT u.*, e.ts, CASE e.event_type WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM {UPDATES_SQL} u JOIN events e ON e.event_id = u.seq QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1)""")
def r02_latest_progress_by_stream(spark, sf_dir):
    rows = updates(spark, sf_dir).select("task_id", "seq", "stage")
    facts = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    at = _stream_folder(spark, rows.join(facts, "seq").select("task_id", "seq", "stage", "ts", "status"), "progress")
    stream = spark.readStream.schema("task_id bigint, seq bigint, stage string, ts timestamp, status string").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    run = jobs.latest_progress(stream, f"{at}/out", f"{at}/state", stale="6 HOURS").start()
    run.awaitTermination()
    newest = spark.read.parquet(f"{at}/out").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{at}/out/batch={newest}").select("task_id", "seq", "stage", "shown")


@query(f"SELECT DISTINCT request_id FROM {REQUESTS_SQL}")
def r03_requests_admitted_once_by_stream(spark, sf_dir):
    """Which of a request's repeats comes first depends on the files' order, so only ids are returned."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4000).alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    at = _stream_folder(spark, rows, "requests")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    run = jobs.admitted(stream, "400 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select("request_id")


def _sliced(spark, df, by: str, kind: str, clock=None, slices: int = 4) -> str:
    """The rows as files, written slice by slice in ascending `by` and read two files a batch; a clock's row last."""
    at = scratch(spark, kind)
    df.write.parquet(f"{at}/rows")  # made once, though they are read for each slice
    df = spark.read.schema(df.schema).parquet(f"{at}/rows")
    low, high = df.agg(F.min(by), F.max(by)).first()
    step = (high - low) / slices if low is not None else 0
    for i in range(slices):
        own = (F.col(by) >= F.lit(low + i * step)) & ((F.col(by) < F.lit(low + (i + 1) * step)) if i < slices - 1 else F.lit(True)) if low is not None else F.lit(True)
        df.where(own).repartition(2).write.mode("append").parquet(f"{at}/in")
    if clock is not None:
        clock.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return at


def _through(spark, schema, at: str, job):
    """What the stream `job` of the files makes, in batches of two files, until all are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    made = job(stream)
    made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


@query(f"""
WITH c AS ({CHUNKS_SQL[1:-1]}), t AS (SELECT request_id, string_agg(tool_index || '=' || a, ';' ORDER BY tool_index) AS calls FROM (SELECT request_id, tool_index, string_agg(fn_args, '' ORDER BY seq) AS a FROM c WHERE tool_index IS NOT NULL GROUP BY ALL) GROUP BY ALL),
g AS (SELECT request_id, coalesce(string_agg(content, '' ORDER BY seq), '') AS content, coalesce(string_agg(reasoning, '' ORDER BY seq), '') AS reasoning, count(finish_reason) > 0 AS done, arg_max(prompt_tokens, seq) FILTER (prompt_tokens IS NOT NULL) AS prompt_tokens, count(*) AS n_chunks FROM c GROUP BY ALL)
SELECT request_id, CASE WHEN done THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN done THEN content END AS content, CASE WHEN done THEN reasoning END AS reasoning, CASE WHEN done THEN calls END AS calls, prompt_tokens, n_chunks FROM g LEFT JOIN t USING (request_id)""")
def r01_answers_once_by_stream(spark, sf_dir):
    """All answers, the incomplete ones too: a request is closed when its event time has been silent. A fragment's time is its number in seconds."""
    rows = chunks(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") + 86_400))
    n = rows.agg(F.max("seq")).first()[0]
    clock = spark.range(1).select(*[(F.lit(-1) if c in ("request_id", "seq") else F.timestamp_seconds(F.lit(2 * n + 100_000)) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    at = _sliced(spark, rows, "seq", "answers", clock)
    made = _through(spark, rows.schema, at, lambda stream: keyed.answers(stream, "3000 seconds", f"{n // 4 + 1} seconds", "1 hour"))
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws("=", c["tool_index"].cast("string"), c["arguments"])), ";")
    return made.where("request_id >= 0").select("request_id", "status", "content", "reasoning", calls.alias("calls"), "prompt_tokens", "n_chunks")


@query(f"""
SELECT task_id, seq, stage, CASE WHEN status = 'running' AND ts < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'interrupted' ELSE status END AS shown
FROM (SELECT u.*, e.ts, CASE e.event_type WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM {UPDATES_SQL} u JOIN events e ON e.event_id = u.seq QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1)""")
def r02_interrupted_by_timer(spark, sf_dir):
    """Each task's last update, with a timer that interrupts it; read from the change log."""
    facts = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    rows = updates(spark, sf_dir).select("task_id", "seq", "stage").join(facts, "seq").select("task_id", "seq", "stage", "ts", "status")
    at = _sliced(spark, rows, "ts", "progress")
    log = _through(spark, rows.schema, at, lambda stream: keyed.progress(stream, "6 hours", "6 hours"))
    return keyed.newest_progress(log).select("task_id", "seq", "stage", "shown")


@query(f"""
SELECT request_id, seq, CASE WHEN seq = f.seq0 THEN 'accepted' WHEN owner = f.o AND payload = f.p THEN 'duplicate' ELSE 'conflict' END AS verdict FROM {REQUESTS_SQL}
JOIN (SELECT request_id, (min(struct_pack(ts := ts, seq := seq, o := owner, p := payload))).seq AS seq0, (min(struct_pack(ts := ts, seq := seq, o := owner, p := payload))).o AS o, (min(struct_pack(ts := ts, seq := seq, o := owner, p := payload))).p AS p FROM {REQUESTS_SQL} GROUP BY ALL) f USING (request_id)""")
def r03_labelled_by_stream(spark, sf_dir):
    """Every request with its verdict, whatever the order of files; the first by event time is accepted."""
    rows = requests(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts")), "seq").select("request_id", "seq", "owner", "payload", "ts")
    clock = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("owner"), F.lit("").alias("payload"), F.expr("ts + INTERVAL 800 DAYS").alias("ts"))
    at = _sliced(spark, rows, "seq", "admission", clock)
    return _through(spark, rows.schema, at, lambda stream: keyed.submissions(stream, "400 days")).where("request_id >= 0")


@query("SELECT CAST(user_id AS VARCHAR) AS spectrum_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def s02_s06_spectra_through_files(spark, sf_dir):
    """Events of each user written as a delimited table by user, read back as lines, and summed."""
    at = scratch(spark, "spectra")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.col("value").alias("y"))
    files.write_apart(rows, at, "csv", ["user_id"])
    lines = files.spectra_files(spark, at).withColumn("path", F.regexp_extract("path", r"user_id=([0-9]+)", 1))
    return files.spectrum_points(lines).groupBy("spectrum_id").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS stem, CAST(length(s_name) + 1 AS BIGINT) AS bytes, sha256(s_name || chr(10)) AS sha256, CASE WHEN s_suppkey % 2 = 0 THEN 'NF' ELSE 'RO' END AS dataset, CASE WHEN s_suppkey % 3 = 0 THEN 'N' ELSE 'O' END AS element, CAST(NULL AS VARCHAR) AS error FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, NULL, 'missing' FROM supplier WHERE s_suppkey % 10 = 7""")
def s03_file_inventory(spark, sf_dir):
    """A file of each supplier, in a folder of its dataset and element; the files inventoried, and some that aren't there reported."""
    at = scratch(spark, "inventory")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.concat(F.when(k % 2 == 0, "NF").otherwise("RO"), F.when(k % 3 == 0, "-N").otherwise("-O")).alias("tag"), F.col("s_name").alias("value"))
    files.write_apart(rows, f"{at}/in", "text", ["tag", "s_suppkey"])
    found = checkpointed(files.inventory(spark, f"{at}/in", "*.txt"))
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 7").select(F.concat(F.lit("s_suppkey="), k, F.lit("/gone.csv")).alias("path"))
    every = files.with_missing(found, found.select("path").unionByName(gone))
    stem = F.regexp_extract("path", "s_suppkey=([^/]*)", 1)
    return every.select(stem.alias("stem"), "bytes", "sha256", "dataset", "element", "error")


@query("SELECT 'part' AS sheet, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part UNION ALL SELECT 'supplier', count(*), NULL FROM supplier")
def s07_exported_sheets(spark, sf_dir):
    at = scratch(spark, "sheets")
    files.export_sheets({("book", "part"): table(spark, sf_dir, "part"), ("book", "supplier"): table(spark, sf_dir, "supplier")}, at)
    return spark.read.parquet(at).groupBy(F.col("_source_sheet").alias("sheet")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("SELECT 't' || s_suppkey AS task_id, s_suppkey % 9 AS done FROM supplier WHERE s_suppkey % 10 NOT IN (0, 5)")
def s05_task_journals(spark, sf_dir):
    """A journal of each supplier, a JSON file each; some broken, some without a key."""
    at = scratch(spark, "journals")
    k = F.col("s_suppkey")
    text = F.when(k % 10 == 0, "{broken").when(k % 10 == 5, '{"status": "running"}').otherwise(F.concat(F.lit('{"task_id": "t'), k, F.lit('", "progress": {"done": '), k % 9, F.lit("}}")))
    files.write_apart(table(spark, sf_dir, "supplier").select(k, text.alias("value")), f"{at}/in", "text", ["s_suppkey"])
    return files.journals(spark, f"{at}/in", "*.txt").select("task_id", F.col("progress")["done"].cast("bigint").alias("done"))
