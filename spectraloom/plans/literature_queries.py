"""Queries over papers, pages and evidence: documents stand for papers, their lines for pages and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.operators import literature, search, tables
from spectraloom.plans.registry import query
from spectraloom.plans.scalar_queries import TERMS, TERMS_SQL
from spectraloom.session import scratch, table
from spectraloom.sources import buckets

DOCS_SQL = """(SELECT 'd' || doc_id AS doc_key, substr(text, 1, 40) AS title, CASE WHEN doc_id % 9 <> 0 THEN 1990 + doc_id % 30 END AS year, ['parsed', 'indexed', 'downloaded', 'discovered'][doc_id % 4 + 1] AS status,
  CASE WHEN doc_id % 6 = 0 THEN 'late' END AS reason, CASE WHEN doc_id % 3 = 0 THEN '/pdf/' || doc_id END AS local_path, sha256(text) AS sha256, doc_id FROM documents)"""
QUEUE_SQL = "(SELECT 'd' || doc_id AS doc_key, ['queued', 'retry', 'done'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 5 = 0 THEN 'http' END AS reason, doc_id % 4 AS attempts, CAST(NULL AS VARCHAR) AS last_error FROM documents WHERE doc_id % 2 = 0)"
CLAIMS_SQL = """(SELECT 'd' || doc_id AS doc_key, CAST(i AS INT) AS page, l[i + 1] AS claim, 'p. ' || i AS locator, ['measurement', 'assignment', 'mechanism', 'relationship', 'limitation', 'other'][(doc_id + i) % 6 + 1] AS kind,
  CASE WHEN (doc_id + i) % 17 = 0 THEN 9.0 WHEN (doc_id + i) % 19 = 0 THEN NULL ELSE (doc_id * 7 + i * 13) % 100 / 100 END AS confidence, (doc_id * 31 + i) % 1000 AS created_at,
  substr(sha256('d' || doc_id || '|' || i), 1, 32) AS evidence_id, i % 3 AS image_count, doc_id FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(len(l))) AS t(i))"""


def docs(spark, sf_dir):
    c, s = F.col("doc_id"), F.concat(F.lit("d"), "doc_id")
    status = F.element_at(F.array(*map(F.lit, ("parsed", "indexed", "downloaded", "discovered"))), (c % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        s.alias("doc_key"), F.substring("text", 1, 40).alias("title"), F.when(c % 9 != 0, 1990 + c % 30).alias("year"), status.alias("status"), F.when(c % 6 == 0, "late").alias("reason"),
        F.when(c % 3 == 0, F.concat(F.lit("/pdf/"), c)).alias("local_path"), F.sha2("text", 256).alias("sha256"), "doc_id",
    )


def queue(spark, sf_dir):
    c = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("queued", "retry", "done"))), (c % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").where(c % 2 == 0).select(F.concat(F.lit("d"), c).alias("doc_key"), status.alias("status"), F.when(c % 5 == 0, "http").alias("reason"), (c % 4).alias("attempts"), F.lit(None).cast("string").alias("last_error"))


def claims(spark, sf_dir):
    c, i = F.col("doc_id"), F.col("page")
    kinds = F.array(*map(F.lit, ("measurement", "assignment", "mechanism", "relationship", "limitation", "other")))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "claim"))
    return lines.select(
        F.concat(F.lit("d"), c).alias("doc_key"), "page", "claim", F.concat(F.lit("p. "), i).alias("locator"), F.element_at(kinds, ((c + i) % 6 + 1).cast("int")).alias("kind"),
        F.when((c + i) % 17 == 0, 9.0).when((c + i) % 19 == 0, None).otherwise((c * 7 + i * 13) % 100 / 100).alias("confidence"), ((c * 31 + i) % 1000).alias("created_at"),
        scalars.hash_id(F.concat(F.lit("d"), c), i.cast("string")).alias("evidence_id"), (i % 3).alias("image_count"), "doc_id",
    )


SEARCH_SQL = f"SELECT e.evidence_id, e.doc_key, d.title, e.confidence FROM {CLAIMS_SQL} e JOIN {DOCS_SQL} d USING (doc_key) WHERE e.claim ILIKE '%the%of%' OR d.title ILIKE '%the%of%' ORDER BY e.confidence DESC NULLS LAST, e.evidence_id LIMIT 20"


@query(SEARCH_SQL)
def p02_j05_evidence_search(spark, sf_dir):
    """A search page: its limit is the feature."""
    return literature.searched(claims(spark, sf_dir), docs(spark, sf_dir), "the%of").select("evidence_id", "doc_key", "title", "confidence")


@query(SEARCH_SQL)
def p02_search_by_index(spark, sf_dir):
    """The same page through the trigram index, which is filled in two batches."""
    at, evidence, documents = scratch(spark, "postings"), claims(spark, sf_dir), docs(spark, sf_dir)
    texts = evidence.select(F.lit("claim").alias("kind"), F.col("evidence_id").alias("id"), F.col("claim").alias("text"), "doc_id")
    texts = texts.unionByName(documents.select(F.lit("title").alias("kind"), F.col("doc_key").alias("id"), F.col("title").alias("text"), "doc_id"))
    for batch in range(2):
        search.indexed(texts.where(F.col("doc_id") % 2 == batch), at, batch)
    return search.searched(evidence, documents, at, "the%of").select("evidence_id", "doc_key", "title", "confidence")


@query(f"SELECT doc_key, status FROM {DOCS_SQL} WHERE contains(lower(title || ' ' || coalesce(local_path, '')), 'an') AND local_path IS NOT NULL AND status IN ('parsed', 'indexed')")
def p03_library_filter(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "title", "local_path"))
    return docs(spark, sf_dir).where(text.contains("an") & F.col("local_path").isNotNull() & F.col("status").isin("parsed", "indexed")).select("doc_key", "status")


@query(f"SELECT doc_key, status, year FROM {DOCS_SQL} WHERE status IN ('indexed', 'downloaded', 'parse_failed') ORDER BY year NULLS FIRST, doc_id LIMIT 50")
def p04_work_selector(spark, sf_dir):
    """A work batch: its limit is the feature."""
    return docs(spark, sf_dir).where(F.col("status").isin("indexed", "downloaded", "parse_failed")).orderBy(F.asc_nulls_first("year"), "doc_id").limit(50).select("doc_key", "status", "year")


@query(f"""
SELECT doc_key, page, CASE WHEN kind NOT IN {literature.KINDS} THEN 'kind' WHEN length(claim) NOT BETWEEN 1 AND 4000 THEN 'claim' WHEN length(locator) NOT BETWEEN 1 AND 500 THEN 'locator' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, true) THEN 'confidence' END AS problem FROM {CLAIMS_SQL}""")
def p06_evidence_validation(spark, sf_dir):
    return claims(spark, sf_dir).select("doc_key", "page", literature.evidence_problem().alias("problem"))


@query("""
SELECT doc_id, CAST(NULL AS BOOLEAN) AS is_new FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'search_api' ELSE source END AS origin, CASE WHEN doc_id % 5 = 0 THEN '{"search_query": "xps"}' ELSE '{"a": 1}' END AS metadata FROM documents)
WHERE origin = 'search_api' OR json_extract_string(metadata, '$.search_query') IS NOT NULL""")
def p08_search_hits_of_old_runs(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "search_api").otherwise(F.col("source")).alias("origin"), F.when(F.col("doc_id") % 5 == 0, '{"search_query": "xps"}').otherwise('{"a": 1}').alias("metadata"))
    return made.where((F.col("origin") == "search_api") | F.get_json_object("metadata", "$.search_query").isNotNull()).select("doc_id", F.lit(None).cast("boolean").alias("is_new"))


def _work(c):
    location = F.struct(F.when(c % 2 == 0, F.concat(F.lit("http://pdf/"), c)).alias("pdf_url"), F.when(c % 3 == 0, F.concat(F.lit("http://page/"), c)).alias("landing_page_url"))
    return F.to_json(F.struct(F.when(c % 4 != 0, F.concat(F.lit("https://doi.org/10.1234/W."), c % 300)).alias("doi"), F.when(c % 8 != 0, F.concat(F.lit("Work "), c)).alias("title"), (1990 + c % 30).cast("int").alias("publication_year"), F.concat(F.lit("https://o.org/W"), c % 300).alias("id"), location.alias("best_oa_location")))  # noqa: E501


WORKS_SQL = """(SELECT doc_id AS seq, CASE WHEN doc_id % 4 <> 0 THEN '10.1234/w.' || (doc_id % 300) END AS doi, CASE WHEN doc_id % 8 <> 0 THEN 'Work ' || doc_id ELSE 'Untitled' END AS title, CAST(1990 + doc_id % 30 AS INT) AS year, 'W' || (doc_id % 300) AS external_id,
  CASE WHEN doc_id % 2 = 0 THEN 'http://pdf/' || doc_id END AS pdf_url, CASE WHEN doc_id % 3 = 0 THEN 'http://page/' || doc_id ELSE 'https://o.org/W' || (doc_id % 300) END AS landing_url,
  CASE WHEN doc_id % 4 <> 0 THEN 'doi:10.1234/w.' || (doc_id % 300) ELSE 'id:W' || (doc_id % 300) END AS doc_key FROM documents)"""


def hits(spark, sf_dir):
    return literature.works(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), _work(F.col("doc_id")).alias("json")))


@query(f"SELECT * FROM {WORKS_SQL}")
def s04_works_to_documents(spark, sf_dir):
    return hits(spark, sf_dir)


@query(f"""
SELECT batch, doc_key, seq, CAST(row_number() OVER (PARTITION BY batch ORDER BY seq) AS INT) AS position FROM (SELECT seq // 400 AS batch, doc_key, min(seq) AS seq FROM {WORKS_SQL} GROUP BY ALL)""")
def w02_first_hits_of_a_batch(spark, sf_dir):
    made = hits(spark, sf_dir).select(F.floor(F.col("seq") / 400).alias("batch"), "doc_key", "seq")
    return literature.batch_hits(made, ["doc_key"], "batch", "seq")


STORED_SQL = f"(SELECT doc_key, CASE WHEN min(seq) % 3 = 0 THEN '/pdf' END AS local_path FROM {WORKS_SQL} WHERE seq % 5 < 2 GROUP BY doc_key)"


def stored(spark, sf_dir):
    return hits(spark, sf_dir).where("seq % 5 < 2").groupBy("doc_key").agg(F.when(F.min("seq") % 3 == 0, "/pdf").alias("local_path"))


@query(f"SELECT h.seq, h.doc_key, s.doc_key IS NULL AS is_new, s.local_path IS NULL AS to_queue FROM {WORKS_SQL} h LEFT JOIN {STORED_SQL} s USING (doc_key)")
def j14_new_or_existing(spark, sf_dir):
    return literature.arrivals(hits(spark, sf_dir).select("seq", "doc_key"), stored(spark, sf_dir))


@query(f"""
SELECT h.seq // 400 AS batch, count(*) AS matched, count(*) FILTER (s.doc_key IS NULL) AS added, count(*) FILTER (s.doc_key IS NOT NULL) AS existing FROM {WORKS_SQL} h LEFT JOIN {STORED_SQL} s USING (doc_key) GROUP BY ALL""")
def a15_batch_receipts(spark, sf_dir):
    made = literature.arrivals(hits(spark, sf_dir).select("seq", "doc_key"), stored(spark, sf_dir))
    return made.groupBy(F.floor(F.col("seq") / 400).alias("batch")).agg(F.count("*").alias("matched"), F.count_if("is_new").alias("added"), F.count_if(~F.col("is_new")).alias("existing"))


@query(f"SELECT d.doc_key, d.status, coalesce(q.status, 'none') AS download, coalesce(q.reason, d.reason) AS why FROM {DOCS_SQL} d LEFT JOIN {QUEUE_SQL} q USING (doc_key)")
def j06_documents_with_queue(spark, sf_dir):
    return literature.queue_view(docs(spark, sf_dir), queue(spark, sf_dir)).select("doc_key", "status", "download", "why")


@query(f"""
SELECT i.batch, i.position, i.doc_key, d.title, coalesce(q.status, 'none') AS download FROM (SELECT doc_id // 100 AS batch, doc_id % 100 AS position, 'd' || ((doc_id * 7) % 1200) AS doc_key FROM documents) i
JOIN {DOCS_SQL} d USING (doc_key) LEFT JOIN {QUEUE_SQL} q USING (doc_key) WHERE i.batch = 3""")
def j07_items_of_a_batch(spark, sf_dir):
    c = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(F.floor(c / 100).alias("batch"), (c % 100).alias("position"), F.concat(F.lit("d"), c * 7 % 1200).alias("doc_key")).where("batch = 3")
    return literature.queue_view(items.join(docs(spark, sf_dir), "doc_key"), queue(spark, sf_dir)).select("batch", "position", "doc_key", "title", "download")


@query(f"""
SELECT doc_key, year, title FROM {DOCS_SQL} d JOIN (SELECT doc_key FROM {QUEUE_SQL} WHERE status IN ('queued', 'retry')) USING (doc_key) WHERE doc_key IN (SELECT 'd' || doc_id FROM labels WHERE quality = 1) ORDER BY year DESC NULLS LAST, title, doc_key LIMIT 40""")
def j08_queue_selection(spark, sf_dir):
    """A download batch: its limit is the feature."""
    keys = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("doc_key"))
    return literature.fetchable(docs(spark, sf_dir), queue(spark, sf_dir), keys, 40).select("doc_key", "year", "title")


PAGES_SQL = f"(SELECT doc_key, page, image_count, CAST({TERMS_SQL} AS BIGINT) AS score, doc_id FROM (SELECT *, lower(claim) AS t FROM {CLAIMS_SQL}))"
PLAN_SQL = f"(SELECT doc_key, page, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, image_count > 0 DESC, page) AS INT) AS rank FROM {PAGES_SQL} WHERE score >= 4 QUALIFY rank <= 4)"


def plan(spark, sf_dir):
    pages = claims(spark, sf_dir).select("doc_key", "page", "image_count", scalars.relevance("claim", TERMS).alias("score"))
    return literature.page_plan(pages)


@query(f"SELECT * FROM {PLAN_SQL}")
def w04_page_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query(f"SELECT doc_key, string_agg(page, ',' ORDER BY rank) AS pages, count(*) AS n FROM {PLAN_SQL} GROUP BY doc_key")
def a17_planned_pages(spark, sf_dir):
    return literature.plan_list(plan(spark, sf_dir))


@query(f"SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS pages, (SELECT count(*) FROM documents) - count(*) AS without_pages FROM (SELECT doc_key, count(*) AS n FROM {PLAN_SQL} GROUP BY doc_key)")
def a17_plan_totals(spark, sf_dir):
    made = literature.plan_list(plan(spark, sf_dir)).agg(F.count("*").alias("documents"), F.sum("n").alias("pages"))
    return made.crossJoin(table(spark, sf_dir, "documents").agg(F.count("*").alias("all"))).select("documents", "pages", (F.col("all") - F.col("documents")).alias("without_pages"))


RUNS_SQL = f"""(SELECT doc_key, page, CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE 'sha' END AS sha256, CASE WHEN (doc_id + page) % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, page * 3 % 7 AS evidence_count,
  'e' || page AS error, (doc_id + page) % 3 = 0 AS from_checkpoint, page AS seq FROM {CLAIMS_SQL} WHERE page % 2 = 0)"""


def runs(spark, sf_dir):
    c, p = F.col("doc_id"), F.col("page")
    return claims(spark, sf_dir).where("page % 2 = 0").select(
        "doc_key", "page", F.when(c % 10 == 0, "other").otherwise("sha").alias("sha256"), F.when((c + p) % 4 == 0, "failed").otherwise("completed").alias("status"), (p * 3 % 7).alias("evidence_count"),
        F.concat(F.lit("e"), p).alias("error"), ((c + p) % 3 == 0).alias("from_checkpoint"), p.alias("seq"),
    )


@query(f"SELECT p.doc_key, p.page FROM {PLAN_SQL} p WHERE NOT EXISTS (SELECT 1 FROM {RUNS_SQL} r WHERE r.doc_key = p.doc_key AND r.page = p.page AND r.sha256 = 'sha' AND r.status = 'completed')")
def j09_pages_to_resume(spark, sf_dir):
    planned = plan(spark, sf_dir).select("doc_key", "page", F.lit("sha").alias("sha256"))
    return literature.unfinished(planned, runs(spark, sf_dir), ["doc_key", "page", "sha256"]).select("doc_key", "page")


@query(f"""
SELECT count(DISTINCT doc_key) AS documents, count(*) AS pages, CAST(sum(evidence_count) AS BIGINT) AS evidence, count(DISTINCT doc_key) FILTER (status = 'failed') AS failed_documents, count(*) FILTER (from_checkpoint) AS checkpoint_hits, count(*) FILTER (status = 'failed') AS errors FROM {RUNS_SQL}""")
def a22_extraction_totals(spark, sf_dir):
    return literature.extraction_totals(runs(spark, sf_dir))


@query(f"""
SELECT d.doc_key, CASE WHEN bad > 0 THEN 'evidence_failed' WHEN n > 0 THEN 'evidence_extracted' WHEN d.status = 'parsed' AND p.doc_key IS NULL THEN 'evidence_no_relevant_pages' ELSE d.status END AS status
FROM {DOCS_SQL} d LEFT JOIN (SELECT doc_key, count(*) AS n, count(*) FILTER (status = 'failed') AS bad FROM {RUNS_SQL} WHERE doc_key IN (SELECT doc_key FROM {DOCS_SQL} WHERE doc_id % 3 = 1) GROUP BY doc_key) r USING (doc_key)
LEFT JOIN (SELECT DISTINCT doc_key FROM {PLAN_SQL}) p USING (doc_key)""")
def i08_status_roll_up(spark, sf_dir):
    some = runs(spark, sf_dir).join(docs(spark, sf_dir).where("doc_id % 3 = 1").select("doc_key"), "doc_key", "left_semi")
    return literature.rolled_up(docs(spark, sf_dir), some, plan(spark, sf_dir)).select("doc_key", "status")


@query(f"""
SELECT path, action FROM (SELECT path, CASE WHEN sha256 IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) THEN 'known' WHEN path = min(path) OVER (PARTITION BY sha256) THEN 'first' ELSE 'copy' END AS action FROM (SELECT doc_id AS path, sha256 FROM {DOCS_SQL} WHERE doc_id % 10 <> 0))""")
def j10_files_by_content(spark, sf_dir):
    every = docs(spark, sf_dir).select(F.col("doc_id").alias("path"), "sha256")
    return literature.duplicates(every.where("path % 10 <> 0"), every.where("path % 10 = 0")).select("path", "action")


@query(f"""
SELECT n.doc_id, CASE WHEN s.sha256 <> n.sha256 THEN n.k || ':sha256:' || substr(n.sha256, 1, 12) ELSE n.k END AS doc_key FROM (SELECT *, 'k' || doc_id // 2 AS k FROM {DOCS_SQL} WHERE doc_id % 2 = 1) n LEFT JOIN (SELECT *, 'k' || doc_id // 2 AS k FROM {DOCS_SQL} WHERE doc_id % 2 = 0) s USING (k)""")
def i02_versions_of_one_key(spark, sf_dir):
    every = docs(spark, sf_dir).select("doc_id", "sha256", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2)).alias("doc_key"))
    return literature.split_versions(every.where("doc_id % 2 = 1"), every.where("doc_id % 2 = 0")).select("doc_id", "doc_key")


OLD_SQL = "(SELECT 'k' || doc_id AS doc_key, CASE WHEN doc_id % 2 = 0 THEN 'doi' || doc_id END AS doi, 2000 + doc_id % 9 AS year, CASE WHEN doc_id % 3 = 0 THEN '/old' END AS local_path, CAST(NULL AS VARCHAR) AS sha256, lang AS title, 'old' AS metadata, 'stored' AS status, source AS reason, 1 AS created_at, 1 AS updated_at FROM documents WHERE doc_id % 4 <> 3)"
NEW_SQL = """(SELECT 'k' || ((doc_id * 3) % 700) AS doc_key, doc_id AS seq, CASE WHEN doc_id % 5 <> 0 THEN 'new' || doc_id END AS doi, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS year, CASE WHEN doc_id % 7 = 0 THEN '/new' || doc_id END AS local_path,
  CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id END AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'Untitled' ELSE source || doc_id END AS title, 'm' || doc_id AS metadata, 'st' || (doc_id % 6) AS status, 'r' || doc_id AS reason, 10 + doc_id AS stamp FROM documents)"""


def old_state(spark, sf_dir):
    c = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 4 <> 3").select(
        F.concat(F.lit("k"), c).alias("doc_key"), F.when(c % 2 == 0, F.concat(F.lit("doi"), c)).alias("doi"), (2000 + c % 9).alias("year"), F.when(c % 3 == 0, "/old").alias("local_path"), F.lit(None).cast("string").alias("sha256"), F.col("lang").alias("title"),
        F.lit("old").alias("metadata"), F.lit("stored").alias("status"), F.col("source").alias("reason"), F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"),
    )


def new_state(spark, sf_dir):
    c = F.col("doc_id")
    named = lambda p: F.concat(F.lit(p), c)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("k"), c * 3 % 700).alias("doc_key"), c.alias("seq"), F.when(c % 5 != 0, named("new")).alias("doi"), F.when(c % 4 == 0, c).alias("year"), F.when(c % 7 == 0, named("/new")).alias("local_path"), F.when(c % 2 == 0, named("s")).alias("sha256"),
        F.when(c % 3 == 0, "Untitled").otherwise(F.concat("source", c)).alias("title"), named("m").alias("metadata"), F.concat(F.lit("st"), c % 6).alias("status"), named("r").alias("reason"), (10 + c).alias("stamp"),
    )


UPSERT_SQL = f"""
WITH n AS (SELECT *, min(CASE WHEN local_path IS NOT NULL THEN seq END) OVER (PARTITION BY doc_key) AS f FROM {NEW_SQL}),
g AS (SELECT doc_key, arg_max(doi, seq) FILTER (doi IS NOT NULL) AS doi, arg_max(year, seq) FILTER (year IS NOT NULL) AS year, arg_max(local_path, seq) FILTER (local_path IS NOT NULL) AS local_path, arg_max(sha256, seq) FILTER (sha256 IS NOT NULL) AS sha256,
  arg_max(title, seq) FILTER (title <> 'Untitled') AS title, arg_max(metadata, seq) AS metadata, arg_max(status, seq) FILTER (seq <= coalesce(f, seq)) AS status, arg_max(reason, seq) FILTER (seq <= coalesce(f, seq)) AS reason, min(stamp) AS created, arg_max(stamp, seq) AS updated FROM n GROUP BY doc_key)
SELECT doc_key, coalesce(g.doi, o.doi) AS doi, coalesce(g.year, o.year) AS year, coalesce(g.local_path, o.local_path) AS local_path, coalesce(g.sha256, o.sha256) AS sha256, coalesce(g.title, o.title, 'Untitled') AS title,
  CASE WHEN g.updated IS NOT NULL THEN g.metadata ELSE o.metadata END AS metadata, CASE WHEN o.local_path IS NOT NULL OR g.updated IS NULL THEN o.status ELSE g.status END AS status, CASE WHEN o.local_path IS NOT NULL OR g.updated IS NULL THEN o.reason ELSE g.reason END AS reason,
  coalesce(o.created_at, g.created) AS created_at, coalesce(g.updated, o.updated_at) AS updated_at FROM {OLD_SQL} o FULL JOIN g USING (doc_key)"""


@query(UPSERT_SQL)
def i01_document_upsert(spark, sf_dir):
    return literature.upserted(old_state(spark, sf_dir), new_state(spark, sf_dir))


@query(UPSERT_SQL)
def i01_upsert_in_buckets(spark, sf_dir):
    """The same upsert into a stored table, of which only the touched buckets are rewritten; the batch comes twice."""
    at, old, new = scratch(spark, "documents"), old_state(spark, sf_dir), new_state(spark, sf_dir)
    schema = literature.upserted(old, new).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    buckets.merge(at, old, 0, ["doc_key"], columns, lambda stored, incoming: incoming)
    for _ in range(2):
        buckets.merge(at, new, 1, ["doc_key"], columns, literature.upserted)
    return buckets.read(spark, at, columns)


@query(f"""
SELECT doc_key, coalesce(n.status, q.status) AS status, coalesce(q.attempts, 0) + coalesce(n.n, 0) AS attempts, CASE WHEN n.n IS NOT NULL THEN n.error ELSE q.last_error END AS last_error FROM {QUEUE_SQL} q
FULL JOIN (SELECT doc_key, arg_max(status, seq) AS status, arg_max(reason, seq) AS error, count(*) AS n FROM (SELECT 'd' || ((seq * 3) % 700) AS doc_key, seq, status, reason FROM {NEW_SQL}) GROUP BY doc_key) n USING (doc_key)""")
def i03_queue_transitions(spark, sf_dir):
    outcomes = new_state(spark, sf_dir).select(F.concat(F.lit("d"), F.col("seq") * 3 % 700).alias("doc_key"), "seq", "status", F.col("reason").alias("error"))
    return literature.queue_transitions(queue(spark, sf_dir), outcomes)


@query(f"""
SELECT doc_key, title FROM (SELECT doc_key, title FROM {OLD_SQL} UNION ALL SELECT doc_key, arg_min(title, seq) FROM {NEW_SQL} WHERE doc_key NOT IN (SELECT doc_key FROM {OLD_SQL}) GROUP BY doc_key)""")
def i04_idempotent_insert(spark, sf_dir):
    return tables.inserted(old_state(spark, sf_dir).select("doc_key", "title"), new_state(spark, sf_dir).select("doc_key", "title", "seq"), ["doc_key"], ["seq"]).select("doc_key", "title")


CHECKPOINTS_SQL = f"""
SELECT doc_key, slot, title FROM (SELECT doc_key, year % 3 AS slot, title FROM {OLD_SQL} WHERE (doc_key, year % 3) NOT IN (SELECT (doc_key, seq % 3) FROM {NEW_SQL}) UNION ALL SELECT doc_key, seq % 3, arg_max(title, seq) FROM {NEW_SQL} GROUP BY ALL)"""


@query(CHECKPOINTS_SQL)
def i05_checkpoint_upsert(spark, sf_dir):
    was = old_state(spark, sf_dir).select("doc_key", (F.col("year") % 3).alias("slot"), "title")
    return tables.replaced(was, new_state(spark, sf_dir).select("doc_key", (F.col("seq") % 3).alias("slot"), "title", "seq"), ["doc_key", "slot"], ["seq"]).select("doc_key", "slot", "title")


@query(CHECKPOINTS_SQL)
def i05_checkpoints_in_buckets(spark, sf_dir):
    """The same by a key of two columns, in buckets."""
    at, keys, columns = scratch(spark, "checkpoints"), ["doc_key", "slot"], "doc_key string, slot bigint, title string"
    was = old_state(spark, sf_dir).select("doc_key", (F.col("year") % 3).alias("slot"), "title")
    buckets.merge(at, was, 0, keys, columns, lambda stored, incoming: incoming)
    news = new_state(spark, sf_dir).select("doc_key", (F.col("seq") % 3).alias("slot"), "title", "seq")
    buckets.merge(at, news, 1, keys, columns, lambda stored, incoming: tables.replaced(stored, incoming, keys, ["seq"]))
    return buckets.read(spark, at, columns)


@query(f"""
SELECT kind, evidence_id, place FROM (SELECT kind, evidence_id, CAST(row_number() OVER (PARTITION BY kind ORDER BY confidence DESC NULLS LAST, created_at DESC, evidence_id) AS INT) AS place FROM {CLAIMS_SQL} WHERE kind <> 'other') WHERE place <= 20""")
def w03_context_evidence(spark, sf_dir):
    """Twenty a kind are the feature."""
    return literature.context_evidence(claims(spark, sf_dir)).select("kind", "evidence_id", "place")


@query(f"""
SELECT lang, source, place FROM (SELECT lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS INT) AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) WHERE place <= 4""")
def w05_top_fields_of_a_role(spark, sf_dir):
    """Four a role are the feature; languages stand for roles, sources for fields."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return tables.top_rows(counts, ["lang"], [F.desc("n"), F.col("source")], 4).select("lang", "source", "place")


SCORED = ["the", "und", "license", "of"]


@query(f"""
WITH s AS (SELECT e.evidence_id, e.confidence, lower(d.title || ' ' || e.claim) AS t FROM {CLAIMS_SQL} e JOIN {DOCS_SQL} d USING (doc_key) ORDER BY e.confidence DESC NULLS LAST, e.evidence_id LIMIT 5000),
r AS (SELECT evidence_id, confidence, CAST(list_sum([least(4, (length(t) - length(replace(t, w, ''))) // length(w)) FOR w IN {[w for w in SCORED if len(w) > 2]}]) AS BIGINT) AS score FROM s)
SELECT evidence_id, score FROM r WHERE score > 0 ORDER BY score DESC, confidence DESC NULLS LAST, evidence_id LIMIT 24""")
def t01_retrieved_evidence(spark, sf_dir):
    """The best 24 of the 5000 most confident are the feature."""
    return literature.retrieved(claims(spark, sf_dir), docs(spark, sf_dir), SCORED).select("evidence_id", "score")


@query(f"SELECT status, count(*) AS n, 'document' AS what FROM {DOCS_SQL} GROUP BY ALL UNION ALL SELECT status, count(*), 'queue' FROM {QUEUE_SQL} GROUP BY ALL UNION ALL SELECT kind, count(*), 'evidence' FROM {CLAIMS_SQL} GROUP BY ALL")
def a01_counts_by_status(spark, sf_dir):
    count = lambda df, c, what: df.groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return count(docs(spark, sf_dir), "status", "document").unionByName(count(queue(spark, sf_dir), "status", "queue")).unionByName(count(claims(spark, sf_dir), "kind", "evidence"))


@query(f"SELECT count(*) AS documents, count(local_path) AS with_file, count(*) FILTER (status IN ('indexed', 'downloaded')) AS to_read, count(*) FILTER (reason = 'late') AS manual FROM {DOCS_SQL}")
def a16_library_headline(spark, sf_dir):
    c = F.col
    return docs(spark, sf_dir).agg(F.count("*").alias("documents"), F.count("local_path").alias("with_file"), F.count_if(c("status").isin("indexed", "downloaded")).alias("to_read"), F.count_if(c("reason") == "late").alias("manual"))


@query(f"""
SELECT doc_key, page, kind, claim, locator, confidence FROM (
  SELECT doc_key, page, kind, claim, locator, confidence FROM (SELECT * FROM {CLAIMS_SQL} WHERE claim <> '') WHERE page % 2 = 0
  UNION ALL SELECT doc_key, page, 'figure', 'Figure ' || locator || ': x / y', locator, NULL FROM {CLAIMS_SQL} WHERE page % 3 = 0)""")
def f24_page_responses_to_evidence(spark, sf_dir):
    p = F.col("page")
    item = F.when((p % 2 == 0) & (F.col("claim") != ""), F.array(F.struct("kind", "claim", "locator", "confidence"))).otherwise(F.array())
    figure = F.when(p % 3 == 0, F.array(F.struct(F.col("locator").alias("label"), F.array(F.lit("x"), F.lit("y")).alias("axes")))).otherwise(F.array())
    responses = claims(spark, sf_dir).select("doc_key", "page", F.lit("m").alias("model"), F.to_json(F.struct(item.alias("items"), figure.alias("figures"))).alias("json"))
    return literature.page_evidence(responses).select("doc_key", "page", "kind", "claim", "locator", "confidence")


@query(f"""
SELECT path, CASE WHEN m.sha IS NULL THEN 'unregistered' WHEN c.sha IS NULL THEN 'missing' WHEN m.sha <> c.sha THEN 'stale' ELSE 'current' END AS state FROM (SELECT doc_id AS path, sha256(text) AS sha FROM documents WHERE doc_id % 8 <> 0) c
FULL JOIN (SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 11 <> 0) m USING (path)""")
def j13_stale_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    manifest = rows.where("path % 11 <> 0").select("path", F.when(F.col("path") % 9 == 0, "x").otherwise(F.col("sha")).alias("was"))
    both = rows.where("path % 8 <> 0").join(manifest, "path", "full")
    return both.select("path", F.when(F.col("was").isNull(), "unregistered").when(F.col("sha").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("sha")), "stale").otherwise("current").alias("state"))
