"""Papers and evidence: ingest, keys, queues, page plans, retrieval, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.operators.tables import latest, top_rows
from spectraloom.session import running

# Kinds of evidence.
KINDS = ("measurement", "assignment", "mechanism", "relationship", "limitation", "counterexample")
WORK = "doi string, title string, publication_year int, id string, best_oa_location struct<pdf_url:string, landing_page_url:string>"
ITEM = "array<struct<kind:string, claim:string, locator:string, confidence:double>>"
FIGURE = "array<struct<label:string, axes:array<string>>>"


def works(raw: DataFrame, column: str = "json") -> DataFrame:
    """Documents from nested work objects, one JSON text a row; rows that don't parse have no id and go."""
    w = raw.select(*[c for c in raw.columns if c != column], F.from_json(column, WORK).alias("w"))
    tail = F.element_at(F.split("w.id", "/"), -1)
    made = w.select(
        *[c for c in raw.columns if c != column], scalars.normalize_doi("w.doi").alias("doi"), F.coalesce("w.title", F.lit("Untitled")).alias("title"), F.col("w.publication_year").alias("year"), tail.alias("external_id"),
        F.col("w.best_oa_location.pdf_url").alias("pdf_url"), F.coalesce("w.best_oa_location.landing_page_url", "w.id").alias("landing_url"),
    )
    return made.where(F.coalesce("doi", "external_id").isNotNull()).withColumn("doc_key", scalars.document_key("doi", "external_id", "title"))


def batch_hits(hits: DataFrame, keys: list[str], batch: str, order: str) -> DataFrame:
    """The first hit of each key in a batch, and its place among the batch's distinct hits, without one task holding a batch. `order` tells a batch's hits apart."""
    rest = [c for c in hits.columns if c not in (*keys, batch)]
    firsts = hits.groupBy(batch, *keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__f")).select(batch, *keys, *[F.col(f"__f.{c}").alias(c) for c in rest])
    # a struct, as hits of no batch are a batch too
    placed = running(firsts.withColumns({"__batch": F.struct(batch), "__one": F.lit(1)}), ["__batch"], [order], "__one", "__before")
    return placed.withColumn("position", (F.col("__before") + 1).cast("int")).select(*firsts.columns, "position")


def arrivals(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits with is_new, and whether they are to be downloaded (no local file yet). `stored` has (doc_key, local_path)."""
    both = hits.join(stored.select("doc_key", F.col("local_path").alias("__local"), F.lit(True).alias("__known")), "doc_key", "left")
    return both.select(*hits.columns, F.col("__known").isNull().alias("is_new"), F.col("__local").isNull().alias("to_queue"))


def queue_view(documents: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents with their download status (absent: none) and the first reason known."""
    q = queue.select("doc_key", F.col("status").alias("__q"), F.col("reason").alias("__r"))
    return documents.join(q, "doc_key", "left").select(*documents.columns, F.coalesce("__q", F.lit("none")).alias("download"), F.coalesce("__r", "reason").alias("why")).drop("reason")


def fetchable(documents: DataFrame, queue: DataFrame, keys: DataFrame | None, limit: int) -> DataFrame:
    """Queued or retried documents, newest year first, then by title and key; with a key table, only its keys: an empty one selects nothing."""
    ready = documents.join(queue.where(F.col("status").isin("queued", "retry")).select("doc_key"), "doc_key")
    if keys is not None:
        ready = ready.join(keys.select("doc_key").distinct(), "doc_key", "left_semi")
    return ready.orderBy(F.desc_nulls_last("year"), "title", "doc_key").limit(limit)


def duplicates(files: DataFrame, stored: DataFrame, digest: str = "sha256", order: str = "path") -> DataFrame:
    """Files with what to do: `known` (the content is stored), `first` of a new content, or `copy` of it: the latter two only link."""
    first = files.groupBy(digest).agg(F.min(order).alias("__first"))
    both = files.join(first, digest).join(stored.select(digest, F.lit(True).alias("__known")).distinct(), digest, "left")
    return both.select(*files.columns, F.when(F.col("__known"), "known").when(F.col(order) == F.col("__first"), "first").otherwise("copy").alias("action"))


def split_versions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys of incoming documents: the same key with another content becomes a version of its own."""
    s = stored.select("doc_key", F.col("sha256").alias("__sha"))
    other = F.col("__sha").isNotNull() & F.col("sha256").isNotNull() & (F.col("__sha") != F.col("sha256"))
    versioned = F.when(other, F.concat("doc_key", F.lit(":sha256:"), F.substring("sha256", 1, 12))).otherwise(F.col("doc_key"))
    return incoming.join(s, "doc_key", "left").select(*[c for c in incoming.columns if c != "doc_key"], versioned.alias("doc_key"))


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents after the incoming versions, taken in `seq` order.

    A new value wins over none, a title unless it is 'Untitled'; metadata is always replaced;
    status and reason are frozen once a local file is there; created_at stays.
    """
    newest = lambda c, when=None: F.max_by(c, F.when(F.col(c).isNotNull() if when is None else when, F.col("seq")))
    first_file = F.min(F.when(F.col("local_path").isNotNull(), F.col("seq")))
    lead = incoming.join(incoming.groupBy("doc_key").agg(first_file.alias("__file")), "doc_key")
    open_ = F.col("seq") <= F.coalesce("__file", F.lit((1 << 62)))
    fresh = lead.groupBy("doc_key").agg(
        *[newest(c).alias(f"n_{c}") for c in ("doi", "year", "local_path", "sha256")], newest("title", F.col("title") != "Untitled").alias("n_title"), F.max_by("metadata", "seq").alias("n_metadata"),
        newest("status", open_).alias("n_status"), newest("reason", open_).alias("n_reason"), F.min("stamp").alias("n_created"), F.max_by("stamp", "seq").alias("n_updated"),
    )
    both = stored.join(fresh, "doc_key", "full")
    had = F.col("local_path").isNotNull()
    touched = F.col("n_updated").isNotNull()
    return both.select(
        "doc_key", *[F.coalesce(f"n_{c}", c).alias(c) for c in ("doi", "year", "local_path", "sha256")], F.coalesce("n_title", "title", F.lit("Untitled")).alias("title"),
        F.when(touched, F.col("n_metadata")).otherwise(F.col("metadata")).alias("metadata"), F.when(had | ~touched, F.col("status")).otherwise(F.col("n_status")).alias("status"),
        F.when(had | ~touched, F.col("reason")).otherwise(F.col("n_reason")).alias("reason"), F.coalesce("created_at", "n_created").alias("created_at"), F.coalesce("n_updated", "updated_at").alias("updated_at"),
    )


def queue_transitions(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after outcomes (doc_key, seq, status, error): the last status, and an attempt for each outcome; keys not queued yet come in."""
    news = outcomes.groupBy("doc_key").agg(F.max_by("status", "seq").alias("n_status"), F.max_by("error", "seq").alias("n_error"), F.count("*").alias("n"))
    both = queue.join(news, "doc_key", "full")
    return both.select("doc_key", F.coalesce("n_status", "status").alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("attempts"), F.when(F.col("n").isNotNull(), F.col("n_error")).otherwise(F.col("last_error")).alias("last_error"))


def page_plan(pages: DataFrame, least: int = 4, most: int = 4) -> DataFrame:
    """(doc_key, page, rank): each document's most relevant pages; pages with images first, then page order. Pages come as (doc_key, page, score, image_count)."""
    order = [F.desc("score"), F.desc(F.col("image_count") > 0), F.col("page")]
    return top_rows(pages.where(F.col("score") >= least), ["doc_key"], order, most, slices=1).select("doc_key", "page", F.col("place").alias("rank"))


def plan_list(plan: DataFrame) -> DataFrame:
    """(doc_key, pages, n): the planned pages in rank order, comma-joined."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "page")))
    return plan.groupBy("doc_key").agg(F.array_join(F.transform(ordered, lambda p: p["page"].cast("string")), ",").alias("pages"), F.count("*").alias("n"))


def unfinished(plan: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Planned pages that no completed run has under the same document, contents, prompt, model and page."""
    return plan.join(runs.where("status = 'completed'").select(*keys).distinct(), keys, "left_anti")


def evidence_problem() -> Column:
    """What is wrong with an evidence row (kind, claim, locator, confidence), NULL if nothing."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(~size("claim").between(1, 4000), "claim")
        .when(~size("locator").between(1, 500), "locator")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")
    )


def page_evidence(responses: DataFrame) -> DataFrame:
    """(doc_key, page, kind, claim, locator, confidence, evidence_id) from page responses (doc_key, page, model, json): items keep their kind, figures become claims of their own."""
    read = responses.select("doc_key", "page", "model", F.from_json("json", f"items {ITEM}, figures {FIGURE}").alias("j"))
    items = read.select("doc_key", "page", "model", F.explode("j.items").alias("i")).select("doc_key", "page", "model", "i.*")
    figures = read.select("doc_key", "page", "model", F.explode("j.figures").alias("f")).select(
        "doc_key", "page", "model", F.lit("figure").alias("kind"), F.concat(F.lit("Figure "), "f.label", F.lit(": "), F.array_join(F.coalesce("f.axes", F.array()), " / ")).alias("claim"), F.col("f.label").alias("locator"), F.lit(None).cast("double").alias("confidence")
    )
    both = items.unionByName(figures)
    return both.withColumn("evidence_id", scalars.hash_id("doc_key", F.col("page").cast("string"), "kind", "claim"))


def searched(evidence: DataFrame, documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Evidence whose claim or title is LIKE %query% in any case (% and _ stay wildcards), most confident first."""
    both = evidence.join(documents.select("doc_key", "title"), "doc_key")
    hit = F.col("claim").ilike(f"%{query}%") | F.col("title").ilike(f"%{query}%")
    return both.where(hit).orderBy(F.desc_nulls_last("confidence"), "evidence_id").limit(limit)


def retrieved(evidence: DataFrame, documents: DataFrame, words: list[str], scan: int = 5000, limit: int = 24) -> DataFrame:
    """Of the `scan` most confident rows, the `limit` that hold the words most; rows without any are out."""
    both = evidence.join(documents.select("doc_key", "title"), "doc_key").orderBy(F.desc_nulls_last("confidence"), "evidence_id").limit(scan)
    scored = both.withColumn("score", scalars.token_score(F.concat_ws(" ", "title", "claim"), F.array(*map(F.lit, words))))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc_nulls_last("confidence"), "evidence_id").limit(limit)


def context_evidence(evidence: DataFrame, per_kind: int = 20) -> DataFrame:
    """The most confident, then newest, rows of each kind: kinds are few, so the ranking is sliced."""
    order = [F.desc_nulls_last("confidence"), F.desc("created_at"), F.col("evidence_id")]
    return top_rows(evidence.where(F.col("kind").isin(*KINDS)), ["kind"], order, per_kind, salt=["evidence_id"])


def rolled_up(documents: DataFrame, runs: DataFrame, planned: DataFrame) -> DataFrame:
    """Document statuses after page runs: failed if any page failed, extracted if any ran, without relevant pages if none was planned; others stay."""
    ran = latest(runs, ["doc_key", "page"], ["seq"]).groupBy("doc_key").agg(F.count_if(F.col("status") == "failed").alias("bad"), F.count("*").alias("n"))
    both = documents.join(ran, "doc_key", "left").join(planned.select("doc_key").distinct().withColumn("__p", F.lit(True)), "doc_key", "left")
    made = F.when(F.col("bad") > 0, "evidence_failed").when(F.col("n") > 0, "evidence_extracted").when((F.col("status") == "parsed") & F.col("__p").isNull(), "evidence_no_relevant_pages").otherwise(F.col("status"))
    return both.select(*[c for c in documents.columns if c != "status"], made.alias("status"))


def extraction_totals(runs: DataFrame) -> DataFrame:
    """One row over page runs (doc_key, page, status, evidence_count, error, from_checkpoint): documents, pages, evidence, failures, hits and the errors."""
    error = F.when(F.col("status") == "failed", F.struct("doc_key", "page", "error"))
    return runs.agg(
        F.count_distinct("doc_key").alias("documents"), F.count("*").alias("pages"), F.sum("evidence_count").alias("evidence"), F.count_distinct(F.when(F.col("status") == "failed", F.col("doc_key"))).alias("failed_documents"),
        F.count_if("from_checkpoint").alias("checkpoint_hits"), F.count(error).alias("errors"),
    )
