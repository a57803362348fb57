"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, chat, credentials, editembed, language, lexical, licenses, minhash, mixing, negatives, orderjoin, pii, quality
from spectraloom.session import table

#: The key of the registered queries; a user passes their own.
KEY = "registered-queries"


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, decoded_col="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editembed.neighbour_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "grammar")), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", language.held_out("doc_id").alias("held_out"), "text"), model).drop("text")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.rendered(chat.repaired(table(spark, sf_dir, "conversations")))
    return turns.select("conv_id", "turn", "role", "action", "new_role", "cost", F.array_join("inserted", ",").alias("inserted"), F.array_join("appended", ",").alias("appended"), "fragment")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.license_scan(docs)
    labels = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "notices.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("notices.likeness"), F.lit(0.0))).alias("score"),
        F.to_json("notices").alias("notices"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", *quality.STATS, "base_failed", "kept", "anomaly")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderjoin.jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").where(negatives.complete("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(held.select("vec_id", label.alias("label"), negatives.scaled("embedding").alias("embedding")), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item: a top-k report."""
    return lexical.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def near_edit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands and the verification of operator 1: each document's group of near texts."""
    return editembed.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def rendered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's whole conversations, repaired and rendered."""
    return chat.conversations(chat.rendered(chat.repaired(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_edit_fingerprints, op2_source_mix, op3_secret_scan, op4_minhash_near_dedup, op5_language_id, op6_chat_repair, op7_license_scan, op8_quality_rules, op9_byte_bpe, op10_pii_pseudonyms, op11_ngram_jaccard_join, op12_hard_negatives, op13_lexical_search, near_edit_groups, rendered_conversations)}
ORACLES: dict[str, str] = {"op4_minhash_near_dedup": minhash.near_sql(3, 85), "op2_source_mix": mixing.MIX_SQL, "op11_ngram_jaccard_join": orderjoin.groups_sql(3, 90), "op12_hard_negatives": negatives.NEGATIVES_SQL, "op13_lexical_search": lexical.RANKED_SQL}
