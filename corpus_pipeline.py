"""A training corpus from the documents: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, language, minhash, mixing, pii
from spectraloom.session import removed, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The pseudonyms' key; a user sets their own.
KEY = "corpus-pipeline"
#: Documents whose best language has a smaller share are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language; the model learns from the stage's own documents.

    Without one labelled document nothing can be told apart: then only texts without a letter go.
    Null and empty texts have no letter. Repeated rows stay or go alike; an empty table stays empty.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}"))).select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; near-duplicates share 0.8 of their shingles of five words.

    Rows that repeat an id are one document and stay or go together; rows without an id stay
    unless another document holds their text.
    """
    labelled = minhash.near_duplicates(docs)
    gone = labelled.where(~F.col("kept"))
    named = gone.where("doc_id is not null").select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    kept = docs.join(named, "doc_id", "left_anti").select(*COLUMNS)
    if gone.where("doc_id is null").limit(1).count():
        texts = docs.where("doc_id is not null").select("text").distinct()
        lost = kept.where("doc_id is null").join(texts, "text", "left_anti").select(*COLUMNS)
        kept = kept.where("doc_id is not null").unionByName(lost)
    return kept


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the new text.

    No document goes. A null text stays null, and so does its n_chars; equal texts get equal
    pseudonyms; an empty table stays empty.
    """
    return pii.pseudonymise(docs.select(*COLUMNS), KEY).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate says, so rows may repeat.

    A null source is one of its own. Texts without a word weigh nothing, and their documents
    are drawn like others. Rows of one id are drawn alike; an empty table stays empty.
    """
    return mixing.emitted(mixing.mixed(docs.select(*COLUMNS))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and a check that they decode to it.

    A null text counts as empty: no ids, and n_tokens 0. Repeated rows stay; an empty table stays empty.
    """
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    whole = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii_pseudonyms", pii_pseudonyms), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: The model, the pseudonyms and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again as the next one's input."""
    at = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:  # no later stage reads it
            removed(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
