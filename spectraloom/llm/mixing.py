"""Mixing sources to target weights.

Tokens are aggregated by source; a source's repetition rate is its target over its size.
Each document is taken floor(rate) times, and once more where a hash-seeded uniform falls
under the fraction. Of a few seeds, a source uses the one whose draw comes nearest its target.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.textbatch import IS_SPACE, spread, struct_udf, text_bytes, word_spans
from spectraloom.session import checkpointed, numbered

SEEDS = 8
LIMIT = 3


def _sizes(texts: pa.Array) -> list:
    data, offsets = text_bytes(texts)
    first = word_spans(data, offsets, ~IS_SPACE[data])[2]
    return [first[1:] - first[:-1]]


def with_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `size`: the words of the whole text (null: 0)."""
    return spread(df, F.col(f"`{text_col}`"), "__size", struct_udf(T.StructType([T.StructField("size", T.LongType())]), _sizes))


def uniform(id_col: str, seed: int) -> Column:
    """A uniform of [0, 1) fixed by the id and the seed: eight hex digits of an md5; four seeds share one."""
    text = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f"|{seed // 4}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), seed % 4 * 8 + 1, 8), 16, 10).cast("double") / float(1 << 32)


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("null"))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) of each source of `sizes` (source, size).

    Sources in order (null last) weigh 1, 2, 3, 1, ...; they share all sizes by weight, a
    target stops at 3 times its source's size, and the excess is shared anew until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = checkpointed(numbered(by_source, [F.col("source").asc_nulls_last()], "__n").withColumn("weight", F.col("__n") % 3 + 1))
    cap = LIMIT * F.col("source_size")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, fixed = (total or 0) / (weight or 1), 0
    while True:  # each round fixes one source or more; only sums are gathered
        over = cap < F.lit(level) * F.col("weight")
        capped, left = ranked.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        if not left or capped == fixed:
            break
        level, fixed = (total - capped) / left, capped
    return ranked.select(source_key("source").alias("key"), "source_size", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def join_sources(df: DataFrame, plan: DataFrame, rows: int, key: Column, salt: Column, most: int = 100_000) -> DataFrame:
    """`df` with its source's plan: broadcast up to `most` sources, else joined on a salted key, so that a hot source is spread."""
    keyed = df.withColumn("__key", key)
    if rows <= most:
        return keyed.join(F.broadcast(plan.withColumnRenamed("key", "__key")), "__key").drop("__key")
    salted = plan.withColumnRenamed("key", "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return keyed.withColumn("__salt", F.pmod(salt, F.lit(16)).cast("int")).join(salted, ["__key", "__salt"]).drop("__key", "__salt")


def copies(id_col: str) -> Column:
    """floor(rate) copies, and one more with the fraction's probability."""
    drawn = F.lit(0)
    for seed in range(SEEDS):
        drawn = F.when((F.col("__seed") == seed) & (uniform(id_col, seed) < F.col("__fraction")), 1).otherwise(drawn)
    return F.least(F.col("__whole") + drawn, F.lit(LIMIT)).cast("int")


def plan(sizes: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """For each source: key, source_size, target, __whole and __fraction of its rate, and its __seed; and how many sources there are.

    `sizes` (id, source, size) is read three times: give a checkpointed table.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = checkpointed(targets(sizes).withColumn("__whole", F.floor(rate)).withColumn("__fraction", rate - F.floor(rate)))
    n = rated.count()
    drawn = join_sources(sizes, rated, n, source_key("source"), F.xxhash64(id_col))
    sums = drawn.groupBy(source_key("source").alias("key")).agg(*[F.sum(F.when(uniform(id_col, s) < F.col("__fraction"), F.col("size")).otherwise(0)).alias(f"__s{s}") for s in range(SEEDS)])
    both = rated.join(sums, "key")
    missed = F.array(*[F.struct(F.abs(F.col("source_size") * F.col("__whole") + F.col(f"__s{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    return checkpointed(both.select("key", "source_size", "target", "__whole", "__fraction", F.array_min(missed)["seed"].alias("__seed"))), n


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`df` with source_size, target and copies: how often the mix takes each document.

    Null sources are a source of their own, after all others; texts that are null have no
    words but are drawn like others. Rows of equal ids are drawn alike. Input columns named
    like the added ones are replaced.
    """
    df = df.drop("source_size", "target", "copies")
    sizes = checkpointed(with_size(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))).drop("text"))
    rates, n = plan(sizes)
    held = join_sources(df, rates, n, source_key(source_col), F.xxhash64(F.col(f"`{id_col}`")))
    return held.withColumn("copies", copies(id_col)).drop("__whole", "__fraction", "__seed")


def mix_report(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of each document of `df` (doc_id, text, source)."""
    sizes = checkpointed(with_size(df.select("doc_id", "source", "text")).drop("text"))
    rates, n = plan(sizes)
    held = join_sources(sizes, rates, n, source_key("source"), F.xxhash64("doc_id"))
    return held.select("doc_id", "size", "source_size", "target", (F.col("size") * copies("doc_id")).cast("bigint").alias("taken"))


def emitted(df: DataFrame) -> DataFrame:
    """The mix itself: each document of `mixed()` as many times as its copies say."""
    return df.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", "copies", "source_size", "target")


#: DuckDB SQL for mix_report over `documents`.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
levels AS (
  SELECT 0 AS round, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM s) AS level
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) - sum(CASE WHEN 3 * source_size < level * weight THEN 3 * source_size ELSE 0 END))::DOUBLE
                            / nullif(sum(CASE WHEN 3 * source_size < level * weight THEN 0 ELSE weight END), 0) FROM s)
  FROM levels WHERE round < 40 AND level IS NOT NULL),
top AS (SELECT max(level) AS level FROM levels),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM s, top),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
u AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS fraction, k.seed,
    (CASE WHEN ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || (k.seed // 4)), k.seed % 4 * 8 + 1, 8))::UBIGINT / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS drawn
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(8)) AS seed) k),
m AS (
  SELECT source, seed, abs(any_value(source_size) * any_value(whole) + sum(size * drawn) - any_value(target)) AS miss FROM u GROUP BY source, seed),
b AS (SELECT source, seed FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(u.size * least(u.whole + u.drawn, 3) AS BIGINT) AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.seed = b.seed
"""
