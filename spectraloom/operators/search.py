"""Text search through a posting index of trigrams, which leaves the exact comparison few rows.

A batch of texts adds its postings in folders by trigram bucket; nothing older is rewritten, and a rerun of a batch
writes the same folder again. Texts are numbered in blocks, each of which holds its trigrams' numbers as gaps, about a byte a posting, and the texts' names once. A query reads the names and the buckets of its own trigrams alone. Postings of rows that have gone or changed do no harm: what they
lead to is compared with the texts as they are.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.session import shuffle_width, small_batches

#: Buckets of trigrams; a block's names are in one more. 64-bit hashes are cut evenly, so a power of two.
BUCKETS = 64
#: A block is closed at so many texts, so that two bytes tell its texts apart, or postings.
TEXTS, POSTINGS = 1 << 16, 1 << 21
POSTING = "block string, grams binary, counts binary, numbers binary"


def _grams(text: str | Column) -> Column:
    """The distinct trigrams of a text in lower case, as hashes."""
    return _grams_of(_chars(text))


def _chars(text: str | Column) -> Column:
    return F.split(F.lower(text), "")


def _grams_of(chars: str | Column) -> Column:
    """As `_grams`, of a text's characters: a column of them is made once, an expression for each use."""
    chars = F.col(chars) if isinstance(chars, str) else chars
    size = F.size(chars)
    # characters beside their next two: a substring would look for its place from the text's start
    near = F.slice(F.arrays_zip(chars.alias("a"), F.slice(chars, F.lit(2), size).alias("b"), F.slice(chars, F.lit(3), size).alias("c")), F.lit(1), size - 2)
    return F.when(size >= 3, F.array_distinct(F.transform(near, lambda n: F.xxhash64(F.concat(n["a"], n["b"], n["c"])))))


def literals(query: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards; a backslash takes a wildcard's meaning away."""
    parts, at = [""], 0
    while at < len(query):
        if query[at] == "\\" and at + 1 < len(query):
            parts[-1] += query[at + 1]
            at += 1
        elif query[at] in "%_":
            parts.append("")
        else:
            parts[-1] += query[at]
        at += 1
    return [p for p in parts if p]


def _block(kinds: list, ids: list, grams: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that has postings: its trigrams, ascending, how many texts hold each, and their numbers; and a row of the texts' names."""
    coded = pa.array(np.concatenate(grams)).dictionary_encode()
    values, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.lexsort((values, values & (BUCKETS - 1)))
    values, rank = values[order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes].astype(np.uint16 if len(values) <= 1 << 16 else np.int64)  # short numbers are sorted in linear time
    number = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes, minlength=len(values)).astype(np.uint32)
    ends = np.cumsum(counts, dtype=np.int64)
    gaps = np.diff(number, prepend=0)
    gaps[ends - counts] = number[ends - counts]
    gaps = gaps.astype(np.uint16)
    name = uuid.uuid4().hex
    rows = [{"block": name, "bucket": BUCKETS, "numbers": zlib.compress(json.dumps([kinds, ids]).encode(), 1)}]
    for bucket in np.unique(values & (BUCKETS - 1)).tolist():
        low, high = np.searchsorted(values & (BUCKETS - 1), [bucket, bucket + 1])
        mine = gaps[ends[low] - counts[low] : ends[high - 1]]
        planes = mine.view(np.uint8).reshape(-1, 2).T.tobytes()  # the high bytes are mostly zeros
        rows.append({"block": name, "bucket": bucket, "grams": values[low:high].tobytes(), "counts": counts[low:high].tobytes(), "numbers": zlib.compress(planes, 1)})
    return pa.RecordBatch.from_pylist(rows, _BLOCK)


_BLOCK = pa.schema([("block", pa.string()), ("grams", pa.binary()), ("counts", pa.binary()), ("numbers", pa.binary()), ("bucket", pa.int32())])


def indexed(texts: DataFrame, path: str, batch: int) -> None:
    """Adds the postings of `texts` (kind, id, text) as a batch. Texts of fewer than three characters have none."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, ids, grams, held = [], [], [], 0
        for part in batches:
            lists = part.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (kind, name) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if ends[i] == ends[i + 1]:
                    continue
                kinds.append(kind), ids.append(name), grams.append(values[ends[i] : ends[i + 1]])
                held += len(grams[-1])
                if len(ids) == TEXTS or held >= POSTINGS:
                    yield _block(kinds, ids, grams)
                    kinds, ids, grams, held = [], [], [], 0
        if ids:
            yield _block(kinds, ids, grams)

    small_batches(texts.sparkSession)
    # rows without trigrams are left out below, as a filter here would make all trigrams twice
    rows = texts.select("kind", F.col("id").cast("string").alias("id"), _chars("text").alias("chars")).select("kind", "id", _grams_of("chars").alias("grams"))
    # the rows of a block stay together, as one attempt of a task made them
    rows = rows.mapInArrow(packed, f"{POSTING}, bucket int").repartition(max(8, shuffle_width(texts.sparkSession) // 8), "block")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={batch}")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(kind, id) of the texts that hold every trigram of the query's literal parts; None where it has none, so that nothing can be ruled out."""
    found = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.lit(p)), F.array().cast("array<bigint>")) for p in literals(query)]))) if literals(query) else F.array().cast("array<bigint>")).first()[0]
    if not found:
        return None

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of each of the query's trigrams, and the names as they are."""
        for part in batches:
            out = []
            for block, grams, counts, numbers, bucket in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if bucket == BUCKETS:
                    out.append({"block": block, "names": True, "numbers": numbers})
                    continue
                values, ends = np.frombuffer(grams, np.int64), np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64)
                at = np.flatnonzero(np.isin(values, found))
                gaps = np.frombuffer(zlib.decompress(numbers), np.uint8).reshape(2, -1).T.copy().view(np.uint16)[:, 0] if len(at) else None
                for i in at.tolist():
                    out.append({"block": block, "names": False, "numbers": np.cumsum(gaps[ends[i - 1] if i else 0 : ends[i]], dtype=np.uint16).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.string()), ("names", pa.bool_()), ("numbers", pa.binary())]))

    def named(block: pa.Table) -> pa.Table:
        """The block's texts that all of the trigrams have."""
        rows, hits, names = block.to_pylist(), np.zeros(TEXTS, np.int64), None
        for row in rows:
            if row["names"]:
                names = row["numbers"]
            else:
                hits[np.frombuffer(row["numbers"], np.uint16)] += 1
        at = np.flatnonzero(hits == len(found)).tolist()
        kinds, ids = json.loads(zlib.decompress(names)) if at else ([], [])
        return pa.table({"kind": pa.array([kinds[i] for i in at], pa.string()), "id": pa.array([ids[i] for i in at], pa.string())})

    held = spark.read.schema(f"{POSTING}, batch bigint, bucket int").parquet(path).where(F.col("bucket").isin(sorted({g % BUCKETS for g in found} | {BUCKETS})))
    met = held.select("block", "grams", "counts", "numbers", "bucket").mapInArrow(looked_up, "block string, names boolean, numbers binary")
    return met.groupBy("block").applyInArrow(named, "kind string, id string").distinct()


def searched(evidence: DataFrame, documents: DataFrame, path: str, query: str, limit: int = 20) -> DataFrame:
    """literature.searched through the index in `path` of the claims (kind claim, id evidence_id) and titles (kind title, id doc_key): the same rows.

    Queries without three literal characters in a row compare all rows.
    """
    near = candidates(evidence.sparkSession, path, query)
    claim, title = (F.col(c).ilike(f"%{query}%") for c in ("claim", "title"))
    if near is None:
        both = evidence.join(documents.select("doc_key", "title"), "doc_key").where(claim | title)
    else:
        ids = lambda kind, name: near.where(F.col("kind") == kind).select(F.col("id").alias(name))
        named = documents.select("doc_key", "title")
        titled = named.join(ids("title", "doc_key"), "doc_key", "left_semi").where(title)
        by_claim = evidence.join(ids("claim", "evidence_id"), "evidence_id", "left_semi").where(claim).join(named, "doc_key")
        by_title = evidence.join(titled, "doc_key").where(~F.coalesce(claim, F.lit(False)))
        both = by_claim.unionByName(by_title)
    return both.orderBy(F.desc_nulls_last("confidence"), "evidence_id").limit(limit)
