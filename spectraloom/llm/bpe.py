"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into overlapping chunks that become rows of their own, so one
text is pre-tokenised by many tasks. Two neighbours are stitched at the first
pre-token boundary both report inside their overlap: from a shared boundary on,
both tokenisations agree. The stitched pieces are encoded apart and their ids
joined in order. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm.textbatch import small_batches

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 32768, 1024

_loaded: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def ranks_file(path: str | None = None) -> bytes:
    """The rank file's bytes, read on the driver: they are sent to the executors, whose own disks need no copy."""
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    key = (raw, pattern)
    if key not in _loaded:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _encode_udf(spark: SparkSession, raw: bytes, pattern: str, decode: bool):
    """The packed ids of a text, and with `decode` the raw bytes that they decode to, in one pass: a second one would double the workers."""
    sent = spark.sparkContext.broadcast(raw)
    fields = [pa.field("ids", pa.binary()), *[pa.field("raw", pa.binary())] * decode]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(sent.value, pattern)
        for batch in batches:
            ids = [packed(own.encode_ordinary(x.as_py() or "")) for x in batch]
            columns = [ids, [own.decode_bytes(np.frombuffer(v, "<u4").tolist()) for v in ids]] if decode else [ids]
            yield pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], fields=fields)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "ids binary, raw binary" if decode else "ids binary")


def _zones_udf(pattern: str, chunk: int, overlap: int):
    """Boundaries in a chunk's first and last overlap, counted from the overlap's start.

    Only boundaries after a character other than white space count: the text before
    such a one is split alike whether or not what follows is there.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = regex.compile(pattern)
        for batch in batches:
            out = []
            for x in batch:
                text = x.as_py()
                cuts = [m.end() for m in split.finditer(text) if m.end() < len(text) and not text[m.end() - 1].isspace()]
                out.append({"head": [0, *(c for c in cuts if c < overlap)], "tail": [c - chunk for c in cuts if c >= chunk]})
            yield pa.array(out, pa.struct([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "head array<int>, tail array<int>")


def encode(
    df: DataFrame,
    text_col: str = "text",
    ids_col: str = "ids",
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded_col: str | None = None,
) -> DataFrame:
    """Adds `ids_col`: the token ids of the whole text as little-endian unsigned 32-bit integers; and `decoded_col`, if named: the raw bytes the ids decode to.

    Null and empty texts give empty ids. Repeated rows stay repeated; an input column
    named like `ids_col` is replaced, any other column stays. A text of one chunk is
    encoded where it is read; only longer texts are shuffled.
    """
    spark = df.sparkSession
    small_batches(spark)
    encoded = _encode_udf(spark, ranks_file(ranks), pattern, decoded_col is not None)
    made = {"ids": ids_col} | ({"raw": decoded_col} if decoded_col else {})
    df = df.drop(*made.values())
    kept = [F.col(f"`{c}`") for c in df.columns]
    text = F.col(f"`{text_col}`")
    short = df.where(F.coalesce(F.char_length(text), F.lit(0)) <= chunk).select(*kept, encoded(text).alias("__e")).select(*kept, *[F.col(f"__e.{c}").alias(name) for c, name in made.items()])

    rows = df.where(F.char_length(text) > chunk).select(F.struct(*kept).alias("__row"), F.monotonically_increasing_id().alias("__key"))
    inner = F.col(f"__row.`{text_col}`")
    number = F.explode(F.sequence(F.lit(0), ((F.char_length(inner) - 1) / chunk).cast("int")))
    chunks = (
        rows.select("__key", number.alias("__k"), "__row")
        .select("__key", "__k", F.expr(f"substring(__row.`{text_col}`, __k * {chunk} + 1, {chunk + overlap})").alias("__part"), F.when(F.col("__k") == 0, F.col("__row")).alias("__row"))
        .repartition("__key", "__k")
    )
    zoned = chunks.withColumn("__z", _zones_udf(pattern, chunk, overlap)("__part"))
    order = Window.partitionBy("__key").orderBy("__k")
    shared = F.array_min(F.array_intersect(F.col("__z.head"), F.lag("__z.tail").over(order)))
    cut = (
        zoned.withColumn("__cut", F.when(F.col("__k") == 0, F.lit(0)).otherwise(shared))
        # the next chunk's first boundary ends this piece; without a shared one, the chunks run on as one piece
        .withColumn("__next", F.lead("__cut").over(order))
        .withColumn("__last", F.lead("__k").over(order).isNull())
        .withColumn("__piece", F.sum(F.col("__cut").isNotNull().cast("int")).over(order))
    )
    start = F.coalesce(F.col("__cut"), F.lit(0))
    length = F.when(F.col("__last"), F.lit(chunk + overlap)).otherwise(F.lit(chunk) + F.coalesce(F.col("__next"), F.lit(0)) - start)
    pieces = (
        cut.select("__key", "__k", "__piece", "__row", F.substring(F.col("__part"), start + 1, length).alias("__part"))
        .groupBy("__key", "__piece")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__part"))), lambda x: x["__part"]), "").alias("__part"),
            F.first("__row", ignorenulls=True).alias("__row"),
        )
        .select("__key", "__piece", "__row", encoded("__part").alias("__e"))
    )
    # bytes joined as they are, in one go: adding piece after piece would copy the start of a long text again and again
    joined = lambda c: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__piece", F.hex(F.col(f"__e.{c}")).alias("__hex")))), lambda x: x["__hex"]), ""))
    whole = pieces.groupBy("__key").agg(F.first("__row", ignorenulls=True).alias("__row"), *[joined(c).alias(name) for c, name in made.items()])
    return short.unionByName(whole.select("__row.*", *made.values()))


def decode(ids: Column | str, spark: SparkSession, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The raw bytes of packed ids (null for null): the token's bytes one after the other, whatever their boundaries cut."""
    sent = spark.sparkContext.broadcast(ranks_file(ranks))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(sent.value, pattern)
        for batch in batches:
            yield pa.array([None if (v := x.as_py()) is None else own.decode_bytes(np.frombuffer(v, "<u4").tolist()) for x in batch], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def unpacked(ids: Column | str) -> Column:
    """Packed ids as array<bigint>, by built-in functions."""
    as_hex = F.hex(ids)
    word = lambda i: F.conv(F.concat(*[F.substring(as_hex, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    n = F.octet_length(ids) / 4
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), word)).otherwise(F.array().cast("array<bigint>"))
