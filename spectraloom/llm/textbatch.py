"""Arrow batches of texts as numpy views: the vectorised core that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one vectorised step handles; numpy's intermediates take some 30 times as much.
STEP_BYTES = 1 << 20
#: Words are maximal runs of other bytes than these.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as the empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of a batch of at most `limit` bytes each (a longer text stands alone)."""
    _, offsets = text_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield texts.slice(low, high - low)
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of bytes where `inside` holds, cut at text ends), and the first word of each text (n + 1)."""
    padded = np.zeros(len(data) + 1, bool)
    padded[:-1] = inside
    starts = padded.copy()
    starts[1:-1] &= ~padded[:-2]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    starts[inner] |= padded[inner]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = padded[:-1] & ~padded[1:]
    ends[inner] |= padded[inner - 1] & (inner > 0)
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends), np.searchsorted(first, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over keyed bytes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    places = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(places, lengths)
    kept = data[np.repeat(starts, lengths) + within]
    terms = BYTE_KEYS[kept] * _powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(terms, places) + lengths.astype(np.uint64))


def struct_udf(schema: StructType, work: Callable[[pa.Array], list[pa.Array]], make: Callable | None = None):
    """An Arrow UDF of one text column that returns a struct.

    `work` gets a slice of a batch and returns a column for each field; with `make`,
    `work` is `make()`'s result, built once a task.
    """
    fields = list(to_arrow_schema(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make() if make else work
        for batch in batches:
            parts = [step(part) for part in steps(batch)]
            columns = [
                pa.concat_arrays([pa.array(p[i], f.type) if not isinstance(p[i], pa.Array) else p[i].cast(f.type) for p in parts]) if parts else pa.array([], f.type)
                for i, f in enumerate(fields)
            ]
            yield pa.StructArray.from_arrays(columns, fields=fields)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)


#: Rows and bytes of an Arrow batch: whole texts are long, and both sides hold a batch several times.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def small_batches(spark) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger.

    They stay so: a DataFrame is planned when it is used, after this has returned. It changes
    how large the pieces are that Python is sent, and no result.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def spread(df, column, name: str, udf):
    """`df` with the fields of `udf(column)` after its columns; a column of the same name is replaced."""
    small_batches(df.sparkSession)
    fields = udf.returnType.fieldNames()
    kept = [c for c in df.columns if c.lower() not in {f.lower() for f in fields}]
    held = df.select(*[F.col(f"`{c}`") for c in kept], udf(column).alias(name))
    return held.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{name}.{f}").alias(f) for f in fields])
