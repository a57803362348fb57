"""Hard negatives by threshold joins of vectors, in the manner of L2AP.

Rows and anchors are packed in blocks, and each pair of blocks is one cell, joined and dealt
out by Spark. In a cell, dimensions are taken in a common order. The index holds a row's
dimensions only as far as needed: the rest is left out where its norm bounds its part of any
score below the lowest threshold of the cell. Partial scores are accumulated over the indexed
dimensions; a pair goes when its partial score and the norms of what remains can't reach the
anchor's threshold. What survives is scored exactly, in 64-bit integers.

What is asked are windows: the first k rows of an anchor with scores in a range, of the same
label (positives) or of another (negatives). A first join over one block of rows estimates how
far down a window reaches; the join over all rows starts there, and its threshold is lowered
for the windows that it left unfilled, to where that block's rows alone fill them or to their end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.textbatch import small_batches
from spectraloom.operators.tables import top_rows
from spectraloom.session import checkpointed, shuffle_width

#: Rows and anchors of a block at most; rows of a block at least, where there are too few for all tasks.
ROWS, ANCHORS, FEWEST = 1 << 14, 1 << 11, 1 << 10
#: Anchors that are scored in one go, dimensions that are taken in one go, pairs that are scored exactly in one go.
TOGETHER, STRIDE, EXACT = 128, 8, 1 << 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1

PACKED = "block int, n int, ids binary, labels binary, vectors binary"
FOUND = "anchor_id bigint, window int, row_id bigint, score bigint"


def scaled(vector: str | Column, by: int = 256) -> Column:
    """A vector of numbers as integers: floor(by * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double")).cast("bigint"))


def complete(vector: str | Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return vector.isNotNull() & F.forall(vector, fits)


def _pack(group: pa.Table) -> pa.Table:
    """The rows of a block as one row: ids, labels and vectors side by side, shorter vectors filled up with zeros."""
    vectors = group.column("vector").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    held = np.zeros((len(vectors), int(lengths.max(initial=0))), np.int64)
    held[np.arange(held.shape[1])[None, :] < lengths[:, None]] = vectors.flatten().to_numpy()
    parts = [group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label")]
    out = {"block": group.column("block").slice(0, 1).combine_chunks().cast(pa.int32()), "n": pa.array([len(held)], pa.int32()), "ids": [parts[0]], "labels": [parts[1]], "vectors": [held.tobytes()]}
    if "windows" in group.column_names:
        windows = group.column("windows").to_pylist()
        ends = np.cumsum([0, *map(len, windows)])
        flat = [(w["window"], w["low"], w["high"], w["least"]) for of_anchor in windows for w in of_anchor]
        out["ends"], out["windows"] = [ends.astype(np.int64).tobytes()], [np.array(flat, np.int64).reshape(-1, 4).tobytes()]
    return pa.table(out)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """(rows, dimensions + 1): the norm of each row from each dimension on."""
    squares = np.square(vectors)
    return np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(vectors), 1))], axis=1))


class Index:
    """Rows of a block by dimension, without the dimensions that can't decide whether a score reaches `share` times the anchor's norm."""

    def __init__(self, vectors: np.ndarray, share: float):
        self.dims = np.argsort(-np.square(vectors.astype(float)).sum(axis=0), kind="stable")
        held = vectors[:, self.dims].astype(float)
        rests = rest_norms(held)
        #: the first dimension from which on a row is left out
        cut = (rests >= share).sum(axis=1) if share > 0 else np.full(len(held), held.shape[1])
        cut = np.minimum(cut, held.shape[1])
        self.rows = np.argsort(-cut, kind="stable")
        self.cut, self.held, self.rests = cut[self.rows], held[self.rows], rests[self.rows]

    def candidates(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the pairs whose score may reach the anchor's threshold: all that do are among them."""
        held = anchors[:, self.dims].astype(float)
        rests = rest_norms(held)
        slack = 1e-9 * rests[:, 0] * self.rests[:, 0].max(initial=0) + 1e-6
        partial = np.zeros((len(held), int((self.cut > 0).sum())))
        n = partial.shape[1]
        for at in range(0, held.shape[1], STRIDE):
            k = int(np.searchsorted(-self.cut, -at, "left"))  # rows that are indexed beyond `at`
            partial[:, :k] += held[:, at : at + STRIDE] @ self.held[:k, at : at + STRIDE].T
            end = min(at + STRIDE, held.shape[1])
            if 2 * end >= held.shape[1]:
                stop = np.minimum(np.maximum(-(-self.cut[:n] // STRIDE) * STRIDE, 0), end)
                limit = partial + rests[:, stop] * self.rests[np.arange(n), stop][None, :]
                may = limit >= (least - slack)[:, None]
                if end == held.shape[1] or may.mean() < 0.02:
                    i, j = np.nonzero(may)
                    return i, self.rows[j]
        i, j = np.nonzero(np.broadcast_to((least <= slack)[:, None], (len(held), len(self.rows))))  # vectors without dimensions
        return i, self.rows[j]


def _exact(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = [np.einsum("pd,pd->p", anchors[i[a : a + EXACT]], rows[j[a : a + EXACT]]) for a in range(0, len(i), EXACT)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def filled(anchor: tuple, ends: np.ndarray, windows: np.ndarray, row: tuple, same: bool, k: int) -> list[np.ndarray]:
    """(anchor id, window, row id, score) of one cell: each window's first k rows among the block's, from its threshold up."""
    (ids, labels, vectors), (row_ids, row_labels, row_vectors) = anchor, row
    if vectors.shape[1] != row_vectors.shape[1]:
        width = max(vectors.shape[1], row_vectors.shape[1])
        vectors, row_vectors = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (vectors, row_vectors))
    least = np.nextafter([float(windows[a:b, 3].min()) for a, b in zip(ends[:-1], ends[1:], strict=True)], -np.inf)
    norms = rest_norms(vectors.astype(float))[:, 0]
    index = Index(row_vectors, float((least / np.maximum(norms, 1e-9)).min(initial=np.inf)) * (1 - 1e-9))
    out = []
    for at in range(0, len(ids), TOGETHER):
        i, j = index.candidates(vectors[at : at + TOGETHER], least[at : at + TOGETHER])
        i += at
        fits = ((labels[i] == row_labels[j]) == same) & (ids[i] != row_ids[j])
        i, j = i[fits], j[fits]
        scores = _exact(vectors, row_vectors, i, j)
        near = scores >= least[i]
        i, j, scores = i[near], j[near], scores[near]
        order = np.lexsort((row_ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        first = np.searchsorted(i, np.arange(at, min(at + TOGETHER, len(ids)) + 1))
        for a, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), at):
            down = -scores[low:high]
            for window, bottom, top, start in windows[ends[a] : ends[a + 1]].tolist():
                since = int(np.searchsorted(down, -top, "left"))
                until = min(since + k, int(np.searchsorted(down, -max(bottom, start, LEAST + 1), "right")))
                if since < until:
                    part = slice(low + since, low + until)
                    n = until - since
                    out.append(np.column_stack([np.full(n, ids[a]), np.full(n, window), row_ids[j[part]], scores[part]]))
    return out


def _cells(rows: DataFrame, n_blocks: int, asked: DataFrame, sample: bool, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, row_id, score): a round over all blocks of rows, or over the first alone."""
    spark = rows.sparkSession
    n_asked = max(1, -(-asked.count() // ANCHORS))
    held = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n_asked)).cast("int"))
    packed = held.groupBy("block").applyInArrow(_pack, PACKED + ", ends binary, windows binary").withColumnRenamed("block", "of_asked")
    packed = packed.select(*[F.col(c).alias(f"a_{c}") for c in packed.columns], F.explode(F.sequence(F.lit(0), F.lit(0 if sample else n_blocks - 1))).alias("block"))
    if sample:
        rows = rows.where("block = 0")
    each = rows.withColumn("a_of_asked", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    width = min(n_asked * (1 if sample else n_blocks), 4096)
    keys = ["block", "a_of_asked"]
    cells = each.repartition(width, *keys).join(packed.repartition(width, *keys), keys)

    def run(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                anchor = _unpacked({c: cell[f"a_{c}"] for c in ("ids", "labels", "vectors")})
                windows = np.frombuffer(cell["a_windows"], np.int64).reshape(-1, 4)
                found = filled(anchor, np.frombuffer(cell["a_ends"], np.int64), windows, _unpacked(cell), same, k)
                flat = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2]), pa.array(flat[:, 3])], ["anchor_id", "window", "row_id", "score"])

    small_batches(spark)
    first = top_rows(cells.mapInArrow(run, FOUND), ["anchor_id", "window"], [F.col("score").desc(), F.col("row_id")], k, slices=8)
    return checkpointed(first.select("anchor_id", "window", "row_id", "score"))


def fill(rows: DataFrame, n_rows: int, n_blocks: int, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, row_id, score): the first k rows of each window, by falling score and rising id.

    `rows` are packed blocks; `asked` (id, label, vector, windows: array of window, low, high) holds an
    anchor a row. A window's rows have scores from low to high, and the anchor's label or not, as `same` says; never its id.
    """
    windows = checkpointed(asked.select("id", F.inline("windows")))

    def round_(least: DataFrame, sample: bool) -> DataFrame:
        """`least`: (id, window, least), the thresholds of the windows that are looked for."""
        each = windows.join(least, ["id", "window"]).groupBy("id").agg(F.collect_list(F.struct("window", "low", "high", "least")).alias("windows"))
        return _cells(rows, n_blocks, asked.drop("windows").join(each, "id"), sample, same, k)

    seen = round_(windows.select("id", "window", F.col("low").alias("least")), True)
    if n_blocks == 1:
        return seen
    share = max(1, min(k, -(-2 * k // n_blocks)))  # a block's first so many stand for twice k of all rows
    scores = F.sort_array(F.collect_list("score"), asc=False)
    held = seen.groupBy(F.col("anchor_id").alias("id"), "window").agg(scores.alias("s"))
    reach = lambda n: F.when(F.size("s") >= n, F.col("s")[n - 1]).otherwise(F.col("low"))
    steps = checkpointed(windows.join(held, ["id", "window"], "left").select("id", "window", "low", F.coalesce(reach(share), "low").alias("first"), F.coalesce(reach(k), "low").alias("sure")))
    found = round_(steps.select("id", "window", F.col("first").alias("least")), False)
    n = found.groupBy(F.col("anchor_id").alias("id"), "window").agg(F.count("*").alias("n"))
    short = steps.join(n, ["id", "window"], "left").where((F.coalesce("n", F.lit(0)) < k) & (F.col("first") > F.col("sure")))
    short = checkpointed(short.select("id", "window", F.col("sure").alias("least")))
    if not short.limit(1).count():
        return found
    more = round_(short, False)
    return found.join(short.select(F.col("id").alias("anchor_id"), "window"), ["anchor_id", "window"], "left_anti").unionByName(more)


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows of integer vectors.

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller id. An anchor's positives are its
    first `positives` other rows of its label. For each, the first `negatives` rows of other labels are returned with
    low * positive_score <= 100 * score <= high * positive_score, all where there are fewer.

    Rows without an id, a label or a vector take no part, nor do vectors with a null component (`complete` and `scaled` make integer
    vectors of others). Of rows that share an id one counts, the smallest by label and vector. Shorter vectors are filled up with zeros.
    Scores must fit 64 bits. Labels are told apart by 64-bit hashes, ids are whole numbers; other columns play no part.
    """
    picked = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{label_col}`")).alias("label"), F.col(f"`{vector_col}`").cast("array<bigint>").alias("vector"),
        is_anchor.alias("anchor"), F.col(f"`{label_col}`").isNotNull().alias("labelled"),
    )
    whole = picked.where("id is not null and labelled and vector is not null and forall(vector, x -> x is not null)")
    each = checkpointed(whole.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*"))
    n = each.count()
    n_blocks = max(-(-n // ROWS), min(shuffle_width(df.sparkSession), n // FEWEST), 1)
    dealt = each.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "label", "vector")
    rows = checkpointed(dealt.groupBy("block").applyInArrow(_pack, PACKED))
    anchors = each.where("anchor").select("id", "label", "vector")

    window = lambda number, least, most: F.struct(number.alias("window"), least.alias("low"), most.alias("high"))
    open_ = window(F.lit(0), F.lit(LEAST + 1), F.lit(MOST))
    near = fill(rows, n, n_blocks, anchors.withColumn("windows", F.array(open_)), True, positives)
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "row_id")).cast("int")
    placed = checkpointed(near.select("anchor_id", order.alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")))
    tens, units = "(positive_score div 100)", "(positive_score % 100)"  # so that no product outgrows 64 bits
    ranges = placed.where("positive_score >= 0").select(F.col("anchor_id").alias("id"), "window", F.expr(f"{low} * {tens} + ({low} * {units} + 99) div 100").alias("low"), F.expr(f"{high} * {tens} + ({high} * {units}) div 100").alias("high")).where("low <= high")
    asked = checkpointed(anchors.join(ranges.groupBy("id").agg(F.collect_list(window(F.col("window"), F.col("low"), F.col("high"))).alias("windows")), "id"))
    found = fill(rows, n, n_blocks, asked, False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "row_id")).cast("int")
    return found.join(placed, ["anchor_id", "window"]).select("anchor_id", "positive_id", rank.alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB SQL for op12 over `embeddings`.
NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
  row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
