"""Ranked lexical search over tries of documents' term vectors.

Each document's terms are restricted to those that some item asks for, with their counts, and
ordered by how many documents hold them, most first. Vectors in that order share the paths of
a trie, as in an FP-tree. A subtree knows the largest count of each term below it and the
smallest m (length norm): that bounds the score of every document below. Each item walks
the trie depth first, the best bound first, and leaves out subtrees that can't reach its first k.

Tasks build tries of some thousand documents and carry an item's best from one to the next;
the best of all tasks are ranked by Spark. Items are taken in blocks of a fixed number of terms,
so that what a task is sent doesn't grow with them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spectraloom.llm.textbatch import LOWER, small_batches, spread, struct_udf, text_bytes, word_hashes, word_spans
from spectraloom.operators.tables import top_rows
from spectraloom.session import checkpointed, compact

#: Terms are maximal runs of these bytes: digits, letters and all beyond ASCII.
IS_TERM = np.array([0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0x80 for b in range(256)])
#: Distinct terms and items of a block of items (an item of more terms is a block alone); documents and term counts of one trie; documents of a bucket.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 15, 2048
TRIE_DOCS, TRIE_COUNTS = 1 << 14, 1 << 22
BUCKET = 32

TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.LongType()))])
VECTOR = T.StructType([T.StructField("n_terms", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every term of all texts in order, and the first term of each text (n + 1). Only A-Z are lower-cased."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_TERM[data])
    return word_hashes(data, starts, ends), first


def _distinct(texts: pa.Array) -> list:
    hashes, first = term_hashes(texts)
    return [[np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]]


def _vectors(known: np.ndarray):
    """texts -> how many terms each has, and the number in `known` (sorted hashes) and count of each term that is there, packed as 32-bit integers."""

    def work(texts: pa.Array) -> list:
        hashes, first = term_hashes(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        pairs, counts = np.unique(text[hit] * len(known) + at[hit], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(known)) * 4
        packed = lambda values: pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(np.uint32))])
        return [np.diff(first), packed(pairs % len(known)), packed(counts)]

    return struct_udf(VECTOR, work)


def _holders(vectors: DataFrame, n_known: int) -> np.ndarray:
    """How many documents hold each known term: counted a task, summed by Spark."""

    def count(batches):
        total = np.zeros(n_known, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), minlength=n_known)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    out = np.zeros(n_known, np.int64)
    for row in vectors.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score, by which its weight is multiplied: it grows with the count and falls with m."""
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


class Trie:
    """The documents' vectors in lexical order of their ranked terms, cut into subtrees and buckets of neighbouring leaves."""

    def __init__(self, ids: list, m: np.ndarray, starts: np.ndarray, ranks: np.ndarray, counts: np.ndarray, n_ranks: int):
        raw = ranks.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__))
        lengths = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts[:-1][order] - self.starts[:-1], lengths) + np.arange(self.starts[-1])
        self.ranks, self.counts, self.m = ranks[take], counts[take], m[order]
        self.ids, self.doc = [ids[i] for i in order], np.repeat(np.arange(len(ids)), lengths)
        self.low, self.high, self.kids = [], [], []
        self._cut(self._shared())
        self._bound(n_ranks)

    def _shared(self) -> np.ndarray:
        """How many terms each document's path shares with that of the one before."""
        out = np.zeros(len(self.ids), np.int64)
        for i in range(1, len(self.ids)):
            a, b = self.ranks[self.starts[i - 1] : self.starts[i]], self.ranks[self.starts[i] : self.starts[i + 1]]
            n = min(len(a), len(b))
            apart = a[:n] != b[:n]
            at = int(apart.argmax()) if n else 0
            out[i] = at if n and apart[at] else n
        return out

    def _cut(self, shared: np.ndarray) -> None:
        """Nodes from the root down; neighbouring branches of fewer than BUCKET documents share a leaf, a branch with most of its parent isn't a node of its own."""

        def node(low: int, high: int, parent: int | None) -> int:
            self.low.append(low), self.high.append(high), self.kids.append([])
            if parent is not None:
                self.kids[parent].append(len(self.low) - 1)
            return len(self.low) - 1

        open_nodes = [(0, len(self.ids), node(0, len(self.ids), None))]
        while open_nodes:
            low, high, own = open_nodes.pop()
            if high - low <= BUCKET:
                if (low, high) != (self.low[own], self.high[own]):
                    node(low, high, own)
                continue
            inner = shared[low + 1 : high]
            cuts = [low, *(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
            since = low
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > BUCKET:
                    if since < a:
                        node(since, a, own)
                    large = 4 * (b - a) > 3 * (self.high[own] - self.low[own])
                    open_nodes.append((a, b, own if large else node(a, b, own)))
                    since = b
                elif b - since >= BUCKET:
                    node(since, b, own)
                    since = b
            if since < high:
                node(since, high, own)

    def _bound(self, n_ranks: int) -> None:
        """By term: the nodes that hold it below, its largest count there, and each node's smallest m and id."""
        low, high = np.array(self.low), np.array(self.high)
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(low, high, strict=True)])
        self.least_id = [min(_key(x) for x in self.ids[a:b]) for a, b in zip(low, high, strict=True)]
        leaves = sorted((i for i, kids in enumerate(self.kids) if not kids), key=self.low.__getitem__)
        leaf_of = np.repeat(np.arange(len(leaves)), high[leaves] - low[leaves])
        pair, most = _largest(leaf_of[self.doc] * n_ranks + self.ranks, self.counts)
        first, leaf_low = np.searchsorted(pair, np.arange(len(leaves) + 1) * n_ranks), low[leaves]
        nodes, terms, tops = [np.array(leaves)[pair // n_ranks]], [pair % n_ranks], [most]
        for i, kids in enumerate(self.kids):
            if kids:
                a, b = first[np.searchsorted(leaf_low, low[i])], first[np.searchsorted(leaf_low, high[i])]
                term, top = _largest(pair[a:b] % n_ranks, most[a:b])
                nodes.append(np.full(len(term), i)), terms.append(term), tops.append(top)
        order = np.argsort(np.concatenate(terms), kind="stable")
        self.node_of, self.top = np.concatenate(nodes)[order], np.concatenate(tops)[order]
        self.term_at = np.searchsorted(np.concatenate(terms)[order], np.arange(n_ranks + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, column: np.ndarray, best: list, k: int) -> list:
        """`best`, (-score, id's key) in order, at most k, with this trie's documents taken in. `column` is -1 for each rank, and is so again after the call."""
        spans = [slice(self.term_at[t], self.term_at[t + 1]) for t in terms.tolist()]
        node = np.concatenate([self.node_of[s] for s in spans])
        if not len(node):
            return best
        weight = np.repeat(weights, [s.stop - s.start for s in spans])
        limit = np.zeros(len(self.low), np.int64)
        np.add.at(limit, node, weight * gain(np.concatenate([self.top[s] for s in spans]), self.least_m[node]))
        column[terms] = np.arange(len(terms))
        todo = [0]
        while todo:
            at = todo.pop()
            if not limit[at] or len(best) == k and (-int(limit[at]), self.least_id[at]) > best[-1]:
                continue
            if self.kids[at]:
                todo += sorted(self.kids[at], key=limit.__getitem__)
                continue
            low, high = self.low[at], self.high[at]
            part = slice(self.starts[low], self.starts[high])
            own = column[self.ranks[part]]
            hit = np.flatnonzero(own >= 0)
            doc = self.doc[part][hit]
            scores = np.zeros(high - low, np.int64)
            np.add.at(scores, doc - low, weights[own[hit]] * gain(self.counts[part][hit], self.m[doc]))
            least = -best[-1][0] if len(best) == k else 1
            found = np.flatnonzero(scores >= max(least, 1))
            if len(found):
                best = sorted(best + [(-int(scores[i]), _key(self.ids[low + i])) for i in found.tolist()])[:k]
        column[terms] = -1
        return best


def _key(value) -> tuple:
    """An id in ascending order, null last."""
    return (1,) if value is None else (0, value)


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the largest value of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return keys[first], np.maximum.reduceat(values[order], first) if len(first) else values[:0]


def _walk(rank_of: np.ndarray, weights: np.ndarray, asked: list, item_ids: list, base: int, n_docs: int, n_all: int, k: int, schema: T.StructType):
    """mapInArrow over (id, n_terms, terms, counts): the first k documents of each item among a task's."""
    fields = to_arrow_schema(schema)

    def run(batches):
        best, column = [[] for _ in asked], np.full(len(weights), -1)

        def grown(held: list[pa.RecordBatch]) -> None:
            both = pa.Table.from_batches(held).combine_chunks()
            n = both.column("n_terms").to_numpy()
            packed = [both.column(c).to_pylist() for c in ("terms", "counts")]
            lengths = np.array([len(x) // 4 for x in packed[0]])
            ranks = rank_of[np.frombuffer(b"".join(packed[0]), np.uint32)]
            counts = np.frombuffer(b"".join(packed[1]), np.uint32).astype(np.int64)
            order = np.argsort(np.repeat(np.arange(len(n)), lengths) * len(weights) + ranks)
            trie = Trie(both.column("id").to_pylist(), 50 + (50 * n * n_docs) // n_all, np.concatenate([[0], np.cumsum(lengths)]), ranks[order], counts[order], len(weights))
            for i, terms in enumerate(asked):
                if len(terms):
                    best[i] = trie.search(terms, weights[terms], column, best[i], k)

        held, docs, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs, size = docs + batch.num_rows, size + batch.column("terms").nbytes // 4
            if docs >= TRIE_DOCS or size >= TRIE_COUNTS:
                grown(held)
                held, docs, size = [], 0, 0
        if held:
            grown(held)
        rows = [(base + i, item_ids[i], key[1] if len(key) > 1 else None, -score) for i, found in enumerate(best) for score, key in found]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return run


def _blocks(items: DataFrame):
    """(item_id, terms) of all items, in blocks of at most BLOCK_ITEMS items and BLOCK_TERMS terms."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(row.terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.terms))
        size += len(row.terms)
    if block:
        yield block


def ranked(items: DataFrame, docs: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score for each item, ranks from 1, scores above 0 only.

    A term weighs floor(1000 * ln((2N + 2) / (2 df + 1))), a document scores the sum of weight * ((10^9 tf) div
    (1000 tf + 20 m)) over an item's distinct terms, m = 50 + (50 n N) div L, in 64-bit integers. N counts the
    documents with a term, L all their terms, n one document's. Equal scores go by ascending id, a null id last.

    Null and empty texts have no term, so such documents don't count and such items return nothing. Each row is a document,
    and each row of `items` an item, also where ids repeat; other columns play no part. Terms are told apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = spread(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), F.col("text"), "__t", struct_udf(TERMS, _distinct)).drop("text")
    schema = T.StructType([T.StructField("item_no", T.LongType()), T.StructField("item_id", asked.schema["item_id"].dataType), T.StructField("doc_id", texts.schema["id"].dataType), T.StructField("score", T.LongType())])
    out, base = docs.sparkSession.createDataFrame([], schema), 0
    for block in _blocks(asked.where(F.size("terms") > 0)):
        known = np.unique(np.concatenate([np.array(t, np.int64) for _, t in block]).view(np.uint64))
        every = checkpointed(spread(texts, F.col("text"), "__v", _vectors(known)).drop("text"))
        n_docs, n_all = every.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        vectors = compact(every.where(F.octet_length("terms") > 0), TRIE_DOCS)
        df = _holders(vectors, len(known))
        order = np.argsort(-df, kind="stable")
        rank_of = np.empty(len(known), np.int64)
        rank_of[order] = np.arange(len(known))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df[order].tolist()], np.int64)
        terms = [np.sort(rank_of[np.searchsorted(known, np.array(t, np.int64).view(np.uint64))]) for _, t in block]
        if n_docs:
            found = vectors.mapInArrow(_walk(rank_of, weights, terms, [i for i, _ in block], base, n_docs, n_all, k, schema), schema)
            out = out.unionByName(found)
        base += len(block)
    first = top_rows(out, ["item_no"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return first.select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL for ranked(benchmark, documents).
RANKED_SQL = r"""
WITH lower_ AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM dfs, whole),
norms AS (SELECT doc_id, CAST(100 - 50 + ((50 * n * nn) // ll) AS BIGINT) AS m FROM lengths, whole),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
