"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles is sketched by a signature of COMPONENTS b-bit minima.
Sets as similar as asked differ in more than `radius` components with a probability under
MISS. Signatures are split into chunks so that any two within the radius have one chunk
with at most one error (pigeonhole); each chunk is indexed once for each component left out,
which enumerates the allowed errors. So all pairs within the radius share a key. Links are
confirmed on the full sets.

Pairs inside a key's group are not all made: each document is first compared with the smallest
of all that it shares a key with, then with one member of each key; linked documents need no more comparison. Only documents of one group that are still
in different components are then compared with each other, and a pair is made only if sizes,
signatures and a bound on the sets' intersection leave it a chance, at the first key it shares.
That bound never falls below the intersection, so no pair within the radius is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.textbatch import IS_SPACE, LOWER, mixed, spread, struct_udf, text_bytes, word_hashes, word_spans
from spectraloom.session import checkpointed, compact, removed, scratch, tidied, written

COMPONENTS, MISS = 64, 1e-6
_odd = mixed(np.arange(1, COMPONENTS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_seed = np.uint64(0x2545F4914F6CDD1D)


def tail_radius(differ: float, n: int = COMPONENTS, miss: float = MISS) -> int:
    """The smallest r that Binomial(n, differ) exceeds with a probability of at most `miss`."""
    share, r = 1.0, -1
    while share > miss:
        r += 1
        chosen = math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        share -= math.exp(chosen + r * math.log(differ) + (n - r) * math.log1p(-differ))
    return r


def chunks(radius: int) -> list[tuple[int, int]]:
    """(start, end) of so many chunks that `radius` errors leave one with at most one."""
    n = min(radius // 2 + 1, COMPONENTS // 2)
    cuts = [round(i * COMPONENTS / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; of fewer words, the whole sequence is one shingle."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ~IS_SPACE[data])
    words = word_hashes(data, starts, ends)
    rolled = np.full(max(len(words) - width + 1, 0), _seed)
    for k in range(width):
        rolled = mixed(rolled + words[k : k + len(rolled)])
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= width:
            out.append(np.unique(rolled[low : high - width + 1]))
        elif high > low:
            one = np.array([_seed]) + np.uint64(high - low)
            for w in words[low:high]:
                one = mixed(one + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.BinaryType())])


def _sketcher(width: int):
    def work(texts: pa.Array) -> list:
        sets = shingle_sets(texts, width)
        ids, signatures = [], []
        for s in sets:
            if not len(s):
                ids.append(None), signatures.append(None)
                continue
            ids.append(mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ _seed).sum(dtype=np.uint64).tobytes())
            signatures.append(_signature(s.astype(np.uint32)))
        return [[len(s) for s in sets], ids, signatures]

    return work


def _signature(low: np.ndarray) -> bytes:
    least = np.concatenate([(low[None, :] * part[:, None]).min(axis=1) for part in np.split(_odd, 8)])
    return (mixed(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def _keys_udf(radius: int):
    parts = chunks(radius)

    def keys(signatures: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, COMPONENTS).astype(np.uint64)
        out = np.empty((len(rows), COMPONENTS), np.uint64)
        for low, high in parts:
            for skip in range(low, high):
                key = np.full(len(rows), np.uint64(skip + 1))
                for c in range(low, high):
                    if c != skip:
                        key = mixed(key * np.uint64(257) + rows[:, c])
                out[:, skip] = key
        ends = np.arange(len(rows) + 1, dtype=np.int32) * COMPONENTS
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel().view(np.int64)))

    keys.__annotations__ = {"signatures": pa.Array, "return": pa.Array}
    return F.arrow_udf(keys, "array<bigint>")


def _may_link(percent: int, radius: int):
    """Whether two nodes are near by size, signature and the bound on their intersection."""

    def near(size_x: pa.Array, size_y: pa.Array, signature_x: pa.Array, signature_y: pa.Array, counts_x: pa.Array, counts_y: pa.Array) -> pa.Array:
        n, m = size_x.to_numpy(), size_y.to_numpy()
        a, b = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, COMPONENTS) for s in (signature_x, signature_y))
        out = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((a != b).sum(axis=1) <= radius)
        for i in np.flatnonzero(out).tolist():
            x, y = (np.frombuffer(c[i].as_py(), np.uint8).astype(np.uint16)[None, :] for c in (counts_x, counts_y))
            x, y = folded(x) if x.size > y.size else x, folded(y) if y.size > x.size else y
            bound = shared_bound(x, y)[0]
            out[i] = 100 * bound >= percent * (n[i] + m[i] - bound)
        return pa.array(out)

    near.__annotations__ = {**dict.fromkeys(("size_x", "size_y", "signature_x", "signature_y", "counts_x", "counts_y"), pa.Array), "return": pa.Array}
    return F.arrow_udf(near, "boolean")


def planes(signature: str, n: int = 4) -> list[Column]:
    """The lowest n (up to 4) bits of each component, each as one bigint with component 0 at the highest bit, by built-in functions."""
    digits, out = F.hex(signature), []
    for k in range(n):
        bits = F.translate(digits, "0123456789ABCDEF", "".join(str(v >> k & 1) for v in range(16)))
        out.append(F.conv(F.regexp_replace(bits, "[01]([01])", "$1"), 2, -10).cast("bigint"))
    return out


def differing(n: int = 4) -> Column:
    """The components in whose lowest n bits the rows x and y differ, as a bitmap."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"p{k}_x").bitwiseXOR(F.col(f"p{k}_y")) for k in range(n)])


def first_shared(differ: np.ndarray, radius: int) -> np.ndarray:
    """The first key (the component left out) that each pair of signatures shares, -1 for none; `differ` has a row a pair."""
    parts = chunks(radius)
    lows = np.array([low for low, _ in parts])
    errors = np.add.reduceat(differ.astype(np.int64), lows, axis=1)
    found = (errors <= 1).any(axis=1)
    chunk = (errors <= 1).argmax(axis=1)
    out = np.full(len(differ), -1)
    for c, (low, high) in enumerate(parts):
        here = found & (chunk == c)
        out[here] = np.where(errors[here, c] == 0, low, low + differ[here, low:high].argmax(axis=1))
    return out


#: Members of a key that are compared in one go.
BLOCK = 4096
#: Pairs that one task may confirm: from so many on, nodes in many pairs are copied to spread them.
BUSY = 20_000


def buckets(n_shingles: int) -> int:
    """How many buckets a set of so many shingles is counted in: a power of two of half its size or more, so sets of like size have the same number or twice as many."""
    return 1 << max(6, (max(n_shingles, 1) - 1).bit_length() - 1)


def bucket_counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of buckets() buckets by their lowest bits, a byte each; 255 stands for all from 255 on.

    The smaller counts of two sets, summed up, bound their intersection from above (see `shared_bound`).
    """
    m = buckets(len(shingles))
    low = np.asarray(shingles).astype(np.uint64) & np.uint64(m - 1)
    return np.minimum(np.bincount(low.astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray) -> np.ndarray:
    """Counts (a row a set) in half as many buckets."""
    half = counts.shape[1] // 2
    return counts[:, :half] + counts[:, half:]


def shared_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least the size of the intersection, row by row; where a bucket of both is full, no bound at all."""
    full = ((a >= 255) & (b >= 255)).any(axis=1)
    return np.where(full, np.iinfo(np.int64).max >> 8, np.minimum(a, b).sum(axis=1, dtype=np.int64))


def _linked(percent: int):
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * shared >= percent * (len(p) + len(q) - shared))
        return pa.array(out, pa.bool_())

    linked.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(linked, "boolean")


#: Bits of the bitmap that spares most unneeded texts the shuffle to the sets: 2^18 rows of 64 at most, whatever the input.
FILTER_BITS = 1 << 24


def only_ids(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """`df` less most rows whose id isn't in `wanted` (one id column): a bitmap of fixed size over the ids' hashes. A prefilter only."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = "shiftleft(1L, cast(__at % 64 as int))"
    words = wanted.select(place(wanted.columns[0]).alias("__at")).groupBy(F.floor(F.col("__at") / 64).alias("__word")).agg(F.bit_or(F.expr(bit)).alias("__bits"))
    held = df.withColumn("__at", place(id_col)).withColumn("__word", F.floor(F.col("__at") / 64))
    return held.join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(F.expr(bit)) != 0).select(*df.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b): the smallest node reachable, by rounds of label passing and pointer jumps."""
    spark = links.sparkSession
    at = scratch(spark, "components")
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{at}/edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{at}/0")
    for turn in count(1):
        near = edges.join(labels.toDF("b", "near"), "b").select(F.col("a").alias("node"), "near", F.lit(None).alias("own"))
        met = near.union(labels.select("node", "component", "component")).groupBy("node").agg(F.min("near").alias("new"), F.min("own").alias("own"))
        beyond = F.least("new", "beyond")
        moved = written(met.join(labels.toDF("new", "beyond"), "new").select("node", beyond.alias("component"), (beyond != F.col("own")).alias("changed")), f"{at}/{turn}")
        labels = moved.select("node", "component")
        removed(spark, f"{at}/{turn - 1}")
        if not moved.where("changed").limit(1).count():
            removed(spark, f"{at}/edges")
            return labels


def node_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full sets of the needed nodes. An id that repeats with other texts is stood for by one of its sets."""

    def shingled(texts: pa.Array) -> list:
        return [[x.view(np.int64) for x in shingle_sets(texts, width)]]

    udf = struct_udf(T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]), shingled)
    sets = spread(only_ids(docs, "doc_id", needed), F.col("text"), "__s", udf).select(F.col("doc_id").alias("node"), "shingles")
    return sets.join(needed, "node", "left_semi").groupBy("node").agg(F.max_by("shingles", F.xxhash64("shingles")).alias("shingles"))


def node_facts(docs: DataFrame, classes: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(node, n_shingles, signature, counts) of the needed nodes."""

    def counted(shingles: pa.Array) -> pa.Array:
        return pa.array([bucket_counts(v.values.to_numpy(zero_copy_only=False)) for v in shingles], pa.binary())

    counted.__annotations__ = {"shingles": pa.Array, "return": pa.Array}
    counts = node_sets(docs, needed, width).select("node", F.arrow_udf(counted, "binary")("shingles").alias("counts"))
    return counts.join(classes.select("node", "n_shingles", "signature"), "node").select("node", "n_shingles", "signature", "counts")


def torn_pairs(held: DataFrame, facts: DataFrame, pairs_of: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """(a, b): all pairs of `held` (key, slot, node, component, members of the key) in one key and different components that may link.

    The members of a key are compared in vectorised blocks by `pairs_of`, which gets the rows of one
    block pair with their `facts` and returns those that sizes, signatures or the like leave a chance.
    """
    # the members of a key meet in one task, of a large key in blocks of BLOCK against each other
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = held.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "slot", "node", "component").join(facts, "node")
    dealt = dealt.select("key", "low", "high", "own", "slot", "node", "component", *[c for c in facts.columns if c != "node"])
    together = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(batches):
        held = []
        for batch in batches:
            marks = [batch.column(i).to_numpy() for i in range(3)]
            turns = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for low, high in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(3)):
                    yield pairs_of(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def _group_pairs(group: pa.Table, percent: int, radius: int) -> pa.RecordBatch:
    """The pairs of one key's block pair that are near by size, signature and the bound on their intersection and share no earlier key."""
    get = lambda name: group.column(name).to_numpy()
    node, component, size, own = get("node"), get("component"), get("n_shingles"), get("own")
    signature, slot = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(node), -1), get("slot")[0]
    levels = _levels([np.frombuffer(c, np.uint8) for c in group.column("counts").to_pylist()])
    # the low bits of all components as words: those that differ are no more than the components that do
    bits = [np.packbits((signature >> k) & 1, axis=1).view(np.uint64)[:, 0] for k in range(4)]
    across = group.column("low")[0] != group.column("high")[0]
    out = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(node), 64):
        rows = slice(at, at + 64)
        may = component[rows, None] != component[None, :]
        may &= node[rows, None] < node[None, :]
        if across:
            may &= own[rows, None] != own[None, :]
        may &= 100 * np.minimum(size[rows, None], size[None, :]) >= percent * np.maximum(size[rows, None], size[None, :])
        far = reduce(np.bitwise_or, [b[rows, None] ^ b[None, :] for b in bits])
        may &= np.bitwise_count(far) <= radius
        i, j = np.nonzero(may)
        i += at
        for part in range(0, len(i), 1 << 14):
            p, q = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
            differ = signature[p] != signature[q]
            near = differ.sum(axis=1) <= radius
            near[near] = first_shared(differ[near], radius) == slot
            p, q = bounded(levels, size, p[near], q[near], percent)
            out.append(np.column_stack([node[p], node[q]]))
    pairs = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def bounded(levels: dict, size: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (p, q) those that the bound on their intersection leaves a chance; `levels` as of _levels()."""
    out = [(p[:0], q[:0])]
    for held, place in levels.values():
        here = (place[p] >= 0) & (place[q] >= 0)
        a, b = p[here], q[here]
        bound = shared_bound(held[place[a]], held[place[b]])
        linked = 100 * bound >= percent * (size[a] + size[b] - bound)
        out.append((a[linked], b[linked]))
        p, q = p[~here], q[~here]
    return tuple(np.concatenate(side) for side in zip(*out, strict=True))


def _levels(counts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of buckets, most first: the counts of the sets with so many or, folded, twice as many, and each set's row among them (-1: none)."""
    own = np.array([len(c) for c in counts])
    out = {}
    for m in np.unique(own)[::-1].tolist():
        same, twice = np.flatnonzero(own == m), np.flatnonzero(own == 2 * m)
        held = np.array([counts[i] for i in same], np.uint16)
        if len(twice):
            held = np.concatenate([held, folded(np.array([counts[i] for i in twice], np.uint16))])
        place = np.full(len(counts), -1)
        place[np.concatenate([same, twice])] = np.arange(len(held))
        out[m] = held, place
    return out


def confirmed(pairs: DataFrame, facts: DataFrame, docs: DataFrame, width: int, percent: int, radius: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: near by node_facts, then confirmed on the full sets of `docs` (doc_id, text)."""
    held = pairs.join(facts.toDF("a", "n_a", "sig_a", "counts_a"), "a").join(facts.toDF("b", "n_b", "sig_b", "counts_b"), "b")
    return verified(held.where(_may_link(percent, radius)("n_a", "n_b", "sig_a", "sig_b", "counts_a", "counts_b")).select("a", "b"), docs, width, percent)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link by the full sets of `docs` (doc_id, text)."""
    near = checkpointed(pairs)
    total = near.count()
    near = compact(near)
    sets = checkpointed(node_sets(docs, near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), width))
    if total > BUSY:
        both = with_side(with_side(near, sets, "b", "a"), sets, "a", "b")
    else:  # then no node is in more pairs than that
        both = near.join(sets.toDF("b", "own_b"), "b").join(sets.toDF("a", "own_a"), "a")
    return both.where(_linked(percent)("own_a", "own_b")).select("a", "b")


def with_side(pairs: DataFrame, values: DataFrame, side: str, other: str) -> DataFrame:
    """`pairs` with own_<side>, the value of one side from `values` (node, value); a node that is compared with very many others is copied, so that its pairs spread over tasks."""
    busy = pairs.groupBy(side).agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    held = values.toDF(side, f"own_{side}").join(busy, side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return pairs.join(busy, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts").join(held.drop("salts"), [side, "salt"]).drop("salt")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: documents link whose sets of `width`-word shingles have 100 * shared >= percent * union.

    component_id is the smallest id reachable over links, kept whether it is the row's own.
    Texts without a word (null, empty) link with nothing; so do sets held only by rows whose
    id is null. Rows that share an id count as one document where they link. Columns other
    than the id and the text play no part.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    radius = tail_radius(1 - percent / 100)
    sketched = checkpointed(spread(docs, F.col("text"), "__m", struct_udf(SKETCH, _sketcher(width))).drop("text"))
    classes = checkpointed(
        sketched.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).where("node is not null")
    )
    keyed = classes.select("node", F.posexplode(_keys_udf(radius)("signature")).alias("slot", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = checkpointed(keyed.join(shared, "key"))

    facts = checkpointed(node_facts(docs, classes, groups.select("node").distinct(), width))
    # a node's smallest first of all its keys will do here: what it doesn't link with is compared below
    tried = compact(checkpointed(groups.where("node <> first").groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b")))
    links = checkpointed(confirmed(tried, facts, docs, width, percent, radius))
    labels = components(links)
    for step in ("leaders", "all"):
        tidied(df.sparkSession)
        held = groups.select("key", "slot", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        torn = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("node", F.struct(F.xxhash64("node", "key"), "node")).alias("lead"), F.count("*").alias("members"))
        held = held.join(torn.where("low <> high").select("key", "lead", "members"), "key")
        if step == "leaders":  # another member of each key is compared with the rest: different keys, different leaders
            held = checkpointed(held.join(facts.select("node", *[p.alias(f"p{k}") for k, p in enumerate(planes("signature"))]), "node"))
            lead = held.where("node = lead").select(*[F.col(c).alias(f"{c}_x") for c in held.columns])
            rest = held.select(*[F.col(c).alias(f"{c}_y") for c in held.columns])
            apart = (F.col("key_x") == F.col("key_y")) & (F.col("component_x") != F.col("component_y")) & (F.bit_count(differing()) <= radius)
            pairs = lead.join(rest, apart).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
        else:
            pairs = torn_pairs(held, facts, lambda group: _group_pairs(group, percent, radius))
        fresh = compact(checkpointed(pairs.join(tried, ["a", "b"], "left_anti")))
        if fresh.limit(1).count():
            more = checkpointed(confirmed(fresh, facts, docs, width, percent, radius))
            tried = tried.unionByName(fresh)
            if more.limit(1).count():
                links = links.unionByName(more)
                labels = components(links)
    named = classes.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return sketched.join(named, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept")
    )


def near_sql(width: int, percent: int, source: str = "documents") -> str:
    """DuckDB SQL for near_duplicates over `source`, by comparing all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') END AS w FROM {source}),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle}) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared.n >= {percent} * (p.n + q.n - shared.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, words.doc_id = component_id AS kept
FROM words JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
