"""Jaccard join of word n-grams by prefixes under several global orders.

Two sets as similar as asked share a token among the first |x| - ceil(t |x|) + 1 of each, under any order
of all tokens. Three orders are used. The first puts what is rare first, by counts over all documents, and what it orders is cells: the
tokens' hashes are cut into more intervals than such sets differ in tokens, so that with at most d differing tokens all but d cells have
the same tokens in both, and the first d + 1 cells of each share one. These are the keys of the join, by bands of set sizes. As a cell
has several tokens, documents that only have single tokens in common share no key, however many documents there are
and however little their counts tell. The others are hash orders of tokens: a pair that shares a key must share a token
of its prefixes under each of them too, and its sizes and a bound on the sets' difference must leave it a
chance, before full sets are fetched to confirm it. No pair that links fails any of these tests.

Pairs inside a key aren't all made: each document is first compared with the most central of those that it shares
a key with (the one whose rarest token is most common: an original rather than an edited copy), then with another
member. Linked ones need no more comparison, and only members of a key that are still in different components are
compared with each other, in blocks and in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm import minhash
from spectraloom.llm.minhash import components, only_ids, shingle_sets, torn_pairs, verified, with_side
from spectraloom.llm.textbatch import mixed, small_batches, spread, steps, struct_udf
from spectraloom.session import checkpointed, compact, tidied

#: Buckets that tokens are counted in, whatever the input: 4 MB a task, of which each order knows a level of one byte. Slots are summed apart, FAN_IN tasks at a time.
BUCKETS, SLOTS, FAN_IN = 1 << 20, 64, 64
#: Bits below the level in a token's or cell's place of the first order.
LEVEL = 57
#: A band of sizes reaches from one size to that of a set that is so many times as large as can link, one after the other: wide bands put few sets in two of them.
BAND = 8
#: From this percentage on cells are the keys; below, sets that link may differ in so many tokens that a cell has hardly more than one, and tokens are.
CELLS_FROM = 75
SECOND, THIRD = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
#: Buckets of a set's profile: a power of two.
PROFILE = 128

SKETCH = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("rarest", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    + [T.StructField(name, T.BinaryType()) for name in ("second", "third", "profile")]
)


def prefix_length(n: int, percent: int) -> int:
    """Of a set of n tokens, how many first ones hold a token of any set as similar as asked."""
    return n - -(-percent * n // 100) + 1


def token_levels(docs: DataFrame, width: int) -> np.ndarray:
    """By bucket of tokens: the binary logarithm of how many documents of `docs` (text) hold them, over all documents."""

    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in steps(batch.column(0)):
                for s in shingle_sets(part, width):
                    np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([c.tobytes() for c in np.split(total, SLOTS)])], ["slot", "n"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n, np.uint32).astype(np.uint64) for n in group.column("n").to_pylist())
        return pa.table({"slot": group.column("slot").slice(0, 1), "n": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], "part": group.column("part").slice(0, 1)})

    counts = docs.select("text").mapInArrow(count, "slot int, n binary").withColumn("part", F.spark_partition_id().cast("bigint"))
    for many in (FAN_IN, FAN_IN, None):  # a group has as many rows as FAN_IN tasks; the last, one of FAN_IN * FAN_IN tasks
        part = F.floor(F.col("part") / many) if many else F.lit(0).cast("bigint")
        counts = counts.withColumn("part", part).groupBy("slot", "part").applyInArrow(summed, "slot int, n binary, part bigint")
    held = {r.slot: np.frombuffer(r.n, np.uint32) for r in counts.collect()}
    each = np.concatenate([held.get(i, np.zeros(BUCKETS // SLOTS, np.uint32)) for i in range(SLOTS)])
    return np.ceil(np.log2(each + 1.0)).astype(np.uint8)


def rare_first(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Each token's place in the first order, as a positive 64-bit number that also stands for it."""
    level = levels[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(LEVEL)) | (mixed(tokens) >> np.uint64(64 - LEVEL))


def _first(places: np.ndarray, n: int) -> np.ndarray:
    return np.sort(np.partition(places, n - 1)[:n])


def most_differing(n: int, m: int, percent: int) -> int:
    """The most tokens that sets of n and m tokens which link can differ in, those of either that the other lacks."""
    return (n + m) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """The bands of a set of n tokens, as (band, largest size in it): its own, and up to that of the largest set it can link with. So two sets that link share the band of the larger."""
    if percent == 100:
        return [(n, n)]
    width = BAND * math.log(100 / percent)
    # a little beyond the bounds, against rounding
    return [(b, int(math.exp((b + 1) * width) * 1.000001)) for b in range(int(math.log(n) / width), int(math.log(n * 100.000001 / percent) / width) + 1)]


def cell_keys(places: np.ndarray, tokens: np.ndarray, percent: int, top: int) -> np.ndarray:
    """The keys of a set of sorted tokens by their places in the first order: in each band its first cells under that order, the rarest.

    `top` is the highest level of all tokens. A cell is as rare as all its tokens together, as far as six bits tell.
    """
    n = len(tokens)
    if percent < CELLS_FROM:
        first = _first(places, prefix_length(n, percent))
        return np.concatenate([mixed(first ^ mixed(np.array([band], np.uint64))) for band, _ in bands(n, percent)])
    names, rarity = mixed(places), np.int64(top + 1) - (places >> np.uint64(LEVEL)).astype(np.int64)
    out = []
    for band, largest in bands(n, percent):
        most = most_differing(largest, largest, percent)
        cells = most + 1 + -(-most // 4)
        cell = ((tokens >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        # a cell without a token is one too, the last of all
        level, name = np.full(cells, 63, np.uint64), np.zeros(cells, np.uint64)
        held = cell[starts].astype(np.int64)
        level[held] = 63 - np.minimum(np.add.reduceat(rarity, starts), 63)
        name[held] = np.add.reduceat(names, starts)
        which = mixed((np.uint64(band) << np.uint64(32)) + np.arange(cells, dtype=np.uint64))
        order = (level << np.uint64(LEVEL)) | (mixed(name + which) >> np.uint64(64 - LEVEL))
        out.append(_first(order, most_differing(n, min(largest, 100 * n // percent), percent) + 1))
    return np.concatenate(out)


def short(places: np.ndarray) -> bytes:
    """Places of a hash order by their upper 16 bits: tokens that share them count as one, which only weakens the test."""
    return (places >> np.uint64(48)).astype(np.uint16).tobytes()


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of PROFILE buckets, a byte each; 255 stands for all from 255 on. Two sets differ in at least as many shingles as their profiles do in sum."""
    return np.minimum(np.bincount((shingles >> np.uint64(64 - PROFILE.bit_length() + 1)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n, m and profiles x, y (a row each) can be near: their difference is no smaller than the profiles'."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def _sketcher(width: int, percent: int, levels: np.ndarray):
    top = int(levels.max())

    def work(texts: pa.Array) -> list:
        sets = shingle_sets(texts, width)
        rows = []
        for s in sets:
            if not len(s):
                rows.append((None,) * 6)
                continue
            n = prefix_length(len(s), percent)
            others = [short(_first(mixed(s ^ seed), n)) for seed in (SECOND, THIRD)]
            set_id = mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ SECOND).sum(dtype=np.uint64).tobytes()
            places = rare_first(s, levels)
            rows.append((set_id, int(places.min() >> np.uint64(LEVEL)), cell_keys(places, s, percent, top).view(np.int64), *others, profile(s)))
        return [[len(s) for s in sets], *map(list, zip(*rows, strict=True))] if rows else [[]] * 7

    return struct_udf(SKETCH, work)


def unpacked(profiles: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(profiles.to_pylist()), np.uint8).reshape(-1, PROFILE)


def _may_link(percent: int):
    """Whether two nodes are near by their sizes and profiles and by their prefixes under both hash orders."""

    def near(n_a, n_b, second_a, second_b, third_a, third_b, profile_a, profile_b):
        n, m = n_a.to_numpy(), n_b.to_numpy()
        out = may_link(n, m, *(unpacked(c) for c in (profile_a, profile_b)), percent)
        for x, y in ((second_a, second_b), (third_a, third_b)):
            for i in np.flatnonzero(out).tolist():
                out[i] = len(np.intersect1d(*(np.frombuffer(p[i].as_py(), np.uint16) for p in (x, y)))) > 0
        return pa.array(out)

    names = [f"{c}_{side}" for c in ("n", "second", "third", "profile") for side in "ab"]
    near.__annotations__ = {**dict.fromkeys(names, pa.Array), "return": pa.Array}
    return F.arrow_udf(near, "boolean")


def block_pairs(group: pa.Table, percent: int) -> pa.RecordBatch:
    """The pairs of one key's block pair that may link by their sizes and profiles."""
    get = lambda name: group.column(name).to_numpy()
    node, component, size, own = get("node"), get("component"), get("n_shingles"), get("own")
    profiles = np.frombuffer(b"".join(group.column("profile").to_pylist()), np.uint8).reshape(len(node), -1)
    across = group.column("low")[0] != group.column("high")[0]
    out = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(node), 64):
        rows = slice(at, at + 64)
        may = (component[rows, None] != component[None, :]) & (node[rows, None] < node[None, :])
        if across:
            may &= own[rows, None] != own[None, :]
        may &= 100 * np.minimum(size[rows, None], size[None, :]) >= percent * np.maximum(size[rows, None], size[None, :])
        i, j = np.nonzero(may)
        i += at
        for part in range(0, len(i), 1 << 13):
            p, q = i[part : part + (1 << 13)], j[part : part + (1 << 13)]
            near = may_link(size[p], size[q], profiles[p], profiles[q], percent)
            out.append(np.column_stack([node[p[near]], node[q[near]]]))
    pairs = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def node_facts(sketched: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, n_shingles, second, third, profile) of the needed nodes."""
    columns = ("n_shingles", "second", "third", "profile")
    held = only_ids(sketched.select("doc_id", *columns), "doc_id", needed).withColumnRenamed("doc_id", "node")
    return held.join(needed, "node", "left_semi").where("second is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in columns])


#: Pairs from which on a node in very many of them is copied, so that they spread over tasks.
CROWDED = 200_000


def tested(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a checkpointed table, that pass all tests by their facts."""
    packed = facts.select("node", F.struct("n_shingles", "second", "third", "profile").alias("fact"))
    if pairs.count() > CROWDED:
        both = with_side(with_side(pairs, packed, "b", "a"), packed, "a", "b")
    else:
        both = pairs.join(packed.toDF("b", "own_b"), "b").join(packed.toDF("a", "own_a"), "a")
    sides = [f"own_{side}.{c}" for c in ("n_shingles", "second", "third", "profile") for side in "ab"]
    return both.where(_may_link(percent)(*sides)).select("a", "b")


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link whose sets of `width`-word shingles have 100 * shared >= percent * union.

    component_id is the smallest id reachable over links, the row's own included; ids are whole numbers. Of fewer words than
    `width`, the whole sequence is the one shingle. Texts without a word (null, empty) link with nothing; so do sets held only
    by rows whose id is null. Rows that share an id count as one document where they link. Columns other than the id and the text play no part.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketched = checkpointed(spread(docs, F.col("text"), "__m", _sketcher(width, percent, token_levels(docs, width))).drop("text"))
    facts_of_set = [F.first(c).alias(name) for c, name in (("n_shingles", "size"), ("rarest", "rarest"), ("keys", "keys"))]
    classes = checkpointed(sketched.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), *facts_of_set).where("node is not null"))
    keyed = classes.select("node", "size", "rarest", F.explode("keys").alias("key"))
    held_twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = checkpointed(keyed.join(held_twice, "key"))
    central = shared.groupBy("key").agg(F.max(F.struct("rarest", -F.col("node"), "node", "size")).alias("central"))
    groups = checkpointed(shared.drop("rarest").join(central, "key"))
    facts = checkpointed(node_facts(sketched, groups.select("node").distinct()))

    tidied(df.sparkSession)

    near = lambda other: 100 * F.least("size", other) >= percent * F.greatest("size", other)
    pair = lambda other: (F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))
    # a node is compared with the most central of all that it shares a key with; what it doesn't link with is compared below
    most = groups.where(near("central.size")).groupBy("node").agg(F.max("central").alias("central")).where("node <> central.node")
    tried = compact(checkpointed(most.select(*pair("central.node")).distinct()))
    links = checkpointed(verified(tested(tried, facts, percent), docs, width, percent))
    labels = components(links)
    for step in ("leaders", "all"):
        tidied(df.sparkSession)
        held = groups.select("key", "node", "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lead = F.min_by(F.struct("node", "component", "size"), F.struct(F.xxhash64("node", "key"), "node"))
        torn = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), lead.alias("lead"), F.count("*").alias("members"))
        held = held.join(torn.where("low <> high").select("key", "lead", "members"), "key")
        if step == "leaders":  # another member of its largest key that is still apart
            apart = held.where((F.col("component") != F.col("lead.component")) & near("lead.size")).groupBy("node").agg(F.max(F.struct("members", "lead")).alias("m"))
            pairs = apart.select("node", F.col("m.lead.node").alias("lead")).select(*pair("lead")).distinct().join(tried, ["a", "b"], "left_anti")
            pairs = compact(checkpointed(pairs))
            fresh, tried = tested(pairs, facts, percent), tried.unionByName(pairs)
        else:
            light = facts.select("node", "n_shingles", "profile")
            pairs = torn_pairs(held.withColumn("slot", F.lit(0)), light, lambda group: block_pairs(group, percent)).join(tried, ["a", "b"], "left_anti")
            fresh = tested(compact(checkpointed(pairs)), facts, percent)
        fresh = checkpointed(fresh)
        tidied(df.sparkSession)
        if not fresh.limit(1).count():
            continue
        more = checkpointed(verified(fresh, docs, width, percent))
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links)
    named = classes.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return sketched.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def groups_sql(width: int, percent: int, source: str = "documents") -> str:
    """DuckDB SQL for jaccard_groups over `source`."""
    return f"SELECT doc_id, n_shingles, component_id FROM ({minhash.near_sql(width, percent, source)})"
