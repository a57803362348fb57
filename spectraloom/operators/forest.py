"""Regression forests that share passes: trees of a fit grown side by side, level by level, with all depths of a grid from one growth.

Rows with the same features are one entry with summed weights, so a tree costs what its distinct rows
cost. Thresholds lie halfway between neighbouring values, as nothing is binned. A node's random choices
come from a hash of its path, so that a tree is the same in any batch, and a shallower tree
is the deeper one's top: what each depth of a grid predicts is noted on the way down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Entries:
    """Distinct rows: `codes` (entries × features) into the sorted values of each feature, and the entry of each row."""

    codes: np.ndarray
    values: list[np.ndarray]
    of_row: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Entries:
        pairs = [np.unique(column, return_inverse=True) for column in x.T]
        codes = np.column_stack([inverse for _, inverse in pairs]) if pairs else np.zeros((len(x), 0), np.int64)
        order = np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(x))
        new = np.r_[True, (codes[order][1:] != codes[order][:-1]).any(axis=1)][: len(x)]
        of_row = np.empty(len(x), np.int64)
        of_row[order] = np.cumsum(new) - 1
        return cls(codes[order][new], [values for values, _ in pairs], of_row)


def grown(train: Entries, stats: np.ndarray, asked: np.ndarray, keys: np.ndarray, depths: list[int | None], leaf: int, choices: int) -> np.ndarray:
    """(depths × trees × asked entries): what trees of each depth (None: no limit) predict.

    `stats` (3 × trees × entries) hold how many rows, their weights and their weighted targets each tree draws of
    each entry; `asked` are the entries to predict. A node is split where that lowers the squared error most
    and leaves `leaf` drawn rows on each side, over the first `choices` features of the node's own order that differ
    in it; of equal splits the first feature's lowest is taken.
    """
    n_trees, p = stats.shape[1], train.codes.shape[1]
    tree, own = np.nonzero(stats[0] > 0)
    drawn, weight, total = (s[tree, own] for s in stats)
    codes = [train.codes[own, f].astype(np.int32) for f in range(p)]
    node, n_nodes = tree, n_trees
    # by feature, the entries by node and value; nodes lie side by side in the order of their numbers
    orders = [np.lexsort((codes[f], node)) for f in range(p)]
    ask_own, ask_node, ask_at = np.tile(np.arange(len(asked)), n_trees), np.repeat(np.arange(n_trees), len(asked)), np.arange(n_trees * len(asked))
    current, key = np.zeros(n_trees * len(asked)), mixed(keys.astype(np.uint64) * _ODD)
    noted: dict[int, np.ndarray] = {}
    for depth in range(len(node) + 1):
        n, w, t = (np.bincount(node, weights=s, minlength=n_nodes) for s in (drawn, weight, total))
        current[ask_at] = (t / w)[ask_node]
        if depth in depths:
            noted[depth] = current.copy()
        if not p or (None not in depths and depth >= max(depths)):
            break
        sizes = np.bincount(node, minlength=n_nodes)
        ends = np.cumsum(sizes)
        starts, of = ends - sizes, np.repeat(np.arange(n_nodes), sizes)
        differs = np.array([codes[f][orders[f][starts]] != codes[f][orders[f][ends - 1]] for f in range(p)])
        tried = differs
        if choices < p:
            turn = mixed(key[None, :] ^ (np.arange(1, p + 1, dtype=np.uint64) * _ODD)[:, None])
            turn[~differs] = np.uint64(0xFFFFFFFFFFFFFFFF)
            tried = differs & (np.argsort(np.argsort(turn, axis=0, kind="stable"), axis=0) < choices)
        scale = t * t / w
        slack = 1e-10 * np.maximum(scale, 1e-300)
        best, feature, low = np.zeros(n_nodes), np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
        for f in range(p):
            here = tried[f][of]
            order, o = orders[f][here], of[here]
            code = codes[f][order]
            cut = np.flatnonzero((o[1:] == o[:-1]) & (code[1:] != code[:-1]))
            if not len(cut):
                continue
            first = np.cumsum(np.where(tried[f], sizes, 0)) - sizes  # where a tried node begins
            o = o[cut]

            def left(s: np.ndarray, order=order, first=first, o=o, cut=cut) -> np.ndarray:
                sums = np.concatenate([[0.0], np.cumsum(s[order])])
                return sums[cut + 1] - sums[first[o]]

            lw, lt = left(weight), left(total)
            gain = lt * lt / lw + (t[o] - lt) ** 2 / (w[o] - lw) - scale[o]
            if leaf > 1:
                ln = left(drawn)
                gain[(ln < leaf) | (n[o] - ln < leaf)] = -1
            at = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            most = np.maximum.reduceat(gain, at)
            tops = np.flatnonzero(gain >= np.repeat(most - slack[o[at]], np.diff(np.r_[at, len(o)])))[::-1]
            places = np.zeros(n_nodes, np.int64)
            places[o[tops]] = order[cut[tops]]  # the lowest of equal ones is written last
            better = np.flatnonzero(most > best[o[at]] + slack[o[at]])
            won = o[at][better]
            best[won], feature[won], low[won] = most[better], f, places[won]
        goes = best > 0
        if not goes.any():
            break
        split, above = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        middle = np.zeros(n_nodes)
        for f in range(p):
            here = np.flatnonzero(feature == f)
            split[here] = codes[f][low[here]]
            # the next value that the node holds
            more = np.where(codes[f][orders[f]] > split[of], codes[f][orders[f]], np.iinfo(np.int32).max)
            above[here] = np.minimum.reduceat(more, starts)[here]
            a, b = train.values[f][split[here]], train.values[f][above[here]]
            middle[here] = a + (b - a) / 2
        # nodes that split go on; their children are numbered in order
        number = np.cumsum(goes) - 1
        stays = goes[node]
        right = np.zeros(len(node), bool)
        for f in range(p):
            right |= (feature[node] == f) & (codes[f] > split[node])
        child = 2 * number[node] + right
        moved = np.cumsum(stays) - 1
        small = np.uint16 if 2 * goes.sum() < 1 << 16 else np.int64  # short numbers are sorted by radix
        for f in range(p):
            order = orders[f][stays[orders[f]]]
            orders[f] = moved[order[np.argsort(child[order].astype(small), kind="stable")]]
        codes = [c[stays] for c in codes]
        node, drawn, weight, total = child[stays], drawn[stays], weight[stays], total[stays]
        on = goes[ask_node]
        ask_own, ask_node, ask_at = ask_own[on], ask_node[on], ask_at[on]
        ask_node = 2 * number[ask_node] + (asked[ask_own, feature[ask_node]] > middle[ask_node])
        key = mixed(np.repeat(key[goes], 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), int(goes.sum())) + _ODD)
        n_nodes = 2 * int(goes.sum())
    return np.stack([noted.get(-1 if d is None else d, current) for d in depths]).reshape(len(depths), n_trees, len(asked))


#: Entries of trees that are grown side by side.
TOGETHER = 1 << 16


def predicted(x: np.ndarray, y: np.ndarray, asked: np.ndarray, seeds: list[int], depths: list[int | None], leaf: int, choices: int, bootstrap: bool = True) -> np.ndarray:
    """(depths × asked rows): the sum over trees of what each predicts, trained on the rows x, y; one tree for each seed.

    A tree draws as many rows as there are, with replacement; without `bootstrap` each once. Rows must come in an order that doesn't depend on partitions.
    """
    base = y.mean()
    y = y - base
    entries = Entries.of(x)
    different, of_asked = np.unique(asked, axis=0, return_inverse=True)
    n = len(entries.codes)
    out = np.zeros((len(depths), len(different)))
    together = max(1, TOGETHER // max(n, 1))
    for low in range(0, len(seeds), together):
        part = seeds[low : low + together]
        stats = np.empty((3, len(part), n))
        for t, seed in enumerate(part):
            times = np.bincount(np.random.default_rng(seed).integers(0, len(y), len(y)), minlength=len(y)).astype(float) if bootstrap else np.ones(len(y))
            for s, weights in zip(stats, ((times > 0).astype(float), times, times * y), strict=True):
                s[t] = np.bincount(entries.of_row, weights=weights, minlength=n)
        out += grown(entries, stats, different, np.array(part), depths, leaf, choices).sum(axis=1)
    return out[:, of_asked.ravel()] + len(seeds) * base


#: Values (rows × columns) that one task takes, and rows × trees of a task.
MOST_VALUES, TASK_ROWS = 1 << 24, 1 << 24
#: A depth from which on a grid's entry stands for no limit.
UNLIMITED = 30


def _seed(*parts: int) -> int:
    out = 0
    for part in parts:
        out = (out * 1_000_003 + part + 1) % (1 << 63)
    return out


def fitted(rows: DataFrame, fits: list[tuple[int, int]], features: list[str], gaps: list[str], n: int, leaves: dict[tuple[int, int], list[int]], depths: dict[tuple[int, int], list[int]], trees: int, choices: int | None, seed: int, bootstrap: bool = True) -> DataFrame:
    """(outer, inner, leaf, row, p_0 …): what the forests of each fit predict for the rows it holds out, a column for each of the fit's depths.

    `rows` (outer, fold, inner, row, y, x) hold each row once for each outer fold; a fit (outer, inner) trains on the rows of other
    folds and inner folds, or of all inner folds where it is -1. A task takes some trees of one fit with that fit's rows, at most
    `n` of them; the sums of its trees are added up by Spark.
    """
    batches = max(1, -(-trees * n // TASK_ROWS))
    jobs = [(o, j, leaf, b) for o, j in fits for leaf in leaves[o, j] for b in range(batches)]
    most = max(len(d) for d in depths.values())
    plan = rows.sparkSession.createDataFrame([(i, o, j) for i, (o, j, _, _) in enumerate(jobs)], "job int, outer int, of_inner int")
    dealt = rows.join(F.broadcast(plan), "outer").where((F.col("of_inner") < 0) | (F.col("fold") != F.col("outer")))
    held_out = F.when(F.col("of_inner") < 0, F.col("fold") == F.col("outer")).otherwise(F.col("inner") == F.col("of_inner"))
    dealt = dealt.select("job", "row", "x", "y", held_out.alias("held_out")).repartition(min(4 * len(jobs), 4096), "job")
    places = [features.index(c) for c in gaps]

    def run(group: pa.Table) -> pa.Table:
        outer, inner, leaf, batch = jobs[group.column("job")[0].as_py()]
        x = np.array(group.column("x").to_pylist(), float).reshape(group.num_rows, len(features))
        y, row, held = (group.column(c).to_numpy() for c in ("y", "row", "held_out"))
        order = np.lexsort((*x.T, y))  # whatever order they came in
        x, y, row, held = x[order], y[order], row[order], held[order]
        missing = np.isnan(x)
        x = np.where(missing, np.nanmedian(x[~held], axis=0)[None, :], x) if missing.any() else x
        x = np.column_stack([x, missing[:, places].astype(float)])
        seeds = [_seed(seed, outer, inner, t) for t in range(batch, trees, batches)]
        limits = [None if d >= UNLIMITED else d for d in depths[outer, inner]]
        number = choices or x.shape[1]
        sums = predicted(x[~held], y[~held], x[held], seeds, limits, leaf, min(number, x.shape[1]), bootstrap) if held.any() else np.zeros((len(limits), 0))
        same = lambda v: pa.array(np.full(held.sum(), v, np.int32))
        columns = {"outer": same(outer), "inner": same(inner), "leaf": same(leaf), "row": pa.array(row[held])}
        return pa.table(columns | {f"p_{k}": pa.array(sums[k] if k < len(limits) else np.zeros(held.sum())) for k in range(most)})

    made = dealt.groupBy("job").applyInArrow(run, "outer int, inner int, leaf int, row bigint, " + ", ".join(f"p_{k} double" for k in range(most)))
    return made.groupBy("outer", "inner", "leaf", "row").agg(*[(F.sum(f"p_{k}") / trees).alias(f"p_{k}") for k in range(most)])


#: Rows × trees from which sums by cell, distinct row of features and tree stand for the rows, and how many cells × distinct rows there may be.
SUMMED_FROM, MOST_SUMS = 1 << 27, 1 << 18
#: Sums (cells × distinct rows × trees) of a task that grows trees, at most; its trees for all fits are one of BATCHES, at least.
TASK_SUMS, BATCHES = 1 << 22, 24
#: How often a row is drawn, by 16 random bits: Poisson's law with mean 1.
TIMES = np.searchsorted(np.rint(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]) * 65536), np.arange(65536), side="right").astype(np.uint8)


def times(keys: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows × trees): how often each tree draws the rows of these keys, whatever rows stand beside them."""
    salts = mixed((np.arange(1, -(-trees // 4) + 1, dtype=np.uint64) + np.uint64(seed % (1 << 63))) * _ODD)
    return TIMES[mixed(keys[:, None] ^ salts).view(np.uint16)][:, :trees]


def batches_of(trees: int, sums: int) -> int:
    return min(trees, max(BATCHES, -(-sums * trees // TASK_SUMS)))


def tree_sums(rows: DataFrame, trees: int, batches: int, seed: int, bootstrap: bool = True, together: int = 512) -> DataFrame:
    """(batch, cell, entry, rows, times, total): of rows (cell, entry, key, y), what each tree of a batch draws of each cell and entry: different rows, rows with repeats, the sum of their targets.

    Rows go by ranges of (cell, entry, key), so that no entry is one task's. An entry that spans ranges comes in parts. Equal rows are drawn independently.
    """
    own = [np.arange(b, trees, batches) for b in range(batches)]
    schema = pa.schema([("batch", pa.int32()), ("cell", pa.binary()), ("entry", pa.binary()), ("rows", pa.binary()), ("times", pa.binary()), ("total", pa.binary())])

    def made(held: list[tuple]) -> pa.RecordBatch:
        cell, entry = (np.array([h[i] for h in held], np.int32).tobytes() for i in (0, 1))
        drawn, counts, totals = (np.stack([h[i] for h in held]) for i in (2, 3, 4))
        drawn, counts = (v.astype(np.min_scalar_type(int(v.max()))) for v in (drawn, counts))
        parts = [[b, cell, entry, drawn[:, t].tobytes(), counts[:, t].tobytes(), totals[:, t].tobytes()] for b, t in enumerate(own)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last may go on
        last, repeat = None, 0
        for part in parts:
            for low in range(0, part.num_rows, 4096):
                cell, entry, key, y = (c.to_numpy() for c in part.slice(low, 4096).columns)
                new = np.r_[True, (key[1:] != key[:-1]) | (entry[1:] != entry[:-1]) | (cell[1:] != cell[:-1])]
                first = np.flatnonzero(new)
                place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
                if last == (cell[0], entry[0], key[0]):
                    place[: first[1] if len(first) > 1 else len(key)] += repeat
                last, repeat = (cell[-1], entry[-1], key[-1]), place[-1] + 1
                drawn = times(key.view(np.uint64) + place.astype(np.uint64) * _ODD, trees, seed) if bootstrap else np.ones((len(key), trees), np.uint8)
                cuts = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (cell[1:] != cell[:-1])])
                sums = [np.add.reduceat(drawn > 0, cuts, axis=0, dtype=np.int64), np.add.reduceat(drawn, cuts, axis=0, dtype=np.int64), np.add.reduceat(drawn * y[:, None], cuts, axis=0)]
                for i, at in enumerate(cuts):
                    if held and held[-1][:2] == (cell[at], entry[at]):
                        held[-1] = (*held[-1][:2], *(a + s[i] for a, s in zip(held[-1][2:], sums, strict=True)))
                        continue
                    if len(held) >= together:
                        yield made(held)
                        held = []
                    held.append((cell[at], entry[at], *(s[i] for s in sums)))
        if held:
            yield made(held)

    ranged = rows.select("cell", "entry", "key", "y").repartitionByRange("cell", "entry", "key").sortWithinPartitions("cell", "entry", "key")
    return ranged.mapInArrow(run, "batch int, cell binary, entry binary, rows binary, times binary, total binary")


def unpacked(row: dict, trees: int) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """The (cells, entries) of a row of tree_sums, and for them by its batch's trees: rows, times and totals. Counts have as few bytes as they need."""
    at = tuple(np.frombuffer(row[c], np.int32) for c in ("cell", "entry"))
    counts = [np.frombuffer(row[c], f"u{len(row[c]) // (len(at[0]) * trees)}") for c in ("rows", "times")]
    return at, [v.reshape(-1, trees) for v in (*counts, np.frombuffer(row["total"], np.float64))]


def fitted_by_sums(sums: DataFrame, filled: list[np.ndarray], train: list[list[int]], fits: list[tuple[int, int]], cells: int, leaves: list[int], depths: list[int], trees: int, batches: int, choices: int | None, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """By (place of a fit, leaf), what its forest predicts for each entry, by depth (depths × entries): from tree_sums, the cells that each fit trains on and the entries' features as it fills them."""
    n = len(filled[0])
    limits = [None if d >= UNLIMITED else d for d in depths]

    def run(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        own = list(range(batch, trees, batches))
        held = np.zeros((3, cells, n, len(own)))
        for r in sorted(group.drop_columns(["batch"]).to_pylist(), key=lambda r: (r["cell"], r["entry"], r["total"])):  # sums don't hang on the order in which parts came
            at, values = unpacked(r, len(own))
            for h, v in zip(held, values, strict=True):
                h[at] += v
        out = []
        for i, (outer, inner) in enumerate(fits):
            entries = Entries.of(filled[i])
            stats = np.zeros((3, len(own), n))
            stats[:, :, entries.of_row] = held[:, train[i]].sum(axis=1).transpose(0, 2, 1)
            keys = np.array([_seed(seed, outer, inner, t) for t in own])
            together = max(1, TOGETHER // n)
            for leaf in leaves:
                made = sum(grown(entries, stats[:, low : low + together], filled[i], keys[low : low + together], limits, leaf, min(choices or filled[i].shape[1], filled[i].shape[1])).sum(axis=1) for low in range(0, len(own), together))
                out.append((i, leaf, made.tobytes()))
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], pa.schema([("fit", pa.int32()), ("leaf", pa.int32()), ("p", pa.binary())]))

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.float64) for p in sorted(group.column("p").to_pylist()))
        return pa.table([group.column("fit")[:1], group.column("leaf")[:1], pa.array([total.tobytes()])], pa.schema([("fit", pa.int32()), ("leaf", pa.int32()), ("p", pa.binary())]))

    kind = "fit int, leaf int, p binary"
    parts = sums.repartition(8 * batches, "batch").groupBy("batch").applyInArrow(run, kind)
    return {(r["fit"], r["leaf"]): np.frombuffer(r["p"], np.float64).reshape(len(depths), n) / trees for r in parts.groupBy("fit", "leaf").applyInArrow(added, kind).collect()}
