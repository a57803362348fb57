"""Linear models over a categorical of any number of levels, whose one-hot columns are never made.

The levels of one categorical exclude each other, so that given the other weights each level's weight is a closed
expression of sums over its rows. These sums, by level and cell, are made once; rows aren't read again. A pass over them eliminates
the levels from the normal equations (a Schur complement, over the levels that an L1 penalty leaves active), the few
remaining weights are solved for on the driver, and passes go on until the active levels stay as they are.
One pass does for ridge. What reaches the driver depends on fits, candidates and the other columns, not on levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a pass returns from each task at most; more candidates take more passes.
MOST_SUMS = 1 << 21
ROUNDS = 100


def level_sums(rows: DataFrame, width: int, cells: int) -> DataFrame:
    """(level, s): for each level of `rows` (level, cell, x, y), the sums of x and y by cell, one after another. Levels are summed before they are shuffled."""
    sums = [F.sum(F.col("x")[i]).alias(f"s_{i}") for i in range(width)] + [F.sum("y").alias(f"s_{width}")]
    each = rows.groupBy("level", "cell").agg(*sums).select("level", F.struct("cell", F.array(*[f"s_{i}" for i in range(width + 1)]).alias("s")).alias("c"))
    by_cell = each.groupBy("level").agg(F.map_from_entries(F.collect_list("c")).alias("m"))  # one entry a cell
    none = F.array(*[F.lit(0.0)] * (width + 1))
    return by_cell.select("level", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none))).alias("s"))


class Fit:
    """One fit of one feature set: its training cells, the map to prepared columns, the normal equations and each candidate's penalties."""

    def __init__(self, cells: list[int], to: np.ndarray, gram: np.ndarray, grid: list[tuple[str, float, float]]):
        self.cells, self.to, self.n = cells, to, gram[0, 0]
        self.normal = to @ gram @ to.T / self.n
        self.first = np.array([0.0 if kind == "ridge" else a * r for kind, a, r in grid])
        self.second = np.array([a / self.n if kind == "ridge" else a * (1 - r) for kind, a, r in grid])

    def prepared(self, sums: np.ndarray) -> np.ndarray:
        """Sums (levels × cells × raw columns and target) over training rows, as prepared columns: rows, columns, target."""
        return sums[:, self.cells].sum(axis=1) @ self.to.T

    def rest(self, own: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """(levels × candidates): what the other weights leave of each level's target."""
        return (own[:, -1:] - own[:, :-1] @ beta.T) / self.n

    def eliminated(self, own: np.ndarray, beta: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the active levels take off the normal equations of the candidates `at`: (candidates × columns × columns), (candidates × columns)."""
        rest = self.rest(own, beta)
        weight = (np.abs(rest) > self.first[at]) / np.maximum(own[:, :1] / self.n + self.second[at], 1e-300)
        a = own[:, :-1] / self.n
        target = weight * (own[:, -1:] / self.n - np.sign(rest) * self.first[at])
        return np.stack([(a * w[:, None]).T @ a for w in weight.T]), target.T @ a

    def value(self, own: np.ndarray, beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By candidate, the levels' part of what is minimised, with their weights at their best."""
        left = np.maximum(np.abs(self.rest(own, beta)) - self.first[at], 0)
        return -(left * left / np.maximum(own[:, :1] / self.n + self.second[at], 1e-300)).sum(axis=0) / 2

    def others(self, beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By candidate, the rest of what is minimised."""
        w = beta[:, 1:]
        smooth = np.einsum("cp,pq,cq->c", beta, self.normal[:-1, :-1], beta) / 2 - beta @ self.normal[:-1, -1]
        return smooth + self.first[at] * np.abs(w).sum(axis=1) + self.second[at] * (w * w).sum(axis=1) / 2

    def levels(self, own: np.ndarray, beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(levels × candidates): the levels' weights."""
        rest = self.rest(own, beta)
        return np.sign(rest) * np.maximum(np.abs(rest) - self.first[at], 0) / np.maximum(own[:, :1] / self.n + self.second[at], 1e-300)


def _descent(h: np.ndarray, g: np.ndarray, first: float, second: float, start: np.ndarray) -> np.ndarray:
    """The free intercept and the weights that minimise half their quadratic form less g, with both penalties: coordinate descent."""
    centre = h[0, 1:] / h[0, 0]
    a, b = h[1:, 1:] - np.outer(h[0, 1:], centre), g[1:] - g[0] * centre
    if not first:  # a solve, not a descent
        w = np.linalg.lstsq(a + np.eye(len(b)) * (second + 1e-15), b, rcond=None)[0] if len(b) else b
    else:
        w = start[1:].copy()
        for _ in range(2000):
            old = w.copy()
            for j in range(len(b)):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - first, 0) / max(a[j, j] + second, 1e-300)
            if np.abs(w - old).max(initial=0) < 1e-12:
                break
    return np.concatenate([[(g[0] - h[0, 1:] @ w) / h[0, 0]], w])


#: Rounds of full steps; later ones take the best of these shares of a step, as full ones may go round in circles.
FULL, SHARES = 6, 0.5 ** np.arange(10)


def solved(sums: DataFrame, fits: list[Fit], grid: list[tuple[str, float, float]], size: int, cells: int) -> list[np.ndarray]:
    """For each fit the weights (candidates × prepared columns, the intercept first) of all columns but the levels'. `sums` as of level_sums(), `size` the numbers of a cell."""
    out = [np.zeros((len(grid), len(f.to) - 1)) for f in fits]
    todo = [(i, c) for i in range(len(fits)) for c in range(len(grid))]
    for round_ in range(ROUNDS):
        moved = []
        for part in _parts(todo, fits):
            by_fit: dict[int, np.ndarray] = {}
            for i, c in part:
                by_fit[i] = np.append(by_fit.get(i, np.zeros(0, int)), c)
            eliminate = lambda fit, own, beta, at: np.concatenate([v.reshape(len(at), -1) for v in fit.eliminated(own, beta, at)], axis=1)
            taken = _pass(sums, {i: (fits[i], out[i][cs], cs) for i, cs in by_fit.items()}, eliminate, size, cells)
            steps = {}
            for i, cs in by_fit.items():
                p = len(fits[i].to) - 1
                t = taken[i].reshape(len(cs), -1)
                normal = fits[i].normal
                new = [_descent(normal[:-1, :-1] - v[: p * p].reshape(p, p), normal[:-1, -1] - v[p * p :], fits[i].first[c], fits[i].second[c], out[i][c]) for c, v in zip(cs, t, strict=True)]
                steps[i] = np.array(new) - out[i][cs]
            if round_ >= FULL:
                steps = _best_shares(sums, fits, out, by_fit, steps, size, cells)
            for i, cs in by_fit.items():
                out[i][cs] += steps[i]
                far = np.abs(steps[i]).max(axis=1) > 1e-10 * np.maximum(1.0, np.abs(out[i][cs]).max(axis=1))
                moved += [(i, c) for c in cs[far & (fits[i].first[cs] > 0)].tolist()]
        todo = moved
        if not todo:
            break
    return out


def _best_shares(sums: DataFrame, fits: list[Fit], out: list[np.ndarray], by_fit: dict, steps: dict, size: int, cells: int) -> dict[int, np.ndarray]:
    """Each step cut to the share of it that lowers most what is minimised, or to nothing."""
    shares = np.append(SHARES, 0.0)
    tried = {i: (fits[i], (out[i][cs][:, None] + shares[None, :, None] * steps[i][:, None]).reshape(-1, steps[i].shape[1]), np.repeat(cs, len(shares))) for i, cs in by_fit.items()}
    value = lambda fit, own, beta, at: fit.value(own, beta, at)
    found = _pass(sums, tried, value, size, cells)
    best = {i: (found[i] + fits[i].others(beta, at)).reshape(-1, len(shares)).argmin(axis=1) for i, (_, beta, at) in tried.items()}
    return {i: step * shares[best[i]][:, None] for i, step in steps.items()}


def _parts(todo: list[tuple[int, int]], fits: list[Fit]) -> Iterator[list[tuple[int, int]]]:
    part, size = [], 0
    for i, c in todo:
        own = len(fits[i].to) ** 2
        if part and size + own > MOST_SUMS:
            yield part
            part, size = [], 0
        part.append((i, c))
        size += own
    if part:
        yield part


def _pass(sums: DataFrame, tried: dict[int, tuple[Fit, np.ndarray, np.ndarray]], make, size: int, cells: int) -> dict[int, np.ndarray]:
    """By fit, the numbers that `make` gives of (fit, prepared sums, weights, candidates), summed over all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            held = batch.column(0).flatten().to_numpy().reshape(-1, cells, size)
            for i, (fit, beta, at) in tried.items():
                total[i] = total.get(i, 0) + make(fit, fit.prepared(held), beta, at).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["fit", "v"])

    partial = sums.select("s").mapInArrow(run, "fit int, v array<double>")
    out: dict[int, dict[int, float]] = {i: {} for i in tried}
    for r in partial.select("fit", F.posexplode("v").alias("at", "v")).groupBy("fit", "at").agg(F.sum("v").alias("v")).collect():
        out[r["fit"]][r["at"]] = r["v"]
    return {i: np.array([v[k] for k in range(len(v))]) for i, v in out.items()}


def level_weights(fit: Fit, beta: np.ndarray, held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows × candidates): the weight of each row's level, from its sums (rows × cells × numbers of a cell)."""
    return fit.levels(fit.prepared(held), beta, at)


def added(chosen: dict[int, list[tuple[Fit, np.ndarray, np.ndarray] | None]], size: int, cells: int):
    """An Arrow UDF of (fold, s): for each set what the level adds to the prediction of a fold's model; 0 where the set lacks it or the level is new."""

    def add(fold: pa.Array, s: pa.Array) -> pa.Array:
        folds = fold.to_numpy()
        held = s.flatten().to_numpy().reshape(len(folds), cells, size)
        out = np.zeros((len(folds), len(next(iter(chosen.values())))))
        for f, sets in chosen.items():
            own = np.flatnonzero(folds == f)
            for k, model in enumerate(sets):
                if model and len(own):
                    out[own, k] = level_weights(model[0], model[1], held[own], model[2])[:, 0]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    add.__annotations__ = {"fold": pa.Array, "s": pa.Array, "return": pa.Array}
    return F.arrow_udf(add, "array<double>")


def flat(x: Column, s: Column) -> Column:
    """A row's columns and its level's sums as one array."""
    return F.concat(x, s)
