"""Studies of a relationship: feature sets compared on the same rows and folds, prepared from training rows alone, with models chosen over inner folds.

A fit is an outer fold with one of its inner folds, or with none (-1): what is trained on all
rows of the other outer folds. Rows are not copied for it: a row lies in one cell, its fold
with its inner fold in each other one, and a fit's training rows are some of the few cells.
Imputing and scaling are affine, so a fit's matrix follows from its cells' raw ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spectraloom.functions import scalars
from spectraloom.operators import descriptors, validation, wide
from spectraloom.operators.tables import long_values, quantiles
from spectraloom.session import checkpointed, small_batches

#: Columns of a design matrix, at most: their products fit a row many times over. One categorical of more levels is eliminated instead (`wide`).
MOST_COLUMNS = 512
#: Cells, at most: folds times inner folds, and more only where groups' inner folds differ by outer fold. A row's level holds numbers for each.
MOST_CELLS = 4096
#: Columns of a design, at most, whose products with weights are written out.
MOST_TERMS = 64
#: Numbers that a task holds for groups before it gives them on.
MOST_HELD = 1 << 21


#: The share of a column's values that must read as numbers for it to be numeric.
NUMERIC_SHARE = 0.8


def types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """numeric or categorical, by column, from one pass over all of them: text is numeric where NUMERIC_SHARE or more of the values that aren't null markers read as numbers. Without values it is categorical."""
    text = [c for c, kind in df.dtypes if c in columns and kind == "string"]
    known = lambda c: scalars.clean_marker(c).isNotNull()
    counts = [e for i, c in enumerate(text) for e in (F.count_if(known(c)).alias(f"k_{i}"), F.count_if(known(c) & scalars.finite_double(scalars.clean_marker(c)).isNotNull()).alias(f"n_{i}"))]
    found = df.agg(*counts).first() if text else {}
    enough = {c: found[f"n_{i}"] >= NUMERIC_SHARE * max(1, found[f"k_{i}"]) for i, c in enumerate(text)}
    return {c: "numeric" if enough.get(c, True) else "categorical" for c in columns}


def typed(df: DataFrame, columns: list[str], known: dict[str, str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns: as `known`, a profile of the whole table kept with it (types()), else by the rows themselves. Text in a numeric column that is no number counts as missing."""
    kinds = types(df, [c for c in columns if c not in (known or {})]) | (known or {})
    return [c for c in columns if kinds[c] == "numeric"], [c for c in columns if kinds[c] != "numeric"]


def cohort(df: DataFrame, task: str, target: str, groups: dict[str, list[str]], controls: list[str], roles_of: dict[str, str], scope: list[str], dataset: str = "dataset", doi: str = "doi", fallback: str | None = None, measured: bool = True) -> DataFrame:
    """The task's eligible rows, with study_group: the DOI's article, or where none is known the `fallback` group, if one is named.

    Raises where columns don't suit the task or no dataset is chosen. With `measured`, spectra and structure among the predictors must be there.
    """
    validation.check_study(task, target, groups, controls, roles_of)
    if not scope:
        raise ValueError("choose a dataset")
    article = F.when(validation.valid_group(F.col(doi)), scalars.article_group(F.col(doi)))
    other = F.when(validation.valid_group(F.col(fallback)), scalars.stripped(F.col(fallback).cast("string"))) if fallback else F.lit(None).cast("string")
    between = [c for role in ("xps", "structure") for c in groups.get(role, [])] if measured else []
    flags = validation.flagged(df.withColumn("study_group", F.coalesce(article, other)), target, "study_group", between, scope, dataset)
    return flags.where("eligible").select(*df.columns, "study_group")


class Splits:
    """The fits of folds (group, fold) and nested folds (outer, group, inner), the cells, and the cell of each group."""

    def __init__(self, folds: DataFrame, nested: DataFrame, group: str, choose: bool = True):
        """Without anything to `choose`, inner folds aren't looked at."""
        nested = nested if choose else folds.select(F.lit(0).alias("outer"), group, F.lit(0).alias("inner")).limit(0)
        inners = nested.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outer", "inner")))).alias("inners"))  # one a fold
        named = folds.select(group, "fold").join(inners, group, "left").withColumn("__key", F.to_json("inners"))
        found = named.select("fold", "__key").distinct().orderBy("fold", "__key").limit(MOST_CELLS + 1).collect()
        if len(found) > MOST_CELLS:
            raise ValueError("too many cells: deal inner folds alike in all outer folds")
        self.cells = [(r["fold"], {int(o): i for o, i in json.loads(r["__key"] or "{}").items()}) for r in found]
        outers = sorted({fold for fold, _ in self.cells})
        self.fits = [(o, j) for o in outers for j in [-1, *(sorted({c[1][o] for c in self.cells if o in c[1]}) if choose else [])]]
        small = folds.sparkSession.createDataFrame([(r["fold"], r["__key"], i) for i, r in enumerate(found)], "fold int, __key string, cell int")
        keyed = small.withColumnRenamed("fold", "__fold").withColumnRenamed("__key", "__other")
        self.groups = named.join(F.broadcast(keyed), (F.col("fold") == F.col("__fold")) & F.col("__key").eqNullSafe(F.col("__other"))).select(group, "fold", "cell")

    def train(self, fit: tuple[int, int]) -> list[int]:
        """The cells of a fit's training rows."""
        outer, inner = fit
        return [i for i, (fold, inners) in enumerate(self.cells) if fold != outer and (inner < 0 or inners.get(outer) != inner)]

    def training(self) -> list[list[int]]:
        """By cell, the numbers of the fits that train on it."""
        out: list[list[int]] = [[] for _ in self.cells]
        for i, fit in enumerate(self.fits):
            for c in self.train(fit):
                out[c].append(i)
        return out

    def validated(self, cell: int) -> list[tuple[int, int]]:
        """The fits that a cell's rows validate."""
        return [(o, j) for o, j in self.fits if j >= 0 and self.cells[cell][1].get(o) == j]


class Design:
    """The raw columns of a row, whatever the fit: 1, numerics less a constant (0 where missing), missing indicators, one-hot levels."""

    def __init__(self, rows: DataFrame, numeric: list[str], categorical: list[str], target: str, most: int = MOST_COLUMNS):
        """Above `most` columns, the categorical of the most levels gets none (`wide`); raises where the others are still too many. A null level is 'missing'. The constants, means of all rows, only keep digits: they cancel in every fit."""
        self.numeric, self.categorical, self.target = numeric, categorical, target
        means = rows.agg(F.avg(F.col(target).cast("double")).alias("__y"), *[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first()
        self.shift, self.base = {c: means[c] or 0.0 for c in numeric}, means["__y"] or 0.0
        at = 1 + len(numeric)
        self.places = {c: [1 + i, at + i] for i, c in enumerate(numeric)}
        self.levels, at = {}, at + len(numeric)
        found = {c: [r["v"] for r in rows.select(self._level(c).alias("v")).distinct().limit(most + 1).collect()] for c in categorical}
        #: the categorical that has no columns, as all levels would be too many
        self.wide = max(categorical, key=lambda c: len(found[c])) if at + sum(map(len, found.values())) > most else None
        for c in categorical:
            if c != self.wide:
                self.levels[c] = sorted(found[c])
                self.places[c] = list(range(at, at + len(found[c])))
                at += len(found[c])
        if at > most:
            raise ValueError(f"without {self.wide}, the levels of the others still pass {most} columns")
        self.width = at

    @staticmethod
    def _level(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("missing"))

    def columns(self) -> list[Column]:
        value = lambda c: F.col(c).cast("double")
        return [
            F.lit(1.0), *[F.coalesce(value(c) - self.shift[c], F.lit(0.0)) for c in self.numeric], *[value(c).isNull().cast("double") for c in self.numeric],
            *[(self._level(c) == v).cast("double") for c in self.levels for v in self.levels[c]],
        ]

    def row(self) -> Column:
        return F.array(*self.columns())

    def prepared(self, gram: np.ndarray, medians: dict[str, float], features: list[str]) -> np.ndarray:
        """Rows that take raw columns and the shifted target to those of a fit: 1, imputed and standardised numerics, indicators, levels; last the target less its training mean."""
        n = gram[0, 0]
        places = [p for c in features if c != self.wide for p in self.places[c]]
        out = np.zeros((2 + len(places), self.width + 1))
        out[0, 0] = 1
        for r, p in enumerate(places, 1):
            out[r, p] = 1
        for c in [c for c in features if c in self.shift]:
            value, missing = self.places[c]
            fill = medians[c] - self.shift[c]
            mean = (gram[0, value] + fill * gram[0, missing]) / n
            spread = math.sqrt(max((gram[value, value] + fill * fill * gram[missing, missing]) / n - mean * mean, 0.0))
            row = out[1 + places.index(value)]
            row[:] = 0
            if spread > 1e-12 * (abs(mean) + 1e-300):
                row[[0, value, missing]] = -mean / spread, 1 / spread, fill / spread
        out[-1, -1], out[-1, 0] = 1, -gram[0, -1] / n
        return out


def fit_medians(rows: DataFrame, splits: Splits, numeric: list[str]) -> list[dict[str, float]]:
    """For each fit, the exact medians of its training rows, from one pass over counted values. Raises where there are none."""
    if not numeric:
        return [{} for _ in splits.fits]
    names = [f"n_{i}" for i in range(len(splits.fits))]
    counts = long_values(rows, ["cell"], numeric).groupBy("field", "value").agg(*[F.count_if(F.col("cell").isin(splits.train(fit))).alias(n) for fit, n in zip(splits.fits, names, strict=True)])
    found = {r["field"]: [r[f"q_{n}"][0] for n in names] for r in quantiles(counts, ["field"], [0.5], names).collect()}
    if absent := [c for c in numeric if c not in found or None in found[c]]:
        raise ValueError(f"no training values: {absent}")
    return [{c: found[c][i] for c in numeric} for i in range(len(names))]


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """The rows' keys as numbers, and the key of each number."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:  # numbers of the keys so far with the next column's
        codes = pd.factorize(codes * (len(c) + 1) + pd.factorize(c.to_pandas(), use_na_sentinel=False)[0])[0]
    first = np.full(codes.max() + 1, len(codes))
    np.minimum.at(first, codes, np.arange(len(codes)))
    return codes, list(zip(*[c.take(pa.array(first)).to_pylist() for c in columns], strict=True))


def _partial_sums(df: DataFrame, keys: list[str], values, to: list[list[int]] | None = None) -> DataFrame:
    """(keys…, v): for each task, the sum over each key's rows of the arrays that `values` makes of (key, x, y) of the rows it is given.

    With `to`, each key is a place in it, and its sum goes to all the keys that are listed there. Without, a task gives what it holds
    whenever that passes MOST_HELD numbers.
    """
    names = df.columns

    def made(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=False)]
        ends = np.cumsum([0, *(len(v) for v in held.values())], dtype=np.int32)
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(held.values())), pa.float64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c, batch=batch: batch.column(names.index(c))
            codes, unique = _numbered([column(k) for k in keys])
            x, y = column("x").flatten().to_numpy().reshape(batch.num_rows, -1), column("y").to_numpy()
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(unique)))
            for key, low, high in zip(unique, [0, *ends[:-1]], ends, strict=True):
                own = order[low:high]
                held[key] = held.get(key, 0) + values(key, x[own], y[own])
            if to is None and held and len(held) * len(next(iter(held.values()))) > MOST_HELD:
                yield made(held)
                held = {}
        if to is not None:
            onto: dict[tuple, np.ndarray] = {}
            for (key,), total in held.items():
                for k in to[key]:
                    onto[(k,)] = onto.get((k,), 0) + total
            held = onto
        if held:
            yield made(held)

    kinds = df.select(*keys).schema
    schema = to_arrow_schema(StructType(kinds.fields)).append(pa.field("v", pa.list_(pa.float64())))
    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "v array<double>"]))


def _total(partial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, at, v): the arrays `v` of each key summed up, a number a row."""
    return partial.select(*keys, F.posexplode("v").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))


def _sums_of_means(partial: DataFrame, cell: str, group: str) -> DataFrame:
    """(cell, v): for each task, the sums over groups of each group's means, and last the number of groups. Arrays end with the number of their rows."""
    names = partial.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        key, total = None, None

        def close() -> None:
            if key is not None:
                held[key[0]] = held.get(key[0], 0) + np.append(total[:-1] / total[-1], 1.0)

        for batch in batches:
            columns = [batch.column(names.index(c)) for c in (cell, group, "v")]
            for own, (c, g) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                v = columns[2][own].values.to_numpy()
                if (c, g) == key:
                    total = total + v
                else:
                    close()
                    key, total = (c, g), v
        close()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], [cell, "v"])

    # a group's arrays, one a task, meet in order
    return partial.repartition(cell, group).sortWithinPartitions(cell, group).mapInArrow(run, f"{cell} int, v array<double>")


def _gram(key, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    held = np.column_stack([x, y])
    return (held.T @ held).ravel()


def compared(rows: DataFrame, sets: dict[str, list[str]], group: str, target: str, k: int = 5, inner: int = 3, grid: list[tuple[str, float, float]] | None = None, known: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, list[tuple]]]:
    """Out-of-fold predictions in long form (row columns, fold, feature_set, model, observed, predicted), the split manifest and what was chosen: (outer, kind, alpha, l1) by set.

    All sets see the same rows and folds; a set without features is the training mean. Each
    fit imputes medians with indicators, standardises and encodes from its own training rows;
    a null level is 'missing', one that training lacks is zeros. Each validation group
    weighs alike; the first candidate of the smallest mean error over inner folds wins. Raises where rows
    or groups are too few, or a feature has no training values in a fit. Rows are read three times.
    Columns are numeric or categorical as typed() says. Input columns named like the added ones are replaced. A categorical of any number of levels may be among the features (`wide`).
    """
    grid = grid or validation.LINEAR
    every = list(dict.fromkeys(c for features in sets.values() for c in features))
    numeric, categorical = typed(rows, every, known)
    rows = checkpointed(rows.withColumns({c: descriptors.numeric(rows, c) for c in numeric} | {c: scalars.clean_marker(c) for c in categorical if dict(rows.dtypes)[c] == "string"}))
    if reason := validation.guards(rows, group).first()["reason"]:
        raise ValueError(reason)
    folds = checkpointed(validation.rank_folds(rows, group, k))
    nested = validation.nested_folds(folds, group, inner)
    if len(grid) > 1:
        nested = checkpointed(nested)
    splits = Splits(folds, nested, group, len(grid) > 1)
    # shuffled once for all passes; rows of a group side by side make few sums of each batch
    held = checkpointed(rows.drop("fold", "cell").join(splits.groups, group).sortWithinPartitions(group))
    medians = fit_medians(held, splits, numeric)
    design = Design(rows, numeric, categorical, target)
    level = [design._level(design.wide).alias("level")] if design.wide else []
    arrays = held.select("cell", group, design.row().alias("x"), (F.col(target).cast("double") - design.base).alias("y"), *level)
    size, cells = design.width + 1, len(splits.cells)
    grams = np.zeros((len(splits.fits), size * size))
    for r in _total(_partial_sums(arrays.select("cell", "x", "y"), ["cell"], _gram, splits.training()), ["cell"]).collect():  # a matrix a fit
        grams[r["cell"], r["at"]] = r["v"]
    sums = checkpointed(wide.level_sums(arrays, design.width, cells)) if design.wide else None
    weights, models = _solved(splits, design, grams.reshape(-1, size, size), medians, sets, grid, sums)
    if len(grid) > 1:
        if sums is not None:
            arrays = arrays.join(sums, "level").withColumn("x", wide.flat(F.col("x"), F.col("s")))
        best = _chosen(arrays.select("cell", group, "x", "y"), splits, weights, models, sets, grid, group, size)
    else:
        best = {(name, o): 0 for name in sets for o, _ in splits.fits}
    chosen = {name: [(o, *grid[best[name, o]]) for o, j in splits.fits if j < 0] for name, features in sets.items() if features}
    final = [(o, [[float(v) for v in weights[o, -1][name][best[name, o]]] for name in sets]) for o, j in splits.fits if j < 0]
    sent = rows.sparkSession.createDataFrame(final, "fold int, __w array<array<double>>")
    # a sum of a few terms is compiled; functions over arrays are not
    few = design.width <= MOST_TERMS
    tested = (held if few else held.withColumn("__x", design.row())).join(F.broadcast(sent), "fold")
    more = F.array(*[F.lit(0.0)] * len(sets))
    if sums is not None:
        last = {o: [(models[o, -1][name], weights[o, -1][name, "beta"][[best[name, o]]], np.array([best[name, o]])) if name in models[o, -1] else None for name in sets] for o, j in splits.fits if j < 0}
        small_batches(rows.sparkSession)
        tested = tested.withColumn("level", design._level(design.wide)).join(sums, "level").withColumn("__more", wide.added(last, size, cells)("fold", "s")).drop("level", "s")
        more = F.col("__more")
    whole = lambda w: F.aggregate(F.zip_with("__x", w, lambda a, b: a * b), F.lit(design.base), lambda s, v: s + v)
    terms = lambda w: reduce(lambda s, t: s + t[1] * w[t[0]], enumerate(design.columns()), F.lit(design.base))
    dot = terms if few else whole
    made = F.array(*[F.struct(F.lit(name).alias("feature_set"), F.lit("linear" if features else "training_mean").alias("model"), (dot(F.col("__w")[i]) + more[i]).alias("predicted")) for i, (name, features) in enumerate(sets.items())])
    tested = tested.drop("cell").withColumn("__p", F.explode(made))
    kept = [c for c in rows.columns if c not in ("fold", "cell", "feature_set", "model", "observed", "predicted")]
    return tested.select(*kept, "fold", "__p.feature_set", "__p.model", F.col(target).cast("double").alias("observed"), "__p.predicted"), manifest(folds, nested, group), chosen


def _solved(splits: Splits, design: Design, grams: np.ndarray, medians: list[dict[str, float]], sets: dict[str, list[str]], grid: list[tuple[str, float, float]], sums: DataFrame | None) -> tuple[dict, dict]:
    """By fit and set, the weights of raw columns (candidates × columns) that give the prediction less the design's base; and, of sets with the wide categorical, the `wide.Fit` and its own weights under (set, "beta")."""
    out: dict = {}
    models: dict = {key: {} for key in splits.fits}
    maps = {(key, name): design.prepared(gram, own, features) for key, own, gram in zip(splits.fits, medians, grams, strict=True) for name, features in sets.items()}
    by_level = [(key, name) for key, name in maps if design.wide in sets[name]] if design.wide else []
    fits = [wide.Fit(splits.train(key), maps[key, name], grams[splits.fits.index(key)], grid) for key, name in by_level]
    found = dict(zip(by_level, wide.solved(sums, fits, grid, design.width + 1, len(splits.cells)) if fits else [], strict=True))
    for (key, name), fit in zip(by_level, fits, strict=True):
        models[key][name] = fit
        out.setdefault(key, {})[name, "beta"] = found[key, name]
    for key, gram in zip(splits.fits, grams, strict=True):
        for name, features in sets.items():
            to = maps[key, name]
            mean = np.zeros(design.width)
            mean[0] = -to[-1, 0]
            own = found[key, name] if (key, name) in found else validation.solved(to @ gram @ to.T, grid) if features else np.zeros((len(grid), 1))
            out.setdefault(key, {})[name] = mean + own @ to[:-1, :-1]
    return out, models


def _chosen(arrays: DataFrame, splits: Splits, weights: dict, models: dict, sets: dict[str, list[str]], grid: list, group: str, size: int) -> dict[tuple[str, int], int]:
    """By set and outer fold, the candidate of the smallest error: the mean over inner folds of the mean over validation groups of the mean over rows."""
    validated = [splits.validated(c) for c in range(len(splits.cells))]
    stacked = {fit: np.concatenate([weights[fit][name] for name in sets]).T for fit in splits.fits if fit[1] >= 0}
    betas = {fit: {name: weights[fit][name, "beta"] for name in models[fit]} for fit in stacked}
    # fits × sets × candidates × columns, whatever the rows and levels
    sent = arrays.sparkSession.sparkContext.broadcast((stacked, {fit: models[fit] for fit in stacked}, betas))
    every, n_cells = np.arange(len(grid)), len(splits.cells)

    def errors(key, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        stacked, models, betas = sent.value
        out = []
        for fit in validated[key[0]]:
            made = x[:, : size - 1] @ stacked[fit]
            for name, model in models[fit].items():
                at = list(sets).index(name) * len(grid)
                made[:, at : at + len(grid)] += wide.level_weights(model, betas[fit][name], x[:, size - 1 :].reshape(len(x), n_cells, size), every)
            out.append(np.abs(made - y[:, None]).sum(axis=0))
        return np.append(np.concatenate(out) if out else np.zeros(0), len(y))

    scored = inner_errors(arrays, splits, group, errors, len(sets) * len(grid))
    best = {}
    for i, name in enumerate(sets):
        for o in {o for o, _ in splits.fits}:
            own = [scored[o, j][i * len(grid) : (i + 1) * len(grid)] for outer, j in splits.fits if outer == o and j >= 0]
            best[name, o] = int(np.argmin(np.mean(own, axis=0)))
    return best


def inner_errors(arrays: DataFrame, splits: Splits, group: str, errors, count: int) -> dict[tuple[int, int], np.ndarray]:
    """For each fit with an inner fold, the mean over its validation groups of the mean over rows of the `count` errors that `errors` sums up of (cell, group), x and y: those of all fits that the cell validates, and last the number of rows."""
    validated = [splits.validated(c) for c in range(len(splits.cells))]
    known = arrays.where(F.col("cell").isin([c for c, fits in enumerate(validated) if fits]))
    totals: dict = {}
    for r in _total(_sums_of_means(_partial_sums(known, ["cell", group], errors), "cell", group), ["cell"]).collect():
        totals.setdefault(r["cell"], {})[r["at"]] = r["v"]
    out: dict = {}
    for cell, sums in totals.items():
        for f, fit in enumerate(validated[cell]):
            own = out.setdefault(fit, [np.zeros(count), 0])
            own[0] += [sums[f * count + i] for i in range(count)]
            own[1] += sums[len(validated[cell]) * count]
    return {fit: total / groups for fit, (total, groups) in out.items()}


def manifest(folds: DataFrame, nested: DataFrame, group: str) -> DataFrame:
    """(outer, part, inner, group): which groups each fold tests, and each inner fold of its training validates; rows go with their group."""
    tests = folds.select(F.col("fold").alias("outer"), F.lit("test").alias("part"), F.lit(None).cast("int").alias("inner"), group)
    return tests.unionByName(nested.select("outer", F.lit("train").alias("part"), "inner", group))
