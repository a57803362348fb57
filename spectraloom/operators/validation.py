"""Grouped validation without leakage: cohorts, folds, train-only statistics, models and metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.operators import descriptors, forest
from spectraloom.operators.tables import long_values, quantiles, with_values
from spectraloom.session import checkpointed, numbered, running

# Texts that name no group.
NO_GROUP = ("", "nan", "none", "nat", "inf", "-inf")
#: Fewest rows and groups of a study.
LEAST_ROWS, LEAST_GROUPS = 12, 3
#: Candidates of the linear models (kind, alpha, l1) and of the forest (depth, least rows of a leaf); depth 30 is the learner's deepest, for no limit.
RIDGE = (1.0, 10.0)
LINEAR = [("ridge", a, 0.0) for a in RIDGE] + [("net", a, r) for a in (0.001, 0.01, 0.1, 1.0, 10.0) for r in (0.05, 0.25, 0.5, 0.75, 0.95)]
FOREST, TREES = [(d, leaf) for d in (30, 4, 8) for leaf in (1, 2, 4)], 400


def valid_group(c: Column) -> Column:
    return F.coalesce(~F.lower(scalars.stripped(c.cast("string"))).isin(*NO_GROUP), F.lit(False))


def check_arguments(df: DataFrame, target: str, group: str, baseline: list[str], candidates: list[str]) -> None:
    """Raises where a choice of columns would leak the target, or isn't a choice."""
    used = [target, group, *baseline, *candidates]
    if not baseline or not candidates:
        raise ValueError("baseline and candidates need a column each")
    if len(set(used)) != len(used):
        raise ValueError("target, group, baseline and candidates must be different columns")
    if absent := [c for c in used if c not in df.columns]:
        raise KeyError(f"absent columns: {absent}")


def flagged(df: DataFrame, target: str, group: str, candidates: list[str], scope: list[str] | None = None, dataset: str = "dataset", doi: str | None = None, measured_only: bool = True) -> DataFrame:
    """Adds the cohort's flags: has_target, has_group, in_scope, resolved, measured, and eligible, their conjunction."""
    flags = {
        "has_target": descriptors.numeric(df, target).isNotNull(),
        "has_group": valid_group(F.col(group)),
        "in_scope": F.coalesce(F.col(dataset).isin(*scope), F.lit(False)) if scope else F.lit(True),
        "resolved": F.coalesce(scalars.stripped(F.col(doi)) != "", F.lit(False)) if doi else F.lit(True),
        "measured": reduce(and_, [descriptors.numeric(df, c).isNotNull() for c in candidates], F.lit(True)) if measured_only else F.lit(True),
    }
    return df.withColumns(flags).withColumn("eligible", reduce(and_, [F.col(f) for f in flags]))


def attrition(flags: DataFrame) -> DataFrame:
    """One row: how many rows each step drops, in order, and how many are scored."""
    c = F.col
    known = c("has_target") & c("has_group")
    return flags.agg(
        F.count("*").alias("input_rows"), F.count_if(~known).alias("bad_target_or_group"), F.count_if(known & ~c("in_scope")).alias("outside_scope"), F.count_if(known & c("in_scope") & ~c("resolved")).alias("unresolved"),
        F.count_if(known & c("in_scope") & c("resolved") & ~c("measured")).alias("missing_candidates"), F.count_if("eligible").alias("rows_scored"),
    )


def split_groups(df: DataFrame, doi: str, group: str) -> DataFrame:
    """(doi, groups): DOIs spread over more than one group; any makes a study invalid."""
    named = df.where(F.coalesce(F.col(doi), F.lit("")) != "")
    return named.groupBy(doi).agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def guards(df: DataFrame, group: str, by: tuple[str, ...] = (), fold: str | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """A row for each `by` (one row without): rows, groups, and the reason to reject the cohort, if any.

    With `fold`, also a feature of `features` that has no value in the training rows of some fold.
    """
    made = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))
    empty = F.lit(None).cast("string")
    if fold and features:
        own = df.groupBy(*by, fold).agg(*[F.count(c).alias(f"__{i}") for i, c in enumerate(features)])
        # a fold's training values: the total less its own
        most = own.groupBy(*by).agg(*[(F.sum(f"__{i}") == F.max(f"__{i}")).alias(f"__none_{i}") for i in range(len(features))])
        if by:
            keyed = most.withColumnsRenamed({c: f"__by_{c}" for c in by})
            made = made.join(keyed, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]), "left").drop(*[f"__by_{c}" for c in by])
        else:
            made = made.crossJoin(most)
        empty = F.coalesce(*[F.when(F.col(f"__none_{i}"), F.lit(f"no training values: {c}")) for i, c in enumerate(features)])
    reason = F.when(F.col("groups") < LEAST_GROUPS, "too few groups").when(F.col("rows") < LEAST_ROWS, "too few rows").otherwise(empty)
    return made.select(*by, "rows", "groups", reason.alias("reason"))


def rank_folds(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """(group, rows, fold): groups ordered by size, then name, dealt back and forth over min(k, groups) folds. Distributed, however many groups."""
    counts = df.groupBy(group).agg(F.count("*").alias("rows"))
    ranked = numbered(counts, [F.desc("rows"), F.col(group)], "__n")
    n = F.least(F.lit(k), F.lit(max(1, ranked.count())))
    turn, place = F.floor(F.col("__n") / n), F.col("__n") % n
    return ranked.select(group, "rows", F.when(turn % 2 == 0, place).otherwise(n - 1 - place).cast("int").alias(name))


def _turns(loads: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Deals `count` groups of one size to the lightest of `loads` (load, fold), which it updates: (first place, folds that take turns from there)."""
    out, done = [], 0
    while done < count:
        loads.sort()
        low, first = loads[0]
        # these are all dealt to before the first is again, until the next fold is light enough
        n = sum(x < (low + size, first) for x in loads)
        take = count - done
        if n < len(loads):
            rounds = (loads[n][0] - low) // size
            rounds -= loads[n] < (low + rounds * size, first)
            take = min(take, rounds * n)
        out.append((done, [f for _, f in loads[:n]]))
        loads[:n] = [(load + (take // n + (i < take % n)) * size, f) for i, (load, f) in enumerate(loads[:n])]
        done += take
    return out


def greedy_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, rows, fold): the largest group to the lightest fold, over and over; ties by name.

    The driver sees the distinct sizes with their counts alone: which folds take turns is the
    same for all groups of a size, whose places are ranked by Spark.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("rows"))
    ranked = checkpointed(numbered(counts, [F.desc("rows"), F.col(group)], "__n"))
    sizes = ranked.groupBy("rows").agg(F.count("*").alias("groups")).orderBy(F.desc("rows")).collect()
    loads = [(0, f) for f in range(min(k, max(1, sum(r["groups"] for r in sizes))))]
    turns, before = [], 0
    for r in sizes:
        turns.append((r["rows"], [(before + at, folds) for at, folds in _turns(loads, r["rows"], r["groups"])]))
        before += r["groups"]
    dealt = df.sparkSession.createDataFrame(turns, "rows bigint, __turns array<struct<at: bigint, folds: array<int>>>")
    own = F.element_at(F.filter("__turns", lambda t: t["at"] <= F.col("__n")), -1)
    fold = own["folds"][F.pmod(F.col("__n") - own["at"], F.size(own["folds"])).cast("int")]
    return ranked.join(dealt, "rows").select(group, "rows", fold.alias("fold"))


def nested_folds(groups: DataFrame, group: str, inner: int) -> DataFrame:
    """(outer, group, inner): for each outer fold, its training groups dealt to inner folds by their order inside it."""
    from pyspark.sql import Window

    outer = groups.select(F.col("fold").alias("outer")).distinct()
    train = groups.join(outer, F.col("fold") != F.col("outer"))  # folds are few: k copies of the group table
    place = F.row_number().over(Window.partitionBy("outer", "fold").orderBy(F.desc("rows"), group)) - 1
    return train.select("outer", group, ((place + F.col("fold")) % inner).cast("int").alias("inner"))


def overlaps(assigned: DataFrame, group: str) -> DataFrame:
    """(outer, group) that stand both in training and test of an outer fold: none, if folds are right."""
    test = assigned.select(F.col("fold").alias("outer"), group).distinct()
    train = assigned.select(group, "fold").join(test.select("outer").distinct(), F.col("fold") != F.col("outer")).select("outer", group).distinct()
    return test.intersect(train)


def train_means(df: DataFrame, fold: str, columns: list[str]) -> DataFrame:
    """(fold, n, mean_c, sd_c …) over each fold's training rows, from sums: the total less the fold's own."""
    sums = [e for c in columns for e in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"), F.count(c).alias(f"n_{c}"))]
    own = df.groupBy(fold).agg(F.count("*").alias("n"), *sums)
    total = own.agg(*[F.sum(x).alias(f"t_{x}") for x in own.columns if x != fold])
    each = own.crossJoin(total)  # one row on the right
    left = lambda x: F.col(f"t_{x}") - F.col(x)
    out = [left("n").alias("n")]
    for c in columns:
        mean = left(f"s_{c}") / F.nullif(left(f"n_{c}"), F.lit(0))
        out += [mean.alias(f"mean_{c}"), F.sqrt(F.greatest(left(f"q_{c}") / F.nullif(left(f"n_{c}"), F.lit(0)) - mean * mean, F.lit(0.0))).alias(f"sd_{c}")]
    return each.select(fold, *out)


def train_medians(df: DataFrame, fold: str, columns: list[str], k: int) -> DataFrame:
    """(fold, median_c …) over each fold's training rows, exact: distinct values are counted once for each fold, and no row is copied."""
    names = [f"n_{o}" for o in range(k)]
    counts = long_values(df, [fold], columns).groupBy("field", "value").agg(*[F.count_if(F.col(fold) != o).alias(n) for o, n in enumerate(names)])
    cuts = quantiles(counts, ["field"], [0.5], names)
    each = cuts.select("field", F.explode(F.array(*[F.struct(F.lit(o).alias("fold"), F.col(f"q_{n}")[0].alias("q")) for o, n in enumerate(names)])).alias("__e")).select("field", "__e.*")
    return each.groupBy(F.col("fold").alias(fold)).agg(*[F.max(F.when(F.col("field") == c, F.col("q"))).alias(f"median_{c}") for c in columns])


def prepared(df: DataFrame, fold: str, numeric: list[str], categorical: list[str], k: int) -> DataFrame:
    """Rows × outer folds (outer) with imputed and standardised numerics (z_c), missing indicators (miss_c) and one-hot categoricals; all learned from training rows.

    A categorical's one-hot row is sparse, as its levels have no limit: hot_c is the place of
    its only 1 among the fold's width_c training levels, by name, NULL for a level unseen in
    training (zeros everywhere). A null is the level 'missing'.
    """
    copies = df.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_train", F.col("outer") != F.col(fold))
    medians = train_medians(df, fold, numeric, k).withColumnRenamed(fold, "outer")
    filled = copies.join(F.broadcast(medians), "outer").withColumns({f"miss_{c}": F.col(c).isNull().cast("double") for c in numeric} | {f"f_{c}": F.coalesce(c, f"median_{c}") for c in numeric})
    scale = filled.where("is_train").groupBy("outer").agg(*[e for c in numeric for e in (F.avg(f"f_{c}").alias(f"a_{c}"), F.stddev_pop(f"f_{c}").alias(f"d_{c}"))])
    scaled = filled.join(F.broadcast(scale), "outer").withColumns({f"z_{c}": F.coalesce((F.col(f"f_{c}") - F.col(f"a_{c}")) / F.nullif(F.col(f"d_{c}"), F.lit(0.0)), F.lit(0.0)) for c in numeric})
    for c in categorical:
        level = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        # a level counts only where the fold's training rows have it
        seen = numbered(copies.where("is_train").select("outer", level.alias("__level")).distinct(), [F.col("outer"), F.col("__level")], "__at")
        spans = seen.groupBy("outer").agg(F.min("__at").alias("__first"), F.count("*").alias(f"width_{c}"))
        places = seen.join(F.broadcast(spans.drop(f"width_{c}")), "outer").select("outer", "__level", (F.col("__at") - F.col("__first")).alias(f"hot_{c}"))
        scaled = scaled.withColumn("__level", level).join(places, ["outer", "__level"], "left").join(F.broadcast(spans.drop("__first")), "outer", "left").drop("__level")
    return scaled.drop(*[f"{p}_{c}" for c in numeric for p in ("f", "a", "d", "median")])


def grams(df: DataFrame, keys: list[str], features: list[str], target: str) -> pd.DataFrame:
    """XᵀX, Xᵀy, yᵀy sums with an intercept column, by keys: one row a fold combination reaches the driver."""
    names = ["one", *features, "target"]
    held = df.select(*keys, F.lit(1.0).alias("one"), *features, F.col(target).cast("double").alias("target"))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return held.groupBy(*keys).agg(*sums).toPandas()


def gram_matrix(row, n: int) -> np.ndarray:
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = row[f"{i}_{j}"]
    return g


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights that minimise ‖y − b − Xw‖² + α‖w‖²; the intercept is free."""
    penalty = np.eye(len(gram) - 1) * alpha
    penalty[0, 0] = 0
    return np.linalg.solve(gram[:-1, :-1] + penalty + np.eye(len(penalty)) * 1e-12, gram[:-1, -1])


def elastic_nets(gram: np.ndarray, alphas: list[float], l1s: list[float], rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """For each (alpha, l1), intercept and weights that minimise ‖y − b − Xw‖²/2n + α·l1·‖w‖₁ + α(1 − l1)‖w‖²/2: coordinate descent on the sums, all candidates side by side."""
    alpha, l1 = np.array(alphas), np.array(l1s)
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] / n - np.outer(mean, mean)
    a, b = centred[:-1, :-1], centred[:-1, -1]
    w = np.zeros((len(alpha), len(b)))
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(b)):
            rest = b[j] - w @ a[:, j] + a[j, j] * w[:, j]
            w[:, j] = np.sign(rest) * np.maximum(np.abs(rest) - alpha * l1, 0) / np.maximum(a[j, j] + alpha * (1 - l1), 1e-300)
        if np.abs(w - old).max(initial=0) < tol:
            break
    return np.column_stack([mean[-1] - w @ mean[:-1], w])


def elastic_net(gram: np.ndarray, alpha: float, l1: float) -> np.ndarray:
    return elastic_nets(gram, [alpha], [l1])[0]


def solved(gram: np.ndarray, grid: list[tuple[str, float, float]]) -> np.ndarray:
    """Intercept and weights of each candidate (kind, alpha, l1)."""
    out = np.zeros((len(grid), len(gram) - 1))
    nets = [i for i, c in enumerate(grid) if c[0] != "ridge"]
    if nets:
        out[nets] = elastic_nets(gram, [grid[i][1] for i in nets], [grid[i][2] for i in nets])
    for i, c in enumerate(grid):
        if c[0] == "ridge":
            out[i] = ridge(gram, c[1])
    return out


def linear_study(rows: DataFrame, folds: DataFrame, nested: DataFrame, group: str, features: list[str], target: str, grid: list[tuple[str, float, float]] | None = None) -> tuple[DataFrame, list[tuple]]:
    """Out-of-fold predictions (row columns, fold, predicted) of the linear model that inner folds choose, and what was chosen.

    Training sums are the total less the held-out sums: nothing is copied. Candidates are
    (kind, alpha, l1); the first with the smallest inner error wins, each validation group
    weighing alike.
    """
    grid = grid or LINEAR
    held = rows.join(folds.select(group, "fold"), group)
    n = len(features) + 2
    own = grams(held, ["fold"], features, target)
    by_fold = {int(r["fold"]): gram_matrix(r, n) for _, r in own.iterrows()}
    total = sum(by_fold.values())
    cells = grams(rows.join(nested, group), ["outer", "inner"], features, target)
    models, trials = {}, {}
    for outer, held_out in sorted(by_fold.items()):
        train = total - held_out
        for _, r in cells[cells["outer"] == outer].sort_values("inner").iterrows():
            trials[outer, int(r["inner"])] = solved(train - gram_matrix(r, n), grid).tolist()
        models[outer] = train
    spark = rows.sparkSession
    tried = spark.createDataFrame([(*k, w) for k, w in trials.items()], "outer int, inner int, weights array<array<double>>")
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    dot = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # an aggregate a candidate: rows aren't copied
    miss = [F.avg(F.abs(F.col(target) - dot(F.col("weights")[i]))).alias(f"mae_{i}") for i in range(len(grid))]
    errors = rows.join(nested, group).join(F.broadcast(tried), ["outer", "inner"]).groupBy("outer", "inner", group).agg(*miss)
    mean = lambda df, *by: df.groupBy(*by).agg(*[F.avg(f"mae_{i}").alias(f"mae_{i}") for i in range(len(grid))])
    best = {r["outer"]: min(range(len(grid)), key=lambda i: r[f"mae_{i}"]) for r in mean(mean(errors, "outer", "inner"), "outer").collect()}
    chosen = [(outer, *grid[best[outer]], solved(models[outer], [grid[best[outer]]])[0].tolist()) for outer in sorted(models)]
    final = spark.createDataFrame([(c[0], c[-1]) for c in chosen], "fold int, weights array<double>")
    return held.join(F.broadcast(final), "fold").withColumn("predicted", dot(F.col("weights"))).drop("weights"), chosen


def forest_study(rows: DataFrame, folds: DataFrame, group: str, features: list[str], target: str, trees: int = TREES, depth: int = 5, seed: int = 7, nested: DataFrame | None = None, grid: list[tuple[int, int]] | None = None, bootstrap: bool = True) -> DataFrame:
    """Out-of-fold predictions (row columns, fold, predicted, depth, leaf) of a random forest a fold, by the distributed learner.

    With `nested`, inner folds choose among the grid (FOREST): the first candidate with the
    smallest inner error wins, each validation group weighing alike. Without, `depth` holds.
    Missing features take the median of the fit's training rows, and those that have
    gaps an indicator beside it; a feature without training values raises.

    Large tables of few distinct rows of features (forest.SUMMED_FROM, forest.MOST_SUMS) are summed up by cell, distinct row and tree, from which each
    fit's trees are grown with all values as thresholds; a tree draws each row by Poisson's law there, the same times in all fits. Else, where a task can hold the rows (forest.MOST_VALUES), trees are grown side by side and those of all depths at once, with
    all values as thresholds. Larger tables go to Spark's own learner, which bins values and takes the outer fold's medians. A forest tries the square root
    of the features at a node where inner folds choose; else all of them, or a third in Spark's learner. Trees draw rows with replacement; without `bootstrap`, each takes all. Targets must not be null.
    """
    grid = (grid or FOREST) if nested is not None else [(depth, 1)]
    splits = _splits(folds, nested, group, len(grid) > 1) if rows.count() * trees >= forest.SUMMED_FROM else None
    held = checkpointed(rows.join(splits.groups.withColumnRenamed("cell", "__cell") if splits else folds.select(group, "fold"), group))
    gaps = held.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    open_ = [c for c in features if gaps[c]]
    if splits:
        most = forest.MOST_SUMS // len(splits.cells)
        entries = held.select(*[F.col(c).cast("double").alias(c) for c in features]).distinct().limit(most + 1).collect()
        if len(entries) <= most:
            return _summed_forests(held, splits, sorted(map(tuple, entries), key=lambda r: [(v is None, v or 0.0) for v in r]), group, features, open_, target, trees, seed, nested is not None, grid, bootstrap)
        held = held.drop("__cell")
    if gaps["__rows"] * (len(features) + len(open_)) <= forest.MOST_VALUES:
        return _shared_forests(held, group, features, open_, target, trees, seed, nested, grid, gaps["__rows"], bootstrap)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    k = held.agg(F.max("fold")).first()[0] + 1 if open_ else 0
    medians = {r["fold"]: r for r in train_medians(held, "fold", open_, k).collect()} if open_ else {}  # a row a fold
    if absent := [c for c in open_ if any(f not in medians or medians[f][f"median_{c}"] is None for f in range(k))]:
        raise ValueError(f"no training values: {absent}")

    def assembled(outer: int) -> DataFrame:
        fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(medians[outer][f"median_{c}"])) if c in open_ else F.col(c).cast("double")
        made = held.withColumns({f"__f_{i}": fill(c) for i, c in enumerate(features)} | {f"__m_{i}": F.col(c).isNull().cast("double") for i, c in enumerate(open_)})
        inputs = [*(f"__f_{i}" for i in range(len(features))), *(f"__m_{i}" for i in range(len(open_)))]
        return checkpointed(VectorAssembler(inputCols=inputs, outputCol="__x").transform(made).drop(*inputs))

    def fitted(train: DataFrame, c: tuple[int, int]):
        return RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=c[0], minInstancesPerNode=c[1], featureSubsetStrategy="sqrt" if nested is not None else "auto", bootstrap=bootstrap, seed=seed).fit(train)

    def inner_error(train: DataFrame, inner: int, c: tuple[int, int]) -> float:
        made = fitted(train.where(F.col("inner") != inner), c).transform(train.where(F.col("inner") == inner))
        return made.groupBy(group).agg(F.avg(F.abs(F.col(target) - F.col("predicted"))).alias("mae")).agg(F.avg("mae")).first()[0]

    out = []
    for (f,) in sorted(folds.select("fold").distinct().collect()):
        best, ready = grid[0], assembled(f)
        if len(grid) > 1:
            train = ready.join(nested.where(F.col("outer") == f), group)
            inners = sorted(r[0] for r in train.select("inner").distinct().collect())
            jobs = [(i, k) for i in range(len(grid)) for k in inners]
            with ThreadPoolExecutor(4) as pool:  # small jobs: their overheads overlap
                errors = dict(zip(jobs, pool.map(lambda j: inner_error(train, j[1], grid[j[0]]), jobs), strict=True))
            best = grid[min(range(len(grid)), key=lambda i: sum(errors[i, k] for k in inners))]
        model = fitted(ready.where(F.col("fold") != f), best)
        out.append(model.transform(ready.where(F.col("fold") == f)).drop("__x").withColumns({"depth": F.lit(best[0]), "leaf": F.lit(best[1])}))
    return reduce(lambda a, b: a.unionByName(b), out)


def _splits(folds: DataFrame, nested: DataFrame | None, group: str, choose: bool):
    """The cells of folds and nested folds; None where they are too many."""
    from spectraloom.operators import study

    try:
        return study.Splits(checkpointed(folds), nested, group, choose and nested is not None)
    except ValueError:
        return None


def _summed_forests(held: DataFrame, splits, entries: list[tuple], group: str, features: list[str], gaps: list[str], target: str, trees: int, seed: int, nested: bool, grid: list[tuple[int, int]], bootstrap: bool) -> DataFrame:
    """forest_study over sums by cell, entry (a distinct row of features) and tree: rows are read for the sums, the errors of the candidates and the predictions."""
    from spectraloom.operators import study

    spark = held.sparkSession
    base = held.agg(F.avg(F.col(target).cast("double"))).first()[0]
    medians = study.fit_medians(held.withColumnRenamed("__cell", "cell"), splits, gaps)
    raw = np.array([[np.nan if v is None else v for v in e] for e in entries])
    missing = np.isnan(raw)
    fill = [np.where(missing, [m.get(c, np.nan) for c in features], raw) for m in medians]
    filled = [np.column_stack([x, missing[:, [features.index(c) for c in gaps]].astype(float)]) for x in fill]
    named = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], ", ".join(["__entry int", *(f"__x_{i} double" for i in range(len(features)))]))
    same = reduce(and_, [F.col(c).cast("double").eqNullSafe(F.col(f"__x_{i}")) for i, c in enumerate(features)])
    kept = [c for c in held.columns if c not in ("__cell", "predicted", "depth", "leaf")]
    key = F.xxhash64(*[c for c, kind in held.dtypes if c not in ("__cell", "fold") and "map<" not in kind])
    coded = held.join(F.broadcast(named), same)
    facts = coded.select(F.col("__cell").alias("cell"), group, F.col("__entry").alias("entry"), key.alias("key"), (F.col(target).cast("double") - base).alias("y"))
    cells, depths, leaves = len(splits.cells), list(dict.fromkeys(d for d, _ in grid)), list(dict.fromkeys(leaf for _, leaf in grid))
    choices = max(1, int((len(features) + len(gaps)) ** 0.5)) if nested else None
    batches = forest.batches_of(trees, cells * len(entries))
    sums = forest.tree_sums(facts, trees, batches, seed, bootstrap)
    found = forest.fitted_by_sums(sums, filled, [splits.train(f) for f in splits.fits], splits.fits, cells, leaves, depths, trees, batches, choices, seed)
    outers = [o for o, j in splits.fits if j < 0]
    best = dict.fromkeys(outers, grid[0])
    made = lambda fit, c: found[splits.fits.index(fit), c[1]][depths.index(c[0])]
    if len(grid) > 1 and nested:
        # candidates × entries of the fits that a cell validates: bounded by MOST_SUMS
        tried = spark.sparkContext.broadcast([np.concatenate([[made(f, c) for c in grid] for f in splits.validated(cell)]).T if splits.validated(cell) else None for cell in range(cells)])

        def errors(own, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.append(np.abs(tried.value[own[0]][x[:, 0].astype(np.int64)] - y[:, None]).sum(axis=0), len(y))

        scores = study.inner_errors(facts.select("cell", group, F.array(F.col("entry").cast("double")).alias("x"), "y"), splits, group, errors, len(grid))
        best = {o: grid[int(np.argmin(np.mean([scores[f] for f in splits.fits if f[0] == o and f[1] >= 0], axis=0)))] for o in outers}
    final = [(o, i, float(v) + base, *best[o]) for o in outers for i, v in enumerate(made((o, -1), best[o]))]
    sent = spark.createDataFrame(final, "fold int, __entry int, predicted double, depth int, leaf int")
    return coded.select(*kept, "__entry").join(F.broadcast(sent), ["fold", "__entry"]).select(*kept, "predicted", "depth", "leaf")


def _shared_forests(held: DataFrame, group: str, features: list[str], gaps: list[str], target: str, trees: int, seed: int, nested: DataFrame | None, grid: list[tuple[int, int]], n: int, bootstrap: bool) -> DataFrame:
    """forest_study over rows that a task can hold."""
    outers = sorted(r[0] for r in held.select("fold").distinct().collect())
    held = checkpointed(held.withColumn("__row", F.monotonically_increasing_id()))  # the ids stay as they are
    x = F.array(*[F.col(c).cast("double") for c in features])
    facts = held.select(F.col("__row").alias("row"), F.col(group).alias("__group"), "fold", F.col(target).cast("double").alias("y"), x.alias("x"))
    every = facts.withColumn("outer", F.explode(F.lit(outers).cast("array<int>")))
    if nested is None:
        inner, named = [], every.withColumn("inner", F.lit(-1))
    else:
        inner = sorted(tuple(r) for r in nested.select("outer", "inner").distinct().collect())
        named = every.join(nested.select("outer", F.col(group).alias("__group"), "inner"), ["outer", "__group"], "left").withColumn("inner", F.coalesce("inner", F.lit(-1)))
    if gaps:
        own = named.groupBy("outer", "fold", "inner").agg(*[F.sum(F.col("x")[features.index(c)].isNotNull().cast("int")).alias(c) for c in gaps]).collect()
        for o, j in [*((o, -1) for o in outers), *inner]:
            rest = [r for r in own if r["outer"] == o != r["fold"] and (j < 0 or r["inner"] != j)]
            if absent := [c for c in gaps if not sum(r[c] for r in rest)]:
                raise ValueError(f"no training values: {absent}")
    named = checkpointed(named)
    choices = max(1, int((len(features) + len(gaps)) ** 0.5)) if nested is not None else None
    depths, leaves = list(dict.fromkeys(d for d, _ in grid)), list(dict.fromkeys(leaf for _, leaf in grid))
    best = dict.fromkeys(outers, grid[0])
    if len(grid) > 1 and inner:
        tried = forest.fitted(named, inner, features, gaps, n, dict.fromkeys(inner, leaves), dict.fromkeys(inner, depths), trees, choices, seed, bootstrap)
        mean = lambda df, *by: df.groupBy(*by).agg(*[F.avg(f"e_{k}").alias(f"e_{k}") for k in range(len(depths))])
        missed = tried.join(facts.select("row", "__group", "y"), "row").select("*", *[F.abs(F.col("y") - F.col(f"p_{k}")).alias(f"e_{k}") for k in range(len(depths))])
        scores = {(r["outer"], d, r["leaf"]): r[f"e_{k}"] for r in mean(mean(mean(missed, "outer", "inner", "leaf", "__group"), "outer", "inner", "leaf"), "outer", "leaf").collect() for k, d in enumerate(depths)}
        best = {o: min(grid, key=lambda c: scores[o, *c]) for o in outers}  # noqa: B023
    final = [(o, -1) for o in outers]
    made = forest.fitted(named, final, features, gaps, n, {(o, -1): [best[o][1]] for o in outers}, {(o, -1): [best[o][0]] for o in outers}, trees, choices, seed, bootstrap)
    depth = F.element_at(F.create_map(*[F.lit(v) for o in outers for v in (o, best[o][0])]), F.col("fold"))
    found = made.select(F.col("row").alias("__row"), F.col("p_0").alias("predicted"), "leaf")
    kept = [c for c in held.columns if c not in ("predicted", "depth", "leaf")]
    return held.select(*kept).join(found, "__row").withColumn("depth", depth).select(*[c for c in kept if c != "__row"], "predicted", "depth", "leaf")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by…, value, name): each distinct value's average rank within `by`, without one task ranking a group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__k"))
    return running(counts, by, [value], "__k", "__before").select(*by, value, (F.col("__before") + (F.col("__k") + 1) / 2).alias(name))


def metrics(df: DataFrame, by: list[str], observed: str = "observed", predicted: str = "predicted", rank: bool = True) -> DataFrame:
    """(by…, n, r2, mae, rmse, spearman): R² NULL for fewer than two rows or a constant target, Spearman NULL where either side is constant."""
    if not rank:
        miss = F.col(observed) - F.col(predicted)
        total = F.var_pop(observed) * F.count("*")
        return df.groupBy(*by).agg(
            F.count("*").alias("n"), F.when((F.count("*") >= 2) & (F.min(observed) < F.max(observed)), 1 - F.sum(miss * miss) / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse")
        )
    # equal pairs are one row, and all is found from them: `df` is read once
    pairs = checkpointed(df.groupBy(*by, F.col(observed).alias("__o"), F.col(predicted).alias("__p")).agg(F.count("*").alias("__k")))
    o, k, miss = F.col("__o"), F.col("__k"), F.col("__o") - F.col("__p")
    known, both = F.when(o.isNotNull(), k), F.when(miss.isNotNull(), k)
    sums = checkpointed(pairs.groupBy(*by).agg(F.sum(k).alias("n"), (F.sum(k * o) / F.sum(known)).alias("__mean"), F.sum(known).alias("__known"), F.min(o).alias("__low"), F.max(o).alias("__high"), F.sum(both).alias("__both"), F.sum(k * F.abs(miss)).alias("__abs"), F.sum(k * miss * miss).alias("__squares")))
    # squares about the mean, as those of large values lose digits
    spread = with_values(pairs.select(*by, "__o", "__k"), sums.select(*by, "__mean"), by).groupBy(*by).agg(F.sum(k * (o - F.col("__mean")) * (o - F.col("__mean"))).alias("__spread"))
    total = F.col("__spread") * F.col("n") / F.col("__known")
    r2 = F.when((F.col("n") >= 2) & (F.col("__low") < F.col("__high")), 1 - F.col("__squares") / F.nullif(total, F.lit(0.0)))
    made = sums.join(spread, by).select(*by, "n", r2.alias("r2"), (F.col("__abs") / F.col("__both")).alias("mae"), F.sqrt(F.col("__squares") / F.col("__both")).alias("rmse"))
    # both sides are ranked in one go
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("__side"), F.col(c).alias("__v")) for side, c in enumerate(("__o", "__p"))]))
    counts = pairs.select(*by, "__k", sides.alias("__s")).groupBy(*by, "__s.__side", "__s.__v").agg(F.sum("__k").alias("__k"))
    centred = F.col("__before") + (F.col("__k") + 1) / 2 - (F.col("__all") + 1) / 2
    placed = checkpointed(running(counts, [*by, "__side"], ["__v"], "__k", "__before", "__all").select(*by, "__side", "__v", centred.alias("__rank")))
    side = lambda n, c, name: placed.where(F.col("__side") == n).select(*by, F.col("__v").alias(c), F.col("__rank").alias(name))
    # pairs meet the ranks of the side with more values, and go on as sums by the other's: a value in very many pairs is in no single task
    found = {r["__side"]: r["count"] for r in placed.where("__v is not null").groupBy("__side").count().collect()}
    (first, one), (second, other) = sorted(enumerate(("__o", "__p")), key=lambda s: -found.get(s[0], 0))
    a, b = F.col("__a"), F.col("__b")
    folded = pairs.join(side(first, one, "__a"), [*by, one]).groupBy(*by, other).agg(F.sum(k * a).alias("__ka"), F.sum(k * a * a).alias("__kaa"), F.sum(k).alias("__k"))
    # a constant side has no spread: NULL, not a division by zero
    correlation = F.sum(F.col("__ka") * b) / F.nullif(F.sqrt(F.sum("__kaa") * F.sum(k * b * b)), F.lit(0.0))
    ranked = folded.join(side(second, other, "__b"), [*by, other]).groupBy(*by).agg(correlation.alias("spearman"))
    return made.join(ranked, by)


def group_balanced(df: DataFrame, by: list[str], group: str, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """(by…, groups, mae, rmse): errors of each group, averaged over groups."""
    miss = F.col(observed) - F.col(predicted)
    each = df.groupBy(*by, group).agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"))
    return each.groupBy(*by).agg(F.count("*").alias("groups"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def paired_delta(per_fold: DataFrame, metric: str, baseline: str, augmented: str) -> DataFrame:
    """(fold, delta): the augmented set's metric less the baseline's, fold by fold; folds that lack either are left out."""
    wide = per_fold.groupBy("fold").pivot("feature_set", [baseline, augmented]).agg(F.first(metric))
    return wide.select("fold", scalars.finite(F.col(f"`{augmented}`") - F.col(f"`{baseline}`")).alias("delta")).where("delta is not null")


def sign_flip(deltas: DataFrame, exact: int = 15, draws: int = 10_000, seed: int = 20260915) -> DataFrame:
    """One row (n, mean_delta, p_value): the share of sign vectors whose mean is no smaller; all of them up to `exact` deltas, else `draws` seeded ones."""
    n = deltas.count()
    one = deltas.agg(F.avg("delta").alias("mean_delta"), F.array_sort(F.collect_list("delta")).alias("d"))  # one delta a fold
    if n == 0:
        return one.select(F.lit(0).alias("n"), "mean_delta", F.lit(None).cast("double").alias("p_value"))
    vectors = F.sequence(F.lit(0), F.lit(2**n - 1)) if n <= exact else F.sequence(F.lit(0), F.lit(draws - 1))
    flipped = one.select("mean_delta", "d", F.explode(vectors).alias("v"))
    total = lambda signed: F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)
    up = (lambda i: F.floor(F.col("v") / F.pow(F.lit(2.0), i)) % 2 == 1) if n <= exact else (lambda i: F.pmod(F.xxhash64("v", i, F.lit(seed)), F.lit(2)) == 1)
    signed = F.transform("d", lambda x, i: F.when(up(i), x).otherwise(-x))
    hits = flipped.select("mean_delta", (total(signed) >= total(F.col("d")) - 1e-12).alias("hit")).groupBy("mean_delta").agg(F.count_if("hit").alias("hits"), F.count("*").alias("all"))
    share = F.col("hits") / F.col("all") if n <= exact else (F.col("hits") + 1) / (F.col("all") + 1)
    return hits.select(F.lit(n).alias("n"), "mean_delta", share.alias("p_value"))


# Relationship tasks, the roles of their predictors and of their target.
TASKS = {
    "preparation_to_xps": (("preparation",), "xps"),
    "preparation_xps_to_structure": (("preparation", "xps"), "structure"),
    "xps_to_structure": (("xps",), "structure"),
    "xps_to_performance": (("xps",), "performance"),
    "structure_to_performance": (("structure",), "performance"),
    "chain_to_performance": (("preparation", "xps", "structure"), "performance"),
}
#: Predictors of a study, at most.
MOST_PREDICTORS = 40


def check_study(task: str, target: str, groups: dict[str, list[str]], controls: list[str], roles_of: dict[str, str]) -> None:
    """Raises unless the columns suit the task: the target's role, a predictor of each role and no other, test conditions as controls, no column twice, none too many."""
    inputs, output = TASKS[task]
    if roles_of.get(target) != output:
        raise ValueError(f"the target must be a column of role {output}")
    if set(groups) - set(inputs) or not any(groups.values()):
        raise ValueError(f"predictors must be of the roles {inputs}")
    if lacking := [role for role in inputs if not groups.get(role)]:
        raise ValueError(f"a variable of each role is needed: {lacking}")
    if wrong := [c for role, columns in groups.items() for c in columns if roles_of.get(c) != role] + [c for c in controls if roles_of.get(c) != "test_condition"]:
        raise ValueError(f"columns of another role: {wrong}")
    chosen = [c for columns in groups.values() for c in columns] + controls
    if len(set(chosen)) != len(chosen) or target in chosen:
        raise ValueError("a column is chosen twice")
    if len(chosen) > MOST_PREDICTORS:
        raise ValueError("too many predictors")


def feature_sets(groups: dict[str, list[str]], controls: list[str], derived: list[str] | None = None) -> dict[str, list[str]]:
    """Named predictor lists that are compared on the same rows: the controls alone (or the training mean), each role with them, all together, and, with derived columns among them, the measured ones alone."""
    sets = {"controls" if controls else "training_mean": list(controls)}
    filled = {role: columns for role, columns in groups.items() if columns}
    for role, columns in filled.items():
        sets[role] = [*controls, *columns]
    every = [*controls, *(c for columns in filled.values() for c in columns)]
    if len(filled) > 1:
        sets["combined"] = every
    if derived and set(derived) & set(every):
        sets["measured_only"] = [c for c in every if c not in derived]
    return sets
