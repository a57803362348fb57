import numpy as np
import pytest

from spectraloom.operators import forest, validation


def grow(x, y, depth, leaf):
    """A tree by recursion: of equal splits the first feature's lowest."""
    base, best = y.sum() ** 2 / len(y), None
    if depth != 0:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for a, b in zip(values, values[1:], strict=False):
                left = x[:, f] <= a
                if min(left.sum(), (~left).sum()) >= leaf:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - base
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, a + (b - a) / 2, left
    if best is None:
        return y.mean()
    _, f, at, left = best
    deeper = None if depth is None else depth - 1
    return f, at, grow(x[left], y[left], deeper, leaf), grow(x[~left], y[~left], deeper, leaf)


def told(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("leaf", [1, 3])
def test_trees_of_all_depths_match_recursion(leaf):
    rng = np.random.default_rng(0)
    for _ in range(12):
        n = int(rng.integers(2, 200))
        x = np.round(rng.normal(size=(n, 3)), 1)
        y = np.round(2 * x[:, 0] + np.abs(x[:, 1]) + rng.normal(size=n), 2)
        asked = np.round(rng.normal(size=(40, 3)), 2)
        got = forest.predicted(x, y, asked, [1], [None, 0, 1, 4], leaf, 3, bootstrap=False)
        for made, depth in zip(got, (None, 0, 1, 4), strict=True):
            tree = grow(x, y - y.mean(), depth, leaf)
            assert np.allclose(made, [told(tree, r) + y.mean() for r in asked])


def test_a_tree_is_the_same_in_any_batch_and_depth(monkeypatch):
    rng = np.random.default_rng(2)
    x, asked = rng.integers(0, 9, (400, 5)).astype(float), rng.integers(0, 9, (50, 5)).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(size=400)
    whole = forest.predicted(x, y, asked, list(range(9)), [2, None], 2, 2)
    monkeypatch.setattr(forest, "TOGETHER", 1)
    assert np.allclose(whole, sum(forest.predicted(x, y, asked, [s], [2, None], 2, 2) for s in range(9)))
    assert np.allclose(whole[0], forest.predicted(x, y, asked, list(range(9)), [2], 2, 2)[0])
    different = {tuple(np.round(forest.predicted(x, y, asked, [s], [None], 1, 2)[0], 6)) for s in range(5)}
    assert len(different) == 5  # bootstraps and choices of features differ


def test_a_constant_target_or_feature_makes_no_split():
    x, asked = np.array([[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]]), np.array([[9.0, 0.0]])
    assert forest.predicted(x, np.full(3, 4.0), asked, [0], [None], 1, 2, False).tolist() == [[4.0]]
    assert np.allclose(forest.predicted(x[:, 1:], np.array([1.0, 2.0, 6.0]), asked[:, 1:], [0], [None], 1, 1, False), 3.0)


def test_study_chooses_as_trees_grown_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 9, None if i % 11 == 0 else float(a), float(b), float(a * 3 + np.sin(3 * b) + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(180, 2)).round(1))]
    df = spark.createDataFrame(rows, "i int, paper int, a double, b double, y double")
    folds = validation.rank_folds(df, "paper", 3)
    nested = validation.nested_folds(folds, "paper", 2)
    grid = [(30, 1), (2, 1), (30, 4), (2, 4)]
    made = validation.forest_study(df, folds, "paper", ["a", "b"], "y", trees=6, nested=nested, grid=grid).collect()
    assert sorted(r.i for r in made) == list(range(180))
    fold = {r.paper: r.fold for r in folds.collect()}
    inner = {(r.outer, r.paper): r.inner for r in nested.collect()}
    paper, x, y = np.array([r[1] for r in rows]), np.array([[np.nan if r[2] is None else r[2], r[3]] for r in rows]), np.array([r[4] for r in rows])

    def fit(train, test, o, j, depth, leaf):
        train = np.flatnonzero(train)
        # the study sorts held out rows with the training ones: the order of training rows is the same
        order = train[np.lexsort((*x[train].T, y[train]))]
        fill = lambda z: np.column_stack([np.where(np.isnan(z[:, 0]), np.nanmedian(x[train][:, 0]), z[:, 0]), z[:, 1], np.isnan(z[:, 0])])
        seeds = [forest._seed(7, o, j, t) for t in range(6)]
        return forest.predicted(fill(x[order]), y[order], fill(x[test]), seeds, [None if depth == 30 else depth], leaf, 1)[0] / 6

    of = np.array([fold[p] for p in paper])
    for o in range(3):
        scores = []
        for depth, leaf in grid:
            each = []
            for j in range(2):
                own = np.array([inner.get((o, p), -1) for p in paper])
                test = np.flatnonzero((of != o) & (own == j))
                miss = np.abs(fit((of != o) & (own != j), test, o, j, depth, leaf) - y[test])
                each.append(np.mean([miss[paper[test] == p].mean() for p in set(paper[test])]))
            scores.append(np.mean(each))
        best = grid[int(np.argmin(scores))]
        test = np.flatnonzero(of == o)
        want = dict(zip(test.tolist(), fit(of != o, test, o, -1, *best), strict=True))
        got = {r.i: r for r in made if r.fold == o}
        assert {(r.depth, r.leaf) for r in got.values()} == {best}
        assert all(abs(got[i].predicted - want[i]) < 1e-9 for i in want)


def test_larger_tables_go_to_sparks_learner(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 8, float(a), float(5 * (a > 0))) for i, a in enumerate(rng.normal(size=160))], "i int, paper int, a double, y double")
    folds = validation.rank_folds(df, "paper", 2)
    both = []
    for most in (forest.MOST_VALUES, 10):
        monkeypatch.setattr(forest, "MOST_VALUES", most)
        made = validation.forest_study(df, folds, "paper", ["a"], "y", trees=4, depth=3).collect()
        assert sorted(r.i for r in made) == list(range(160))
        both.append(np.mean([(r.y - r.predicted) ** 2 for r in made]))
    assert max(both) < 0.5


@pytest.mark.parametrize("bootstrap", [False, True])
def test_sums_by_tree_against_draws_one_by_one(spark, bootstrap):
    rng = np.random.default_rng(8)
    rows = [(int(c), int(e), int(k), float(y)) for c, e, k, y in zip(rng.integers(0, 3, 6000), np.where(rng.random(6000) < 0.7, 2, rng.integers(0, 9, 6000)), rng.integers(-(2**62), 2**62, 6000), rng.normal(size=6000), strict=True)]
    rows += [(1, 2, 5, 0.5)] * 900  # equal rows, each of which is drawn on its own
    df = spark.createDataFrame(rows, "cell int, entry int, key bigint, y double").repartition(5)
    got = np.zeros((3, 3, 9, 10))
    for r in forest.tree_sums(df, 10, 4, 3, bootstrap, together=2).collect():
        at, values = forest.unpacked(r.asDict(), len(range(r["batch"], 10, 4)))
        for t, v in zip(got, values, strict=True):
            t[(*at, slice(r["batch"], None, 4))] += v
    want, seen = np.zeros_like(got), {}
    for c, e, k, y in rows:
        place = seen[c, e, k] = seen.get((c, e, k), -1) + 1
        key = np.array([k], np.int64).view(np.uint64) + np.array([place], np.uint64) * forest._ODD
        drawn = forest.times(key, 10, 3)[0].astype(float) if bootstrap else np.ones(10)
        for t, v in zip(want, (drawn > 0, drawn, drawn * y), strict=True):
            t[c, e] += v
    assert np.allclose(got, want)
    if bootstrap:
        assert abs(got[1].sum() / 69_000 - 1) < 0.02 and abs(got[0].sum() / 69_000 - (1 - np.exp(-1))) < 0.01
        equal = [forest.times(np.array([5], np.uint64) + np.array([i], np.uint64) * forest._ODD, 10, 3)[0].tolist() for i in range(900)]
        assert len(set(map(tuple, equal))) > 850


def test_large_tables_of_few_distinct_rows_move_sums_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, i % 9, None if i % 11 == 0 else float(a), float(b), float(a * 3 + np.sin(3 * b) + rng.normal())) for i, (a, b) in enumerate(rng.integers(-3, 4, (240, 2)))]
    df = spark.createDataFrame(rows, "i int, paper int, a double, b double, y double")
    folds = validation.rank_folds(df, "paper", 3)
    nested = validation.nested_folds(folds, "paper", 2)
    grid = [(30, 1), (2, 1), (30, 4), (2, 4)]

    def study(bootstrap):
        return {r.i: r for r in validation.forest_study(df, folds, "paper", ["a", "b"], "y", trees=7, nested=nested, grid=grid, bootstrap=bootstrap).collect()}

    whole, drawn = study(False), study(True)
    monkeypatch.setattr(forest, "SUMMED_FROM", 1)
    monkeypatch.setattr(forest, "fitted", None)  # no task is sent a fit's rows
    got, some = study(False), study(True)
    assert set(got) == set(whole) == set(some)
    assert all(abs(got[i].predicted - w.predicted) < 1e-9 and (got[i].fold, got[i].depth, got[i].leaf) == (w.fold, w.depth, w.leaf) for i, w in whole.items())
    miss = lambda made: np.mean([(r.y - r.predicted) ** 2 for r in made.values()])
    assert miss(some) < 1.15 * miss(drawn)
