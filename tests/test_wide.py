import numpy as np
import pytest

from spectraloom.operators import study, validation, wide


def rows(n=600, levels=40):
    rng = np.random.default_rng(11)
    effect = rng.normal(size=levels) * 3
    out = []
    for i in range(n):
        at = 0 if i % 3 == 0 else int(rng.integers(levels))  # a third of the rows are of one level
        a, kind = rng.normal(), ("p", "q", None)[int(rng.integers(3))]
        y = 100 + 2 * a + effect[at] + (1 if kind == "q" else 0) + 0.3 * rng.normal()
        out.append((i, f"g{i % 24:02}", None if i % 9 == 0 else float(a), kind, None if at == 1 else f"v{at:03}", float(y)))
    return out


SETS = {"training_mean": [], "all": ["a", "kind", "v"], "level": ["v"], "plain": ["a", "kind"]}
GRID = [("ridge", 1.0, 0.0), ("ridge", 10.0, 0.0), ("net", 0.001, 0.5), ("net", 0.01, 0.95), ("net", 0.1, 0.05), ("net", 1.0, 0.5), ("net", 10.0, 0.95)]


def test_levels_without_columns_give_the_dense_study(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "i int, g string, a double, kind string, v string, y double")
    # two full sets of levels and a small penalty: the dense descent needs more rounds than its own limit to end
    monkeypatch.setattr(validation.elastic_nets, "__defaults__", (100_000, 1e-12))
    made = []
    for most in (512, 12):
        monkeypatch.setattr(study.Design.__init__, "__defaults__", (most,))
        got, _, chosen = study.compared(df, SETS, "g", "y", k=3, inner=2, grid=GRID)
        made.append(({(r.feature_set, r.i): r.predicted for r in got.collect()}, chosen))
    (dense, best), (eliminated, same) = made
    assert best == same
    assert len(dense) == len(eliminated) == 4 * 600
    assert max(abs(dense[k] - eliminated[k]) for k in dense) < 1e-5


@pytest.mark.parametrize("candidate", range(len(GRID)))
def test_weights_match_the_dense_solve(spark, candidate):
    rng = np.random.default_rng(candidate)
    n, levels = 300, 25
    at = rng.integers(0, levels, n)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 3))])
    y = x @ [0.0, 2.0, -1.0, 0.0] + rng.normal(size=levels)[at] * 2 + 0.1 * rng.normal(size=n)
    y -= y.mean()
    held = np.column_stack([x, np.eye(levels)[at], y])
    want = validation.solved(held.T @ held, [GRID[candidate]])[0]
    df = spark.createDataFrame([(int(k), 0, r.tolist(), float(v)) for k, r, v in zip(at, x, y, strict=True)], "level int, cell int, x array<double>, y double")
    sums = wide.level_sums(df, 4, 1)
    both = np.column_stack([x, y])
    fit = wide.Fit([0], np.eye(5), both.T @ both, [GRID[candidate]])
    (beta,) = wide.solved(sums, [fit], [GRID[candidate]], 5, 1)
    assert np.allclose(beta[0], want[:4], atol=1e-6)
    got = {r.level: wide.level_weights(fit, beta, np.array(r.s).reshape(1, 1, 5), np.array([0]))[0, 0] for r in sums.collect()}
    assert np.allclose([got.get(k, 0.0) for k in range(levels)], want[4:], atol=1e-6)


def test_many_levels(spark):
    df = spark.range(60_000).selectExpr("id as i", "concat('g', id % 30) as g", "cast(id % 7 as double) as a", "concat('v', hash(id) % 20000) as v", "cast(id % 7 as double) + pmod(hash(id), 20000) % 10 as y")
    made, _, chosen = study.compared(df, {"mean": [], "all": ["a", "v"]}, "g", "y", k=3, grid=[("ridge", 1.0, 0.0)])
    miss = {r.feature_set: r.m for r in made.groupBy("feature_set").agg({"predicted": "count"}).withColumnRenamed("count(predicted)", "m").collect()}
    assert miss == {"mean": 60_000, "all": 60_000} and len(chosen["all"]) == 3
    error = {r.feature_set: r.e for r in made.selectExpr("feature_set", "abs(observed - predicted) as e").groupBy("feature_set").avg("e").withColumnRenamed("avg(e)", "e").collect()}
    assert error["all"] < 0.7 * error["mean"]
