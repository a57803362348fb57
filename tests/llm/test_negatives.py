import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import negatives


def brute(rows, anchors, positives=5, k=10, low=30, high=90):
    held = {i: (label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None for x in v)}
    out = []
    for a in held:
        if a % anchors == 0:
            label, q = held[a]
            score = {i: sum(x * y for x, y in zip(q, v, strict=False)) for i, (_, v) in held.items() if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if held[i][0] == label][:positives]:
                fits = [i for i in order if held[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
                out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits[:k], 1)]
    return sorted(out)


def rows(n=2500, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    v = np.floor(rng.normal(size=(n, dims)) * np.linspace(200, 20, dims)).astype(int)
    v[100:700] = v[5]  # a third are one vector
    out = [(i, int(rng.integers(0, 4)), v[i].tolist()) for i in range(n)]
    return out + [(9000, None, v[0].tolist()), (9100, 1, None), (9200, 1, [None] * dims), (None, 1, v[1].tolist()), (9300, 2, []), (9400, 2, [500]), (9500, 3, [0] * dims)]


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 10, 1 << 11), (200, 50, 16)])
def test_windows_match_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("ROWS", "FEWEST", "ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data + data[:40]], "vec_id long, label int, embedding array<long>, rank int")  # rows repeat
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(data, 100)


def test_empty_tables_few_rows_and_large_numbers(spark):
    schema = "vec_id long, label string, embedding array<long>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, "a", [1]), (1, "b", [1])], schema), F.col("vec_id") == 0).count() == 0
    large = [(0, "a", [1 << 30, 3]), (1, "a", [1 << 30, 1]), (2, "b", [1 << 29, 1]), (3, "b", [(1 << 29) + 1, 0]), (4, "b", [1 << 29, 1])]
    got = negatives.hard_negatives(spark.createDataFrame(large, schema), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute(large, 100)


def test_integers_and_complete_vectors(spark):
    df = spark.sql("select * from values (1, array(0.5f, -0.001f)), (2, array(1f, null)), (3, array(1f, float('nan'))), (4, array(float('inf'))), (5, null), (6, array()) as t(i, v)")
    got = {r.i: r.s for r in df.where(negatives.complete("v")).select("i", negatives.scaled("v").alias("s")).collect()}
    assert got == {1: [128, -1], 6: []}


def test_index_leaves_out_dimensions_and_loses_no_pair():
    rng = np.random.default_rng(7)
    held = (rng.normal(size=(500, 40)) * np.linspace(300, 3, 40)).astype(np.int64)
    for share in (50.0, 300.0, 900.0):
        index = negatives.Index(held, share)
        assert (index.cut < 40).all() and (share < 400 or (index.cut == 0).any())
        norms = np.sqrt(np.square(held).sum(axis=1))
        least = share * norms[:60]
        i, j = index.candidates(held[:60], least)
        pairs = set(zip(i.tolist(), j.tolist(), strict=True))
        scores = held[:60] @ held.T
        assert {(a, b) for a, b in zip(*np.nonzero(scores >= least[:, None]), strict=True)} <= pairs
        assert len(pairs) < 60 * 500 and not math.isnan(norms.sum())
