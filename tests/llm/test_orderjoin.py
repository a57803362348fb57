import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from spectraloom.llm import orderjoin
from spectraloom.llm.textbatch import spread
from tests.llm.test_minhash import brute, rows


def like(rng):
    """A large group of near copies of one text, and texts of the same frequent lines in other orders."""
    base = [f"b{i}" for i in range(120)]
    out = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            copy[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    lines = [" ".join(f"l{i}x{j}" for j in range(9)) for i in range(12)]
    for _ in range(60):
        out.append(" ".join(rng.sample(lines, 8)))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    data = rows() + [(10_000 + i, t) for i, t in enumerate(like(random.Random(8)))]
    df = spark.createDataFrame([(*r, 7, b"x") for r in data], "doc_id long, text string, component_id int, keys binary")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in orderjoin.jaccard_groups(df, width=width, percent=percent).collect()}
    assert got == {i: r[:2] for i, r in brute(data, width, percent).items()}


def test_ties_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert orderjoin.jaccard_groups(spark.createDataFrame([], schema)).count() == 0
    got = orderjoin.jaccard_groups(spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, None), (9, " ")], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("4", 2, "4"), ("4", 2, "4"), ("None", 2, "4"), ("None", 1, "None"), ("None", 0, "None"), ("9", 0, "9")])


def test_prefixes_of_similar_sets_meet_under_every_order():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 9, orderjoin.BUCKETS).astype(np.uint8)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.r_[x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)])
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= percent * (len(x) + len(y) - shared):
                firsts = [[orderjoin._first(f(s), orderjoin.prefix_length(len(s), percent)) for s in (x, y)] for f in (lambda s: orderjoin.rare_first(s, levels), lambda s: orderjoin.mixed(s ^ orderjoin.SECOND), lambda s: orderjoin.mixed(s ^ orderjoin.THIRD))]
                assert all(len(np.intersect1d(a, b)) for a, b in firsts)


def test_profiles_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 3, 40, 3000, 60_000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for share in (1.0, 0.97, 0.92, 0.5):
            y = np.unique(np.r_[x[rng.random(len(x)) < share], rng.integers(0, 1 << 63, max(1, n // 30)).astype(np.uint64)])
            shared = len(np.intersect1d(x, y))
            p, q = (np.frombuffer(orderjoin.profile(s), np.uint8)[None, :] for s in (x, y))
            may = orderjoin.may_link(np.array([len(x)]), np.array([len(y)]), p, q, 90)[0]
            assert may or 100 * shared < 90 * (len(x) + len(y) - shared)
    a, b = (np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    assert not orderjoin.may_link(np.array([len(a)]), np.array([len(b)]), *(np.frombuffer(orderjoin.profile(s), np.uint8)[None, :] for s in (a, b)), 90)[0]


def test_levels_count_all_documents_whatever_the_partitions(spark):
    df = spark.createDataFrame([(f"same words here n{i}",) for i in range(300)] + [(None,), ("",)], "text string")
    few, many = (orderjoin.token_levels(df.repartition(n), 3) for n in (1, 70))
    assert (few == many).all() and few.max() == 9 and (few > 0).sum() <= 301


@pytest.mark.parametrize("percent", [50, 75, 80, 90, 97, 100])
def test_sets_that_link_share_a_key(percent):
    rng = np.random.default_rng(percent)
    levels = rng.integers(0, 9, orderjoin.BUCKETS).astype(np.uint8)
    keys = lambda s: orderjoin.cell_keys(orderjoin.rare_first(s, levels), s, percent, 8)
    linked = 0
    for n in [*range(1, 60), *rng.integers(60, 3000, 60).tolist()]:
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        fewest = -(-percent * n // 100)
        swapped = (n - -(-2 * percent * n // (100 + percent))) if percent < 100 else 0
        subset, other = np.sort(rng.permutation(x)[:fewest]), np.unique(np.r_[rng.permutation(x)[swapped:], rng.integers(0, 1 << 64, swapped, dtype=np.uint64)])
        for y in (x, subset, other):
            shared = len(np.intersect1d(x, y))
            assert 100 * shared >= percent * (len(x) + len(y) - shared)
            assert len(np.intersect1d(keys(x), keys(y)))
            linked += 1
    assert linked == 357


def test_single_shared_tokens_make_no_shared_keys(spark):
    """Five of six shingles are held by three documents and their counts, all alike, don't tell: as in a table of any size whose buckets are crowded."""
    rng = random.Random(3)
    lines = [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(1600)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(lines, 16))) for i in range(300)], "doc_id long, text string")
    levels = np.full(orderjoin.BUCKETS, 7, np.uint8)
    keyed = spread(docs, F.col("text"), "__m", orderjoin._sketcher(3, 90, levels)).select("doc_id", F.explode("keys").alias("key"))
    held = keyed.groupBy("key").agg(F.countDistinct("doc_id").alias("n")).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("twice")).first()
    assert held["all"] > 3000 and held["twice"] < 0.01 * held["all"]
