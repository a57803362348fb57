import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import minhash


def brute(rows, width, percent):
    sets, parent = {}, {}
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in lower).split(" ") if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def rows():
    rng = random.Random(2)
    out = [None, "", "  ", "one", "one", "One two", "one two", "a b c", "A B C", "x" * 3000, "é É é"]
    for length in (12, 40, 200, 900):
        for _ in range(6):
            base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 21):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(length)] = f"n{rng.randint(0, 99999)}"
                out.append(" ".join(copy))
    chain = [f"c{i}" for i in range(400)]
    for k in range(0, 200, 6):  # each links with its neighbours alone
        out.append(" ".join(chain[k : k + 200]))
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    df = spark.createDataFrame([(*r, 7) for r in rows()], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute(rows(), width, percent)


def test_ties_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, None)], schema)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (None, None, True)], key=str)


def test_chunks_leave_one_with_at_most_one_error():
    for percent in (70, 80, 85, 95):
        radius = minhash.tail_radius(1 - percent / 100)
        parts = minhash.chunks(radius)
        assert parts[0][0] == 0 and parts[-1][1] == minhash.COMPONENTS and all(b - a >= 2 for a, b in parts)
        assert 2 * len(parts) > radius


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    radius = minhash.tail_radius(0.15)
    keys = minhash._keys_udf(radius).func
    for _ in range(200):
        a = rng.integers(0, 256, minhash.COMPONENTS).astype(np.uint8)
        b = a.copy()
        b[rng.choice(minhash.COMPONENTS, radius, replace=False)] ^= 1
        x, y = keys(pa.array([a.tobytes(), b.tobytes()])).to_pylist()
        assert set(x) & set(y)


def test_first_shared_key():
    rng = np.random.default_rng(4)
    radius = minhash.tail_radius(0.15)
    keys = minhash._keys_udf(radius).func
    for _ in range(60):
        a = rng.integers(0, 256, minhash.COMPONENTS).astype(np.uint8)
        b = a.copy()
        at = rng.choice(minhash.COMPONENTS, rng.integers(0, 40), replace=False)
        b[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
        x, y = keys(pa.array([a.tobytes(), b.tobytes()])).to_pylist()
        same = [k for k in range(minhash.COMPONENTS) if x[k] == y[k]]
        assert minhash.first_shared((a != b)[None, :], radius)[0] == (same[0] if same else -1)


def test_planes(spark):
    raw = bytes(range(100, 164))
    row = spark.createDataFrame([(bytearray(raw),)], "s binary").select(*minhash.planes("s")).first()
    for k in range(4):
        assert row[k] & (2**64 - 1) == int("".join(str(x >> k & 1) for x in raw), 2)


def test_bucket_counts_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 65, 300, 1000, 5000):
        for share in (0.99, 0.85, 0.6, 0.1):
            both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)) or 1).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, m).astype(np.uint64)])) for m in (n - len(both) + 1, int(n * rng.uniform(0, 0.15)) + 1))
            counts = [np.frombuffer(minhash.bucket_counts(x), np.uint8) for x in (a, b)]
            if not len(counts[0]) // 2 <= len(counts[1]) <= 2 * len(counts[0]):
                continue
            held, place = next((h, p) for h, p in minhash._levels(counts).values() if (p >= 0).all())
            bound, shared = int(minhash.shared_bound(held[place[:1]], held[place[1:]])[0]), len(np.intersect1d(a, b))
            assert bound >= shared
            if n >= 300 and share < 0.7:
                assert bound / (len(a) + len(b) - bound) < 0.85  # and it does rule out what is far
    same = np.arange(1000, dtype=np.uint64) << np.uint64(40)  # all in one bucket
    full = np.frombuffer(minhash.bucket_counts(same), np.uint8)[None, :].astype(np.uint16)
    assert minhash.shared_bound(full, full)[0] > 1000


def test_signature_distance_follows_the_binomial():
    """The radius rests on this: mean and spread of the differing components, at the threshold itself."""
    rng = np.random.default_rng(3)
    for share in (0.85, 0.8):
        far = []
        for _ in range(3000):
            n = int(rng.integers(20, 400))
            shared = max(1, round(2 * n * share / (1 + share)))
            both = rng.integers(0, 2**63, shared).astype(np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n - shared).astype(np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(minhash._signature(v.astype(np.uint32)), np.uint8) for v in (a, b))
            far.append([int((x != y).sum()), shared / (2 * n - shared)])
        far = np.array(far)
        want = minhash.COMPONENTS * (1 - far[:, 1])
        spread = np.sqrt(minhash.COMPONENTS * far[:, 1] * (1 - far[:, 1]))
        z = (far[:, 0] - want) / spread
        assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.08 and np.mean(z > 3) < 0.005
        assert far[far[:, 1] >= share, 0].max() <= minhash.tail_radius(1 - share)


@pytest.mark.parametrize("block", [4096, 40])
def test_large_group_of_mutated_copies(spark, monkeypatch, block):
    """Variants of one text, from near to far: no pair of different components may be lost."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(120)] = f"n{rng.randint(0, 9999)}"
        out.append((i, " ".join(copy)))
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=3, percent=85).collect()}
    assert got == brute(out, 3, 85)


def test_very_long_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 50000)}" for _ in range(120_000)]
    near, far = list(base), list(base)
    for at in rng.sample(range(120_000), 3000):
        near[at] = "n"
    for at in rng.sample(range(120_000), 15_000):
        far[at] = "f"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "a " * 300_000), (5, "a " * 299_999 + "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80)


def test_components_fed_with_components_keep_plans_small(spark):
    """Plans' estimates of size, products of those of all joined tables, once grew in digits with each round until they filled the driver."""
    links, last = spark.range(64).selectExpr("id as a", "id + 1 as b"), None
    for _ in range(2):
        last = minhash.components(links)
        links = links.join(last.toDF("a", "component"), "a").select("a", "b")
    assert {tuple(r) for r in last.collect()} == {(i, 0) for i in range(65)}
    assert last._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
