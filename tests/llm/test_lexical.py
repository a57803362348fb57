import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spectraloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_all = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, sizes, strict=True):
            if n:
                m = 100 - 50 + (50 * n * n_docs) // n_all
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) & set(c))
                if score > 0:
                    found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünï", "naïve", "X9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(None if i == 7 else i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)] + [(2000, None), (2001, ""), (2002, " .,;-\t"), (2003, "w1 " * 30_000), (2003, "w1 " * 30_000), (2004, "W1_w2,w3\x00w4")]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(25)] + [(3, "w1 w1 W1"), (None, "É w2"), (90, None), (91, ""), (92, "nowhere found"), (93, "ünï")]
    return items, docs


@pytest.mark.parametrize("bucket,trie", [(32, 1 << 14), (2, 40)])
def test_ranks_match_brute_force(spark, monkeypatch, bucket, trie):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "TRIE_DOCS", trie)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 9)
    items, docs = corpus()
    df = spark.createDataFrame([(*d, 1.0, 5) for d in docs], "doc_id long, text string, score double, rank int").repartition(3)
    got = lexical.ranked(spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"), df, k=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(items, docs, 20)


def test_empty_tables_and_text_ids(spark):
    items, docs = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([], "doc_id string, text string")
    assert lexical.ranked(items, docs).count() == 0
    assert lexical.ranked(items.limit(0), docs).count() == 0
    assert lexical.ranked(items, spark.createDataFrame([("x", None), ("y", "")], docs.schema)).count() == 0
    got = lexical.ranked(items, spark.createDataFrame([("x", "a c"), ("b", "a c"), (None, "a c"), ("q", "z")], docs.schema)).collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(1, "b"), (2, "x"), (3, None)]


def test_subtree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    n, v = 3000, 50
    lengths = rng.integers(1, 12, n)
    ranks = np.concatenate([np.sort(rng.choice(v, size, replace=False, p=(p := 1 / np.arange(1, v + 1)) / p.sum())) for size in lengths])
    counts, m = rng.integers(1, 9, len(ranks)), rng.integers(50, 300, n)
    trie = lexical.Trie(list(range(n)), m, np.concatenate([[0], np.cumsum(lengths)]), ranks, counts, v)
    leaves = [i for i, kids in enumerate(trie.kids) if not kids]
    assert sorted(x for i in leaves for x in range(trie.low[i], trie.high[i])) == list(range(n))
    assert all(trie.high[i] - trie.low[i] < 2 * lexical.BUCKET for i in leaves)
    for term in range(v):
        held = slice(trie.term_at[term], trie.term_at[term + 1])
        for node, top in zip(trie.node_of[held].tolist(), trie.top[held].tolist(), strict=True):
            below = slice(trie.starts[trie.low[node]], trie.starts[trie.high[node]])
            assert trie.counts[below][trie.ranks[below] == term].max() == top
            assert trie.m[trie.low[node] : trie.high[node]].min() == trie.least_m[node]
