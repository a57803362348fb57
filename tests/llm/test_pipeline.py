import random
import zlib

import duckdb
import numpy as np
from test_language_mixing_embedding import SlowModel
from test_minhash import brute
from test_secrets_pii import plain_search

import corpus_pipeline as cp
from spectraloom.llm import bpe, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(3)
    words = {"en": [f"the{i}ing" for i in range(400)], "de": [f"ge{i}ung" for i in range(400)]}
    out = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(words[lang]) for _ in range(60))
        out.append((i, text + (f" mail bob.{i}@example.org 4845168114407329" if i % 5 == 0 else ""), lang, f"s{i % 3}"))
    out += [(200 + i, out[i][1], out[i][2], "s1") for i in range(10)]  # copies
    out += [(300, "12345 --- 999", "en", "s0"), (301, None, "en", "s0"), (302, "", None, None), (None, "the1ing the2ing without an id", "en", "s0"), (None, out[3][1], "de", "s0")]
    return [(*r, len(r[1] or "")) for r in out]


def test_stages(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA + ", extra string")
    step1 = cp.language_id(spark, docs, "")
    ids1 = sorted((r.doc_id for r in step1.collect()), key=str)
    assert ids1 == sorted((r[0] for r in rows() if r[0] not in (300, 301, 302)), key=str)
    step2 = cp.near_dedup(spark, step1, "")
    ids2 = sorted((r.doc_id for r in step2.collect()), key=str)
    assert ids2 == sorted([*range(120), None], key=str)
    step3 = cp.pii_pseudonyms(spark, step2, "")
    before = {r.doc_id: r.text for r in step2.collect()}
    for r in step3.collect():
        assert r.text == pii.replaced(cp.KEY.encode(), before[r.doc_id])[0] and r.n_chars == len(r.text)
        assert "4845168114407329" not in r.text
    step4 = cp.source_mix(spark, step3, "")
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(step3).collect()}
    counts = {}
    for r in step4.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert {i: counts.get(i, 0) * size for i, (size, _) in plan.items()} == {i: taken for i, (_, taken) in plan.items()}
    assert step4.columns == list(cp.COLUMNS)
    texts = {r.doc_id: r.text for r in step3.collect()}
    own = bpe.encoding(bpe.ranks_file(), bpe.public_tokenizers.PATTERN)
    last = cp.byte_bpe(spark, step4, "").collect()
    assert len(last) == sum(counts.values())
    for r in last:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids) // 4


def test_empty_input(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_whole_pipeline_matches_brute_force(spark, tmp_path):
    """All five stages against plain Python (and DuckDB for the mix), none of it the library's."""
    data = [r for r in rows() if r[0] is not None]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.lang, r.source, np.frombuffer(r.ids, "<u4").tolist()) for r in cp.run(spark, str(tmp_path)).collect())
    # language: words, then ever shorter n-grams
    slow = SlowModel([(r[1], r[2]) for r in data if r[1] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 5])
    told = [(r, slow.predict(r[1])) for r in data]
    kept = [r for r, (lang, score) in told if lang != "und" and score >= cp.LEAST_SCORE]
    assert 100 < len(kept) < len(data)
    # near duplicates: all pairs of whole sets
    classes = brute([r[:2] for r in kept], 5, 80)
    kept = [r for r in kept if classes[r[0]][2]]
    assert len(kept) == 120
    # personal data: one alternation, leftmost first
    kept = [(r[0], plain_search(cp.KEY.encode(), r[1])[0], *r[2:4]) for r in kept]
    # the mix
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", kept)
    times = "CAST(u.size * least(u.whole + u.drawn, 3) AS BIGINT) AS taken"
    assert times in mixing.MIX_SQL
    copies = {r[0]: r[4] for r in con.execute(mixing.MIX_SQL.replace(times, "CAST(least(u.whole + u.drawn, 3) AS BIGINT) AS taken")).fetchall()}
    # tokens
    own = bpe.encoding(bpe.ranks_file(), bpe.public_tokenizers.PATTERN)
    want = sorted((i, lang, source, own.encode_ordinary(text)) for i, text, lang, source in kept for _ in range(copies[i]))
    assert got == want
