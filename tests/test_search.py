import random

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import literature, search

EVIDENCE = "evidence_id string, doc_key string, claim string, confidence double"


def tables_of(spark):
    rng = random.Random(3)
    words = ["membrane", "flux", "XPS", "peak", "the", "of", "100%", "a_b", "Énergie", "\\frac", "nitrogen"]
    rows = [(f"e{i:03}", f"d{i % 40}", None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 6))), None if i % 5 == 0 else rng.random()) for i in range(400)]
    docs = [(f"d{i}", None if i % 9 == 0 else " ".join(rng.choices(words, k=3))) for i in range(38)]
    return spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame(docs, "doc_key string, title string")


def index(spark, path, evidence, docs):
    texts = evidence.selectExpr("'claim' as kind", "evidence_id as id", "claim as text").unionByName(docs.selectExpr("'title' as kind", "doc_key as id", "title as text"))
    search.indexed(texts.where("id < 'e1'"), path, 0)
    search.indexed(texts.where("id >= 'e1'"), path, 1)
    return texts


def test_the_index_gives_the_rows_of_the_scan(spark, tmp_path):
    evidence, docs = tables_of(spark)
    at = str(tmp_path / "index")
    texts = index(spark, at, evidence, docs)
    search.indexed(texts.where("id >= 'e1'"), at, 1)  # a rerun
    for query in ("the%of", "FLUX", "membrane flux", "a\\_b", "100\\%", "énergie", "x_s", "ea", "", "%", "nowhere", "peak of", "Mem%XPS", "\\\\frac"):
        want = literature.searched(evidence, docs, query, 1000).select("evidence_id", "title").collect()
        got = search.searched(evidence, docs, at, query, 1000).select("evidence_id", "title").collect()
        assert got == want, query


def test_the_index_rules_most_rows_out(spark, tmp_path):
    evidence, docs = tables_of(spark)
    at = str(tmp_path / "index")
    index(spark, at, evidence, docs)
    near = search.candidates(spark, at, "nitrogen xps")
    hits = evidence.where("claim ilike '%nitrogen xps%'").count()
    assert 0 < hits <= near.where("kind = 'claim'").count() < 120
    read = near.inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in read} and search.candidates(spark, at, "ab") is None
    assert search.candidates(spark, at, "nowhere to be found").count() == 0


def test_rows_that_changed_after_they_were_indexed(spark, tmp_path):
    evidence, docs = tables_of(spark)
    at = str(tmp_path / "index")
    index(spark, at, evidence, docs)
    now = evidence.selectExpr("evidence_id", "doc_key", "upper(replace(claim, 'flux', 'gone')) as claim", "confidence")
    assert search.searched(now, docs.where("title not like '%flux%'"), at, "flux").count() == 0


@pytest.mark.parametrize("query,parts", [("a%b_c", ["a", "b", "c"]), ("\\%x\\_", ["%x_"]), ("", []), ("%%", []), ("end\\", ["end\\"])])
def test_literal_parts(query, parts):
    assert search.literals(query) == parts


def test_trigrams_of_long_lines_take_linear_time(spark):
    import time

    text = "".join(chr(97 + (i * i + i // 7) % 26) if i % 11 else "é😀"[i % 2] for i in range(300_000))
    df = spark.createDataFrame([(text,), ("aB",), ("",), (None,), ("AbCaB",)], "text string")
    t0 = time.monotonic()
    made = [r[0] for r in df.select(F.size(search._grams("text"))).collect()]
    assert time.monotonic() - t0 < 20
    assert made[0] == len({text[i : i + 3] for i in range(len(text) - 2)})
    assert made[4] == 3 and all(n in (-1, None) for n in made[1:4])
    hashes = df.where("text = 'AbCaB'").select(search._grams("text"), F.array(*[F.xxhash64(F.lit(g)) for g in ("abc", "bca", "cab")])).first()
    assert hashes[0] == hashes[1]  # the postings of before stay valid


def test_postings_take_few_bytes(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(400)]
    texts = spark.createDataFrame([("claim", f"{rng.getrandbits(128):032x}", " ".join(rng.choices(words, k=40))) for _ in range(3000)], "kind string, id string, text string")
    search.indexed(texts, str(tmp_path), 0)
    postings = texts.select(F.sum(F.size(search._grams("text")))).first()[0]
    # with its text's name a posting took over 12
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 6 * postings
    want = {r.id for r in texts.where("text ilike '%eta%'").collect()}
    assert want == {r.id for r in search.candidates(spark, str(tmp_path), "eta").collect()}
