import random

import numpy as np
import public_tokenizers
import pytest

from spectraloom.llm import bpe

WORDS = ["don't", "élève", "a", "  ", "\n\n", "12345", "x" * 90, "...", "日本語", " \t ", "I'll", " ", "😀!", "'s", "'"]


def brute(text):
    return bpe.encoding(bpe.ranks_file(), public_tokenizers.PATTERN).encode_ordinary(text or "")


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 64), (200, 30)])
def test_chunks_match_the_library(spark, chunk, overlap):
    rng = random.Random(7)
    texts = ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(n)) for n in (0, 1, 5, 40, 200, 400)]
    texts += [None, "", "y" * 1000, " " * 500, "\n \n" * 150, "word " * 100 + "\n\n" + "z" * 300 + " end", texts[3], texts[3]]
    df = spark.createDataFrame([(i % 12, t, "ids?") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    rows = bpe.encode(df, chunk=chunk, overlap=overlap, decoded_col="own").select("doc_id", "text", "ids", "own", bpe.decode("ids", spark).alias("raw")).collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i % 12, t or "") for i, t in enumerate(texts))
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == brute(r.text), r.text
        assert bytes(r.raw) == bytes(r.own) == (r.text or "").encode()


def test_empty_table_and_unpacked(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.encode(df).columns == ["doc_id", "text", "ids"] and bpe.encode(df).count() == 0
    one = bpe.encode(spark.createDataFrame([("Hello there",), (None,)], "text string")).select("text", bpe.unpacked("ids").alias("n")).collect()
    assert {r.text: r.n for r in one} == {"Hello there": brute("Hello there"), None: []}


def test_a_very_long_text(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh é中") for _ in range(rng.randint(1, 12))) for _ in range(400_000))
    (row,) = bpe.encode(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("ids", bpe.decode("ids", spark).alias("raw")).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == brute(text) and bytes(row.raw) == text.encode()
