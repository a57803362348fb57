import random
import re
import time
from collections import Counter

import pyarrow as pa
import regex

from spectraloom.llm import licenses, quality, textbatch

ODD = [None, "", " ", "\n", "one", "a b", "cc", "by", "CC-BY", "cc  by cc by", "#*$%&|<> x", "é è à", "a b c a b c a b c", "x\nx\n\nx\n \n", "ſtrange ALL rights, Reserved.", "all rights reservedé"]
LONG = "word " * 3000 + "Licenced under the Apache Licence, Version 2.0. " + "Ünd so weiter\n" * 300


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_stats(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "ä", "cc", "by", "all", "rights", "reserved", "General", "PUBLIC", "license", "#1", "|", "\n", "x"]
    made = [rng.choice([" ", "\n", "\t"]).join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 30, 60, 200, 400) for _ in range(6)]
    return ODD + made + [LONG, LONG]


def test_stats_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id int, text string, n_words int")
    rows = quality.rule_stats(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert tuple(r[x] for x in quality.STATS) == brute_stats(r.text), r.text


def brute_places(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(label, i) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted(found, key=lambda x: (x[1], x[0]))


def test_base_phrases_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    for r in licenses.license_scan(df).collect():
        assert (r.n_words, [(p.label, p.word) for p in r.places]) == brute_places(r.text), r.text


def test_fuzzy_notices_show_spans(spark):
    exact = "Für: Released under the MIT License."
    typo = "x Released undr the MIT Licence! All rihgts reserved"
    got = {r.text: r for r in licenses.license_scan(spark.createDataFrame([(exact,), (typo,), (LONG,), ("The license of the poet",)], "text string")).collect()}
    (a,) = got[exact].notices
    assert (a.label, exact[a.start : a.end], a.errors) == ("mit", "Released under the MIT License", 0)
    assert [x.label for x in got[typo].notices] == ["mit"] or [x.label for x in got[typo].notices] == ["mit", "reserved"]
    assert typo[got[typo].notices[0].start : got[typo].notices[0].end].startswith("Released undr the MIT Licen")
    (b,) = got[LONG].notices
    assert b.label == "apache-2.0" and LONG[b.start : b.end].startswith("Licenced under the Apache Licence, Version 2.0")
    assert got["The license of the poet"].notices == []


def test_judged_keeps_good_and_handles_missing_labels(spark):
    good = [(i, " ".join(f"wort{(i * 7 + k * 13) % 997}" for k in range(80 + i)), 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{k}#" + " $$$ %%%" * (i % 5 + 1) + "*" * i for k in range(60)), 0) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(500, None), (501, "")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (3, None)], "doc_id int, quality int")
    kept = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad) and not kept[500] and not kept[501]
    alone = quality.judged(docs, labels.limit(0)).collect()
    assert len(alone) == 68 and all(r.kept == (not r.base_failed) for r in alone)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id int, text string, places int, notices string, Places string, kept string, anomaly int, n_words string"
    docs = spark.createDataFrame([], schema.replace(", Places string", ""))
    assert licenses.license_scan(docs).count() == 0
    assert quality.judged(docs, spark.createDataFrame([], "doc_id int, quality int")).count() == 0
    assert quality.judged(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id int, quality int")).count() == 0
    row = (1, "all rights reserved", 5, "n", "k", 7, "w")
    rows = licenses.license_scan(spark.createDataFrame([row, row, (None, None, None, None, None, None, None)], schema.replace(", Places string", ""))).collect()
    assert sorted(len(r.places) for r in rows) == [0, 1, 1] and all(r.kept in ("k", None) for r in rows)
    alone = quality.judged(spark.createDataFrame([row], schema.replace(", Places string", "")), spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, quality int")).collect()
    assert [r.kept for r in alone] == [False]


def test_long_text_full_of_notices_takes_linear_time():
    work = licenses._scanner()
    line = "é Released under the MIT Licence. All right reserved {}\n"
    texts = ["".join(line.format(i % 997) for i in range(n)) for n in (1, 20, 40000)]
    began = time.monotonic()
    _, _, notices = work(pa.array(texts))
    assert time.monotonic() - began < 20
    for text, found in zip(texts, notices, strict=True):
        assert [x["label"] for x in found] == ["mit", "reserved"] * text.count("\n")
        assert all(text[x["start"] : x["end"]].startswith(("Released", "All")) and x["errors"] > 0 for x in found)


def test_notices_match_brute_force():
    """Every notice with edits inside plain words: the places of the regex library over the whole text."""
    rng = random.Random(17)
    work = licenses._scanner()
    for _ in range(60):
        wanted, text = [], "vorab "
        for notice, label in rng.sample(licenses.NOTICES, 5):
            made = list(notice)
            for _ in range(rng.randint(0, licenses.allowed(notice) + 2)):
                made[rng.randrange(1, len(made) - 1)] = "q"
            edits = sum(a != b for a, b in zip(made, notice, strict=True))
            found = edits <= licenses.allowed(notice)
            assert found == bool(regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={licenses.allowed(notice)}}}", "".join(made)))
            if found:
                wanted.append((label, len(text), edits))
            text += "".join(made) + " zzé xxxxxx zzzzzzz xxxxxxxx zzé "
        got = work(pa.array([text]))[2][0]
        for label, start, edits in wanted:
            assert any(x["label"] == label and abs(x["start"] - start) <= 2 and x["errors"] <= edits for x in got), (text, label, got)


def test_smaller_arrow_batches_of_a_user_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for given, kept in (("512k", "512k"), ("64b", "64b"), ("4m", "1048576")):
        spark.conf.set(name, given)
        textbatch.small_batches(spark)
        assert spark.conf.get(name) == kept
    spark.conf.set(name, before)
