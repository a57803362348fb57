import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import editembed, language, mixing
from spectraloom.session import table

WORDS = {"en": "the and house running with water light".split(), "de": "und der Straße läuft mit wasser licht".split()}


def lang_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    return rows + [(900, None, "en"), (901, "123 !!!", "de"), (902, "", None), (None, "the house", "en"), (903, "中文文本", None), (904, "unwater und lichter", None)]


def test_language_learns_outside_the_held_out_ids(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["de", "en"]
    rows = language.identify(docs.withColumn("held_out", language.held_out("doc_id")), model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == r.lang
        if r.doc_id in (900, 901, 902):
            assert r.lang_pred == "und" and r.score == 0
    assert next(r for r in rows if r.doc_id == 903).lang_pred in model.langs
    nothing = language.fit(docs.where("lang is null"))
    assert language.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    rows = language.identify(docs.where(language.held_out("doc_id")), language.fit(docs)).where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def model_of(counts):
    """A model of (lang, n, item, count)."""
    langs = sorted({c[0] for c in counts})
    column = lambda k, kind: np.array([c[k] for c in counts], kind)
    return language.Model(langs, np.array([langs.index(c[0]) for c in counts], np.int64), column(1, np.int64), language.hashed([c[2] for c in counts]), column(3, np.int64))


def test_backoff_takes_the_longest_seen_gram():
    model = model_of([("a", 0, "word", 5), ("a", 0, "other", 5), ("b", 2, "wo", 3), ("b", 2, "zz", 7), ("b", 5, "^wort", 3), ("a", 1, "x", 1)])
    got = dict(zip(("word", "wort", "woq", "xy", "q"), model.scored(["word", "wort", "woq", "xy", "q"]), strict=True))
    assert np.allclose(got["word"], [np.log(5.5 / 10), np.log(0.5), 1]) and np.allclose(got["wort"], [np.log(0.5), np.log(3.5 / 3), 1])
    assert np.allclose(got["woq"], [np.log(0.5), np.log(3.5 / 10), 1]) and np.allclose(got["xy"], [np.log(1.5), np.log(0.5), 1])
    assert not got["q"].any()


class SlowModel:
    """The same rule on dictionaries of words and n-grams, one word at a time."""

    def __init__(self, texts):
        self.counts = {}
        for text, lang in texts:
            by_size = self.counts.setdefault(lang, {n: Counter() for n in (0, *language.SIZES)})
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                by_size[0][word] += 1
                for n in language.SIZES:
                    padded = word if n == 1 else f"^{word}$"
                    by_size[n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
        self.langs = sorted(self.counts)

    def log(self, lang, n, item):
        total = sum(self.counts[lang][n].values())
        return np.log(self.counts[lang][n][item] + 0.5) - np.log(max(total, 1))

    def predict(self, text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        total, n_words = np.zeros(len(self.langs)), 0
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for n in (0, *language.SIZES):
                padded = word if n < 2 else f"^{word}$"
                items = [word] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]
                items = [g for g in items if any(self.counts[x][n][g] for x in self.langs)]
                if items:
                    total += np.mean([[self.log(x, n, g) for x in self.langs] for g in items], axis=0)
                    n_words += 1
                    break
        if not n_words:
            return self.langs[0], 1 / len(self.langs)
        mean = (total - total.max()) / n_words * min(n_words, 20)
        share = np.exp(mean) / np.exp(mean).sum()
        return self.langs[int(share.argmax())], float(share.max())


def test_predictions_match_brute_force(spark):
    rng = random.Random(11)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulöß", "el": "αβγδεζηθικλμ"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word(lang).title() for _ in range(rng.randint(1, 25))) + rng.choice(["", " 12_x", "\n½"]), lang) for i in range(240) for lang in [("en", "de", "el")[i % 3]]]
    rows += [(1000, "", "en"), (1001, None, "de"), (1002, "½ 5", None), (1003, "中文", None), (1004, "Wort " * 200_000 + "ende", None), (1005, "x" * 300_000, None), (1006, rows[7][1], None)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, lang string")
    slow = SlowModel([(t, lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 5])
    for r in language.identify(docs, language.fit(docs)).collect():
        want = slow.predict(r.text)
        assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1], abs=1e-9)), r.text


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i} " * (i % 7), "x" if i % 3 else "y") for i in range(400)] + [(5, "t5 " * 5, "x")] * 300, "doc_id long, text string, lang string")
    for sample, chars in ((10, 10**6), (1000, 10**6), (1000, 60), (1000, 1)):
        by = {}
        for r in language.sampled(docs, "doc_id", sample, chars).collect():
            by.setdefault(r.lang, []).append(r.text)
        assert set(by) == {"x", "y"}
        for lang, texts in by.items():
            assert 1 <= len(texts) <= sample and (sum(map(len, texts)) <= chars or len(texts) == 1)
            if sample == 1000 and chars == 10**6:
                assert len(texts) == sum(1 for i in range(400) if ("x" if i % 3 else "y") == lang and zlib.crc32(str(i).encode()) % 5)


def test_language_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.langs == [] and language.identify(empty, model).count() == 0


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), f"s{i % 7}") for i in range(300)]
    rows += [(i, "tiny text here", "tiny") for i in range(300, 304)] + [(i, "of none", None) for i in range(304, 330)]
    return rows + [(330, None, "s1"), (331, "", "s1"), (3, rows[3][1], "s3"), (None, "no id", "s2"), (332, None, "void")]


@pytest.mark.parametrize("rows", [mix_rows(), [], [(1, None, None)], [(1, "a b", "x")]])
def test_mix_matches_its_sql(spark, rows):
    documents = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    got = sorted(map(tuple, mixing.mix_report(documents).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}) if rows else documents.toPandas())
    want = sorted(con.execute(mixing.MIX_SQL).fetchall(), key=str) if rows else []
    assert [(a, b, c, pytest.approx(d), e) for a, b, c, d, e in want] == got
    by_source = {}
    for (_, _, source), r in zip(sorted(rows, key=lambda x: str((x[0],))), sorted(got, key=lambda x: str((x[0],))), strict=True):
        assert r[4] <= 3 * r[1]
        t = by_source.setdefault(source, [0, r[3], r[2]])
        t[0] += r[4]
    for taken, target, size in by_source.values():
        assert target <= 3 * size + 1e-9
        assert abs(taken - target) <= max(0.1 * target, 60)


def test_mixed_keeps_columns_and_salted_join_agrees(spark):
    documents = spark.createDataFrame([(*r, 1) for r in mix_rows()], "doc_id long, text string, source string, target int")
    held = mixing.mixed(documents)
    assert held.count() == documents.count()
    assert mixing.emitted(held).count() == held.agg(F.sum("copies")).first()[0]
    sizes = mixing.with_size(documents)
    rates, n = mixing.plan(sizes.select("doc_id", "source", "size"))
    ways = [mixing.join_sources(sizes.drop("target"), rates, n, mixing.source_key("source"), F.xxhash64("doc_id"), most=m).select("doc_id", "target").collect() for m in (100, 0)]
    assert sorted(ways[0], key=str) == sorted(ways[1], key=str)


def slow_fingerprint(text):
    """The walk, one step at a time."""
    chars = [int(editembed.mixed(np.array([ord(c)], np.uint64))[0] >> np.uint64(11)) & 255 for c in text]
    out, i, j = [], 0, 0
    while i < len(chars):
        out.append(chars[i])
        i += int(editembed._bits[j % editembed.PHASES, chars[i]])
        j += 1
    if not out:
        return ""
    n = editembed.SAMPLES
    while n < len(out):
        n *= 2
    at = [int(p) for p in editembed.POSITIONS if p < n]
    return "".join("0123456789abcdef"[out[p] & 15] if p < len(out) else "." for p in at)


def test_fingerprints_match_the_plain_walk():
    rng = random.Random(6)
    texts = ["", "a", "é" * 5, "ab" * 40, "x" * 5000, *["".join(rng.choice("abcdefgh éß中") for _ in range(n)) for n in (10, 33, 500, 2047, 2048, 2049, 9000)]]
    got = editembed.fingerprints(texts)
    assert got == [slow_fingerprint(t) for t in texts]
    assert editembed.fingerprints([]) == [] and editembed.fingerprints([""]) == [""]


def test_few_edits_stay_near():
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    near = base[:700] + "zz" + base[700:2500] + base[2503:]
    a, b, c, d = editembed.fingerprints([base, near, base[:2000] + near[::-1][:2000], base[::-1]])
    assert editembed.likeness(a, a) == 1 and editembed.likeness(a, b) > 0.85
    assert 0.35 < editembed.likeness(a, c) < 0.65 and editembed.likeness(a, d) < 0.15
    assert editembed.likeness("", "") == 1 and editembed.likeness("", a) == 0


def test_edit_distance():
    rng = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = slow(a, b)
        assert editembed.edits(a, b, 3) == (d if d <= 3 else None), (a, b)


@pytest.mark.parametrize("ids", [[5, 3, 9, 1, 7, 100, 12], [1], [], [2, 2, 2, 3], [None, 4, None, 2]])
def test_neighbours_match_brute_force(spark, ids):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "abc é", "longer text " * rng.randint(1, 50), "x"])) for i in ids]
    got = editembed.neighbour_report(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, copy string")).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        f, e, g = editembed.fingerprints([text, changed, following])
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), f, e, editembed.likeness(f, e), editembed.likeness(f, g)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_near_pairs_finds_planted_copies(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghijkl mnop") for _ in range(rng.randint(300, 3000))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:50] + "Q" + t[50:200] + t[203:]) for i, t in enumerate(texts)] + [(999, None)]
    got = {(r.id_a, r.id_b): r.edits for r in editembed.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= {(i, 100 + i) for i in range(30)} and len(got) >= 27 and set(got.values()) == {4}


def shared_keys(spark, texts):
    """Whether two texts share a band key."""
    both = list(zip(range(len(texts)), editembed.fingerprints(texts), editembed.fingerprints([t[::-1] for t in texts]), strict=True))
    prints = spark.createDataFrame(both, "id long, print string, back string")
    keys = {r[0]: set(r[1]) | {f"-{k}" for k in r[2]} for r in prints.select("id", editembed.band_keys("print"), editembed.band_keys("back")).collect()}
    return lambda a, b: bool(keys[a] & keys[b])


def test_near_pairs_behind_an_unrelated_first(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijkl mnop") for _ in range(n))
    # in each family the first is 25 edits from the others, which are 2 apart: they share its bands
    rows = []
    for i in range(0, 400, 4):
        t = text(1500)
        other = t[:700] + "Q" * 25 + t[725:]
        rows += [(i, t), (i + 1, other), (i + 2, other[:100] + "XY" + other[102:]), (i + 3, text(1500))]
    rows += [(1000 + i, "" if i % 2 else None) for i in range(4)]
    got = {(r.id_a, r.id_b): r.edits for r in editembed.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = shared_keys(spark, [t or "" for _, t in rows])
    near = {(i + 1, i + 2): 2 for i in range(0, 400, 4) if share(i + 1, i + 2)}
    assert len(near) >= 90 and sum(share(i, i + 1) and share(i, i + 2) for i in range(0, 400, 4)) >= 50
    assert {k: v for k, v in got.items() if k[0] < 1000} == near
    assert {k: v for k, v in got.items() if k[0] >= 1000} == {(1000, 1000 + i): 0 for i in range(1, 4)}


def test_near_pairs_connect_chains(spark):
    rng = random.Random(14)
    t = "".join(rng.choice("abcdefghijkl mnop") for _ in range(3000))
    rows = []
    for i in range(12):  # each is 15 edits from the one before, and 30 and more from all others
        rows.append(((i * 5) % 12, t))
        at = 200 * i + 100
        t = t[:at] + "Q" * 15 + t[at + 15 :]
    got = editembed.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id_a, r.id_b) for r in got} == {tuple(sorted((a[0], b[0]))) for a, b in zip(rows, rows[1:], strict=False)} and {r.edits for r in got} == {15}


@pytest.mark.parametrize("members", [3, 1000])
def test_near_pairs_in_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(editembed, "MEMBERS", members)
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    share = shared_keys(spark, texts)
    pairs = [(r.id_a, r.id_b) for r in editembed.near_pairs(frame, most=2).collect()]
    parts = {i: {i} for i in range(40)}
    for a, b in pairs:
        assert a < b and editembed.edits(texts[a], texts[b], 2) is not None
        parts[a] |= parts[b]
        for x in parts[a]:
            parts[x] = parts[a]
    for a in range(40):
        for b in range(a):
            if editembed.edits(texts[a], texts[b], 2) is not None and share(a, b):
                assert b in parts[a], (texts[a], texts[b])


def test_near_groups_recall_on_the_documents(spark, sf):
    """Random edits anywhere in whole documents of every length, up to one in 40 characters: at least nine in ten copies are found, and groups hold near texts only."""
    rng = random.Random(16)
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows, planted = list(texts.items()), {}
    for k, (i, text) in enumerate(texts.items()):
        n, copy = (1, 3, 8, 15)[k % 4], text or ""
        if len(copy) < 40 * n:
            continue
        for _ in range(n):
            at = rng.randrange(len(copy))
            copy = copy[:at] + rng.choice(["", "Q", copy[at] + "z"]) + copy[at + 1 :]
        planted[100_000 + i] = (i, n)
        rows.append((100_000 + i, copy))
    got = {r.doc_id: r.group_id for r in editembed.near_groups(spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string")).collect()}
    assert len(got) == len(rows) + 1 and got[None] is None
    for edits in (1, 3, 8, 15):
        assert np.mean([got[c] == got[i] for c, (i, n) in planted.items() if n == edits]) >= 0.9
    for low, high in ((0, 500), (500, 4000), (4000, 10**7)):
        found = [got[c] == got[i] for c, (i, _) in planted.items() if low <= len(texts[i]) < high]
        assert np.mean(found) >= 0.9
    # nothing is grouped but over near texts: each group's members are connected by pairs within the limit
    by = {}
    for i, g in got.items():
        by.setdefault(g, []).append(i)
    held = dict(rows)
    for g, members in by.items():
        if g is None or len(members) > 12:
            continue
        reached, todo = {g}, [g]
        while todo:
            a = todo.pop()
            for b in members:
                if b not in reached and editembed.edits(held[a] or "", held[b] or "", 20) is not None:
                    reached.add(b), todo.append(b)
        assert reached == set(members)


def test_near_groups_of_named_documents(spark):
    """Ids that are text, repeated ids, clashing column names, and an empty table."""
    rng = random.Random(18)
    text = "".join(rng.choice("abcdefghijkl mnop") for _ in range(900))
    rows = [("b", text, 1), ("a", text[:400] + "Q" + text[400:], 2), ("a", text[:400] + "Q" + text[400:], 2), ("c", text[::-1], 3), ("d", None, 4), ("e", "", 5)]
    schema = "doc_id string, text string, group_id int"
    got = sorted((r.doc_id, r.group_id, r.kept) for r in editembed.near_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "a", True), ("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "d", True), ("e", "d", False)]
    assert editembed.near_groups(spark.createDataFrame([], schema)).count() == 0


def test_periodic_texts_are_walked_as_one_and_in_linear_time():
    texts = ["a" * 9000, "ab" * 5000, "abc" * 4000 + "x" * 5000, "", "a" * editembed.BLOCK, "a" * (2 * editembed.BLOCK), "a" * 4097 + "b" * 9000]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) for t in texts]
    for t, p in zip(texts, points, strict=True):
        classes = (editembed.mixed(p) >> np.uint64(11)).astype(np.uint8)
        at, want = 0, []
        for c in classes.tolist():
            want.append(at)
            at = int(editembed.AFTER[at | c])
        assert editembed.phases(classes, np.array([0, len(classes)])).tolist() == want, t[:5]
    assert editembed.fingerprints(texts) == [editembed.fingerprints([t])[0] for t in texts]
    began = time.monotonic()
    editembed.fingerprints(["a" * 3_000_000])
    assert time.monotonic() - began < 15


def test_members_of_a_band_meet_by_size_and_profile():
    """no near pair is ruled out, unlike texts are before their texts are read, and a document's pairs come in rounds."""
    rng = random.Random(19)
    text = lambda n: "".join(rng.choice("abcdefghijkl mnop") for _ in range(n))
    texts = [text(1000) for _ in range(12)] + ["", "a", "aa"]
    for t in texts[:12]:
        copy = t
        for _ in range(5):
            at = rng.randrange(len(copy))
            copy = copy[:at] + rng.choice(["", "Q", copy[at] + "z"]) + copy[at + 1 :]
        texts.append(copy)
    profiles = editembed.profiles(texts)
    members = [(i % 2, i, len(t), i, profiles[i].tobytes()) for i, t in enumerate(texts)]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if editembed.edits(texts[i], texts[j], 6) is not None}
    assert len(near) == 15
    found = {across: [r for slot in range(160) for r in editembed._candidates(members, slot, across, 6, 8)] for across in (False, True)}
    assert {(r["id_a"], r["id_b"]) for r in found[False]} == near and not any(r["more"] for r in found[False])
    assert {(r["id_a"], r["id_b"]) for r in found[True]} == {(i, j) for i, j in near if i % 2 != j % 2}
    alike = [(0, i, 4, i, editembed.profiles(["same"])[0].tobytes()) for i in range(5)]
    assert [(r["id_a"], r["id_b"], r["more"]) for r in editembed._candidates(alike, 0, False, 6, 2)] == [(0, 1, False), (0, 2, False), (1, 2, False), (0, 3, True), (1, 3, True), (0, 4, True), (1, 4, True)]


def test_ends_of_prints_have_all_their_bands(spark):
    prints = editembed.fingerprints(["", "ab", "xy" * 40, "a sentence of some length " * 9, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(9000))])
    rows = spark.createDataFrame([(p,) for p in prints], "print string").withColumn("end", editembed._end("print"))
    made = rows.select("print", "end", editembed.band_keys("print").alias("a"), editembed.band_keys("end").alias("b")).collect()
    assert all(r.a == r.b and len(r.print) == len(r.end) for r in made) and any(r.print != r.end for r in made)
