import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import credentials, pii

HEX = "0123456789abcdef"


def brute_base(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def texts():
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice(HEX) for _ in range(n))
    made = [f'é token = "{key(40)}" und PassWord:{key(5)} secret=\'{key(6)}' for _ in range(30)]
    made += [f"{key(24)} x {key(23)} AKIA{key(16).upper()} AKIA12 api_key= abc.def-{rng.randint(0, 9)} tokenſ=abcdefgh" for _ in range(10)]
    made += [None, "", " ", "token = ", "AKIA", key(100), "deadbeef", "Versicherungsgesellschaft2024 ok", f"lone {key(22)}", key(12), key(12), "toKen:abcdef"]
    made += ["lorem ipsum " * 5000 + f" token={key(30)}"]
    word = lambda: "".join(rng.choice("aeiourstlnmpg") for _ in range(rng.randint(3, 14)))
    return made + [" ".join(word() for _ in range(200)) for _ in range(20)]  # what ordinary tokens look like


def test_base_spans_match_brute_force(spark):
    rows = credentials.secret_scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id int, text string, spans int")).collect()
    want = dict(enumerate(texts()))
    assert len(rows) == len(want)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "grammar"] == brute_base(want[r.doc_id]), want[r.doc_id]
    added = {r.doc_id: [s.value for s in r.spans if s.kind == "grammar"] for r in rows}
    lone = next(i for i, t in want.items() if t and t.startswith("lone"))
    assert added[lone] == [want[lone].split()[1]]
    assert all(not added[i] for i, t in want.items() if t and t.startswith("Versicherung"))


def test_no_labels_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert credentials.secret_scan(empty).count() == 0
    plain = spark.createDataFrame([(1, "nothing here a1b2c3d4e5f6a7b8c9")], "doc_id int, text string")
    assert credentials.secret_scan(plain).collect()[0].spans == []


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 4096])
def test_permute_is_a_bijection(size):
    assert sorted(pii.permute(b"k", "t", x, size) for x in range(size)) == list(range(size))


def test_values_keep_format_and_stay_linked(spark):
    values = {
        "card": "4845168114407329", "ipv4": "227.5.221.1", "phone": "+1 (743) 555-3824", "email": "réré.34@mail7.example.com",
        "date": "2023-02-28", "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789",
    }
    docs = [(i, f"Aa {v}, bb\n{v}.") for i, v in enumerate(values.values())] + [(90, f"z {values['card']} and {values['email']}"), (91, None), (92, ""), (93, "clean 12 text 3.5 4111111111111112 999.1.2.3 2023-02-30")]
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(docs, "doc_id int, text string"), "key").collect()}
    shape = lambda t: re.sub("[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", re.sub("[0-9]", "0", t)))
    new = {}
    for i, (kind, value) in enumerate(values.items()):
        first, second = re.fullmatch(r"Aa (.*), bb\n(.*)\.", rows[i].text).groups()
        assert first == second != value and rows[i][f"n_{kind}"] == 2, kind
        assert shape(first) == shape(value) or kind == "ipv4", kind
        assert pii.pseudonym(b"key", kind, first) is not None
        new[kind] = first
    assert rows[90].text == f"z {new['card']} and {new['email']}"
    assert rows[91].text is None and rows[92].text == "" and rows[93].text == docs[-1][1] and rows[93].spans == ""


def test_distinct_values_stay_distinct():
    rng = random.Random(2)
    cards = {c + pii.luhn_digit(c) for c in (str(rng.randrange(10**14, 10**15)) for _ in range(500))}
    made = {pii.pseudonym(b"key", "card", c) for c in cards}
    assert len(made) == len(cards) and all(pii.luhn_digit(c[:-1]) == c[-1] for c in made)


@pytest.mark.parametrize("value", ["+33 12 34 56 78", "+49 30 12 34 56", "41 11 11 11 11 11 11 11"])
def test_values_without_long_digit_runs_are_linked(value):
    alone, spans = pii.replaced(b"key", f"call {value}, ok")
    beside, _ = pii.replaced(b"key", f"call {value}, ok 1234")
    assert len(spans) == 1 and value not in alone and beside == alone + " 1234"


@pytest.mark.parametrize(
    ("kind", "value", "after"),
    [("card", "4111 1111 1111 1111", " 12/27"), ("card", "4111-1111-1111-1111", " 737"), ("card", "4111 1111 1111 1111", " 2"), ("iban", "AT61 1904 3002 3457 3201", " EUR"), ("iban", "AT611904300234573201", " BIC")],
)
def test_values_before_other_digits_or_words_are_linked(kind, value, after):
    alone, _ = pii.replaced(b"key", f"pay {value}")
    made, spans = pii.replaced(b"key", f"pay {value}{after}")
    assert made == alone + after and value not in made and spans == [(kind, 4, 4 + len(value))]


def test_every_pattern_shows_a_trace():
    rng = random.Random(3)
    seen = set()
    patterns = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii._patterns))
    for _ in range(60000):
        text = "".join(rng.choice(["+", "1", "23", "456", "7890", "(", ")", " ", "-", ".", "/", "@", "AB", "c"]) for _ in range(rng.randint(3, 16)))
        if m := patterns.search(text):
            seen.add(m.lastgroup)
            assert pii._trace.search(text), text
    assert {"card", "phone", "email"} <= seen


@pytest.mark.parametrize("make", [lambda k: ["the surface", "", None, k(26)], lambda k: [k(32)] * 6, lambda k: [k(24) + " x", "", k(5), k(30), "", "z" + k(40)], lambda k: [k(10).upper() + "+/" + k(9).upper()] * 4])
def test_scan_is_that_of_each_text_alone(make):
    rng = random.Random(4)
    texts = make(lambda n: "".join(rng.choice(HEX) for _ in range(n)))
    every = credentials.Formats({"hex": ["a1b2" * 8, "b1c2" * 8, "1122" * 8]})
    found = credentials.scan(pa.array(texts, pa.string()), every, -1e9)
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in found[i] if s["kind"] != "grammar"] == brute_base(t), texts
        assert found[i] == credentials.scan(pa.array([t], pa.string()), every, -1e9)[0]


def test_scan_of_random_neighbours():
    rng = random.Random(21)
    hexes = lambda n: "".join(rng.choice(HEX) for _ in range(n))
    for _ in range(400):
        texts = [rng.choice([None, "", "a", "f", "é", hexes(24), hexes(30) + " x", "note a", "AKIA" + "A1" * 8, "token=" + hexes(8), "tok", "en=abcdefgh", "A" * 20]) for _ in range(rng.randint(1, 7))]
        found = credentials.scan(pa.array(texts, pa.string()), credentials.Formats({}))
        assert [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in found] == [brute_base(t) for t in texts], texts


ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def credential(rng, kind):
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return {"hex": lambda: draw(HEX, 40), "access": lambda: "AKIA" + draw(UPPER, 16), "prefixed": lambda: "ghp_" + draw(ALNUM, 36), "short": lambda: draw(HEX, 18), "free": lambda: draw(ALNUM, rng.randint(20, 40))}[kind]()


def ordinary(rng):
    word = lambda: "".join(rng.choice("aaeeeiioounnrrsttlldhcmpgbfwk") for _ in range(rng.randint(2, 14)))
    return rng.choice([word, word, word, word, word, lambda: word().title() + "-" + word(), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"https://{word()}.org/{word()}/{word()}_{rng.randint(1, 99)}", lambda: f"{word()}{rng.randint(2000, 2030)}", lambda: str(rng.randint(10**7, 10**13)), lambda: f"ISBN-978-{rng.randint(10**8, 10**9)}"])()


def test_automata_know_lengths_and_prefixes():
    rng = random.Random(31)
    labelled = {kind: [credential(rng, kind) for _ in range(300)] for kind in ("hex", "access", "prefixed")}
    tokens = " ".join(ordinary(rng) for _ in range(20000)).encode()
    data = np.frombuffer(tokens, np.uint8)
    pairs = credentials.token_pairs(data, *credentials.runs(data, np.array([0, len(data)]), credentials._is_token, credentials.LEAST))
    formats = credentials.Formats(labelled, pairs.reshape(len(credentials.NAMES) + 1, -1).astype(float))
    assert {k: len(a.next) for k, a in formats.automata.items()} == {"hex": 41, "access": 21, "prefixed": 41}
    hexes = lambda n: "".join(rng.choice(HEX) for _ in range(n))
    own, short, long = ([formats.score(hexes(n)) for _ in range(60)] for n in (40, 10, 400))
    assert np.mean([x >= 0 for x in own]) > 0.85 and max(short) < 0 and np.mean(long) < np.mean(own) - 5
    assert np.mean([formats.score(credential(rng, "prefixed")) >= 0 for _ in range(60)]) > 0.85
    # a format of variable length makes loops: fewer states than the longest value has characters
    assert len(credentials.Automaton([credentials.classes("".join(rng.choice(HEX) for _ in range(1 + int(rng.expovariate(0.08))))) for _ in range(400)]).next) < 30


def slow_margin(formats, token):
    """Character by character on the automata's own counts; what a state never showed is a substitution."""
    k = len(credentials.NAMES)

    def above(automaton, limit, written):
        whole = sum((automaton.through[s] for s in range(len(automaton.next))), Counter())
        every = sum(whole.values()) + k * credentials.UNSEEN
        state, total, last = 0, 0.0, k
        for ch, own in zip(written, token, strict=True):
            c, n = credentials._class.get(ch, ch), automaton.total(state) + credentials.UNSEEN
            size = credentials.SIZES[credentials.NAMES.index(c)]
            if c in automaton.next[state]:
                total += np.log(automaton.through[state][c] / n / size)
                state = automaton.next[state][c]
            else:
                total += np.log(credentials.UNSEEN / n) + np.log((whole[c] + credentials.UNSEEN) / every / size)
                most = max(automaton.through[state].values(), default=0)
                state = next((automaton.next[state][x] for x in sorted(automaton.next[state]) if automaton.through[state][x] == most), state)
            i = credentials.NAMES.index(credentials._class.get(own, own))
            total -= formats.usual[last, i]
            last = i
        return total + np.log((automaton.ends[state] or credentials.UNSEEN) / (automaton.total(state) + credentials.UNSEEN)) - formats.usual_end[last] - limit

    pairs = list(zip(formats.automata.values(), formats.limits, strict=True))
    best = [above(*x, token) for x in pairs]
    if re.search("[A-Z]", token) and not re.search("[a-z]", token):
        best += [above(*x, token.lower()) - np.log(2) for x in pairs]
    return max(best)


def slow_tokens(text):
    found = set()
    for pattern, strips in (("A-Za-z0-9+/_.=-", ((".=", "."), (".=", ".="), ("", ""))), ("A-Za-z0-9+/_.-", ((".", "."),)), ("A-Za-z0-9+/_.-]{6,}[=", ((".", ""),)), ("A-Za-z0-9+/_-", (("", ""),))):
        for m in re.finditer(f"[{pattern}]*" if "[=" in pattern else f"[{pattern}]{{6,}}", text):
            for front, back in strips:
                a = m.end() - len(m[0].lstrip(front)) if front else m.start()
                b = m.start() + len(m[0].rstrip(back)) if back else m.end()
                if b - a >= 6:
                    found.add((a, b))
    return found


def slow_grammar(formats, text):
    held = [(a, b) for _, a, b in brute_base(text)]
    free = sorted(slow_tokens(text), key=lambda x: (text[x[0]] in ".=" or text[x[1] - 1] == ".", -round(slow_margin(formats, text[x[0] : x[1]]), 6), x[0] - x[1], x[0]))
    out = []
    for a, b in free:
        if slow_margin(formats, text[a:b]) >= 0 and not any(x < b and a < y for x, y in held):
            held.append((a, b))
            out.append((a, b))
    return sorted(out)


def test_planted_formats_are_found_and_words_left_alone(spark):
    rng = random.Random(32)
    kinds = ("hex", "prefixed", "short", "free", "access")
    rows, planted = [], {}
    for i in range(1500):
        words = [ordinary(rng) for _ in range(80)]
        if i % 3 == 0:
            words.insert(rng.randrange(80), f"token = {credential(rng, kinds[i // 3 % 4])}")
        if i % 3 == 1:  # nothing but the format tells it
            planted[i] = credential(rng, ("prefixed", "short", "free")[i // 3 % 3])
            words.insert(rng.randrange(80), planted[i])
        if i % 30 == 2:
            words.insert(3, credential(rng, "access"))
        rows.append((i, "é " * (i % 3) + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    added = {r.doc_id: [s.value for s in r.spans if s.kind == "grammar"] for r in credentials.secret_scan(df).collect()}
    hit = sum(added[i].count(v) for i, v in planted.items())
    every = sum(map(len, added.values()))
    assert hit >= 0.9 * len(planted) and hit >= 0.95 * every, (hit, every, len(planted))
    formats = credentials.fit_formats(df)
    for i, text in rows[:60]:
        assert added[i] == [text[a:b] for a, b in slow_grammar(formats, text)]


def test_very_long_tokens_score_alike():
    rng = random.Random(33)
    formats = credentials.Formats({"free": [credential(rng, "free") for _ in range(100)]})
    tokens = ["".join(rng.choice(ALNUM) for _ in range(n)) for n in (8, 30, 1500, 3000)] + ["a" * 2000]
    assert np.allclose([formats.score(t) for t in tokens], [slow_margin(formats, t) for t in tokens])
    data = credentials._joined([*tokens, "x" * 1025])
    assert np.allclose(formats.margin(*data)[: len(tokens)], [slow_margin(formats, t) for t in tokens])


def plain_search(key, text):
    """Detection by one alternation of all patterns, leftmost first, without any short cut."""
    patterns = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii._patterns))
    out, spans, done, at = [], [], 0, 0
    while m := patterns.search(text, at):
        for kind in pii.KINDS[pii.KINDS.index(m.lastgroup) :]:
            end, new = next(((e, made) for e in pii._ends(kind, text, m.start()) if (made := pii.pseudonym(key, kind, text[m.start() : e])) is not None), (0, None))
            if new is not None:
                break
        at = m.start() + 1
        if new is not None:
            out += [text[done : m.start()], new]
            spans.append((kind, m.start(), end))
            done = at = end
    return "".join(out) + text[done:], spans


def test_detection_matches_the_plain_search():
    rng = random.Random(8)
    parts = ["+", "1", "23", "456", "7890", "(", ")", " ", "-", ".", "/", "@", "AB", "c", "é", "_", "4111 1111 1111 1111", "1.2.3.4", "2023-02-28", "bob@x.org", "a.b@mail.example.com", "DE89 3704 0044 0532 0130 00", "555-123-4567", "123-45-6789"]
    found = 0
    for _ in range(15000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = plain_search(b"k", text)
        assert pii.replaced(b"k", text) == want, text
        found += len(want[1])
    assert found > 10000


@pytest.mark.parametrize(("unit", "n_values"), [("ab", 0), ("1234567890", 0), ("aB3+/x9", 0), ("a@", 0), ("@", 0), ("1.2.3.4 ", 125_000), ("ab", 1)])
def test_long_runs_take_linear_time(unit, n_values):
    text = unit * (1_000_000 // len(unit)) + ("@x.org" if n_values == 1 else "")
    began = time.process_time()
    made, spans = pii.replaced(b"key", text)
    assert len(spans) == n_values and len(made) >= 500_000 and (n_values or made == text)
    assert time.process_time() - began < 20  # a quadratic search takes hours


def test_pii_empty_table_and_clashing_columns(spark):
    schema = "doc_id int, text string, spans int, n_email string, Pseudonymised int"
    assert pii.pseudonymise(spark.createDataFrame([], schema), "key").count() == 0
    rows = pii.pseudonymise(spark.createDataFrame([(1, "to bob@x.org", 7, "z", 9), (1, "to bob@x.org", 7, "z", 9), (None, None, None, None, None)], schema), "key").collect()
    assert len(rows) == 3 and [r.n_email for r in rows if r.text] == [1, 1] and rows[0].text == rows[1].text != "to bob@x.org"


def learned_from(labelled, rng):
    text = " ".join(ordinary(rng) for _ in range(20000)).encode()
    data = np.frombuffer(text, np.uint8)
    pairs = credentials.token_pairs(data, *credentials.tokens(data, np.array([0, len(data)])))
    return credentials.Formats(labelled, pairs.reshape(len(credentials.NAMES) + 1, -1).astype(float))


def test_near_formats_are_found_without_labels_of_their_own():
    """Dotted and padded formats that labels show; other lengths, other prefixes and capitals of formats that they show."""
    rng = random.Random(35)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    dotted = lambda: f"eyJ{draw(ALNUM, 17)}.{draw(ALNUM, 30)}.{draw(ALNUM, 27)}"
    padded = lambda: draw(ALNUM + "+/", 42) + "=="
    kinds = {"hex": lambda: draw(HEX, 40), "dotted": dotted, "padded": padded, "prefixed": lambda: "ghp_" + draw(ALNUM, 36)}
    formats = learned_from({k: [make() for _ in range(300)] for k, make in kinds.items()}, rng)
    near = {
        **kinds, "capitals": lambda: draw(HEX, 40).upper(), "shorter": lambda: draw(HEX, 37).upper(), "longer": lambda: draw(HEX, 41).upper(),
        "other prefix": lambda: "xoxb-" + draw(ALNUM, 36), "shorter dotted": lambda: f"eyJ{draw(ALNUM, 16)}.{draw(ALNUM, 30)}.{draw(ALNUM, 26)}", "less padding": lambda: draw(ALNUM + "+/", 43) + "=",
    }
    texts, planted = [], []
    for i in range(600):
        words = [ordinary(rng) for _ in range(60)]
        kind = list(near)[i % len(near)]
        value = near[kind]()
        words.insert(rng.randrange(60), rng.choice(["{}", "key={}", "{}.", "({})", "é{},"]).format(value))
        texts.append(" ".join(words))
        planted.append((kind, value))
    found = [[s["value"] for s in spans if s["kind"] != "assign"] for spans in credentials.scan(pa.array(texts), formats)]
    hits = Counter(kind for (kind, value), values in zip(planted, found, strict=True) if value in values)
    total = Counter(kind for kind, _ in planted)
    assert all(hits[k] >= 0.9 * total[k] for k in total), hits
    assert sum(hits.values()) >= 0.95 * sum(map(len, found)), (hits, sum(map(len, found)))


def test_tokens_match_brute_force():
    rng = random.Random(36)
    for _ in range(200):
        texts = ["".join(rng.choice(["ab", "c", ".", "=", " ", "é", "x1-", "....", "==", "deadbeef"]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        data, offsets = credentials.text_bytes(pa.array(texts))
        starts, ends = credentials.tokens(data, offsets)
        got = sorted(data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True))
        assert got == sorted(t[a:b] for t in texts for a, b in slow_tokens(t)), texts


def test_long_texts_full_of_matches_take_linear_time():
    rng = random.Random(37)
    hexes = lambda n: "".join(rng.choice(HEX) for _ in range(n))
    formats = learned_from({"hex": [hexes(40) for _ in range(300)]}, rng)
    text = "é\n".join(hexes(40) if i % 2 else hexes(40).upper() for i in range(60000))
    began = time.monotonic()
    (found,) = credentials.scan(pa.array([text]), formats)
    list(credentials._learned(iter([pa.RecordBatch.from_arrays([pa.array([text, "." * 300000 + "=" * 300000])], ["text"])])))
    assert time.monotonic() - began < 30
    assert [(s["kind"], s["start"], s["end"]) for s in found if s["kind"] != "grammar"] == brute_base(text) and all(text[s["start"] : s["end"]] == s["value"] for s in found)
    assert sum(s["kind"] == "grammar" for s in found) >= 0.9 * 30000
