import itertools
import random

import numpy as np
import pytest

from spectraloom.llm import chat

NUMBER = {"system": 0, "user": 1, "assistant": 2}


def legal(roles):
    at = 0
    for r in roles:
        if r not in chat.NEXT[at]:
            return False
        at = 1 + r
    return at in (0, chat.FINAL)


def brute(kinds):
    """The smallest cost over all relabellings and merges, each with the fewest empty turns."""
    best = float("inf")
    for new in itertools.product(range(3), repeat=len(kinds)):
        relabel = sum((chat.NAME if a == 3 else chat.RELABEL) * (a != b) for a, b in zip(kinds, new, strict=True))
        for merges in itertools.product([False, True], repeat=len(kinds)):
            cost, at = relabel, 0
            for r, m in zip(new, merges, strict=True):
                if m:
                    cost += chat.MERGE if at == 1 + r else float("inf")
                else:
                    way = chat.routes(at, r)
                    cost += float("inf") if way is None else chat.INSERT * len(way)
                at = 1 + r
            best = min(best, cost + chat.END_COSTS[at])
    return best


@pytest.mark.parametrize("span,fan", [(128, 64), (2, 2), (3, 100)])
def test_repairs_are_legal_and_cheapest(spark, monkeypatch, span, fan):
    monkeypatch.setattr(chat, "RANGE_BYTES", span * 200)  # so that ranges cut conversations
    monkeypatch.setattr(chat, "FAN", fan)
    rng = random.Random(5)
    names = ["system", "USER ", "assistant", "human", "tool", None]
    kinds = {"system": 0, "USER ": 1, "assistant": 2, "human": 1, "tool": 3, None: 3}
    convs = {c: [rng.choice(names) for _ in range(rng.randint(1, 5))] for c in range(30)}
    rows = [(c, t, r, f"text {c} {t} <|user|>" if t else None, "x") for c, roles in convs.items() for t, r in enumerate(roles)]
    long = [(99, t, rng.choice(names[:3]), "t", "x") for t in range(40)]
    df = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string, place string")
    turns = chat.rendered(chat.repaired(df))
    got = {}
    for r in turns.collect():
        got.setdefault(r.conv_id, []).append(r)
    texts = {r.conv_id: r.text for r in chat.conversations(turns).collect()}
    assert len(got[99]) == 40
    for c, turns_of in got.items():
        turns_of.sort(key=lambda r: r.turn)
        out = []
        for r in turns_of:
            out += [NUMBER[x] for x in r.inserted]
            out += [] if r.action == "merge" else [NUMBER[r.new_role]]
            out += [NUMBER[x] for x in r.appended]
        assert legal(out), c
        cost = sum(r.cost for r in turns_of) + chat.INSERT * sum(len(r.appended) for r in turns_of)
        if c in convs:
            assert cost == brute([kinds[r] for r in convs[c]]), convs[c]
        heads = [line[2:-2] for line in texts[c].split("\n") if line in ("<|system|>", "<|user|>", "<|assistant|>")]
        assert [NUMBER[h] for h in heads] == out and texts[c].count("<|end|>") == len(out)


def test_legal_conversations_stay_and_odd_rows_are_defined(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, None, "user", None), (2, None, "user", None), (None, 3, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows = chat.repaired(df).collect()
    assert len(rows) == 5 and all(r.action == "keep" and not r.inserted and not r.appended for r in rows if r.conv_id == 1)
    assert sorted(r.action for r in rows if r.conv_id == 2) == ["keep", "merge"]
    assert chat.repaired(df.limit(0)).count() == 0


def test_long_runs_cost_what_single_steps_do():
    rng = random.Random(6)
    for n in (1, 255, 256, 257, 1000, 5000):
        kinds = np.array([rng.randrange(4) for _ in range(n)])
        want = np.where(np.eye(chat.STATES) > 0, 0.0, np.inf)
        for k in kinds:
            want = (want[:, :, None] + chat.COSTS[k][None, :, :]).min(axis=1)
        assert (chat.run_total(kinds) == want).all()
        states = chat.solved(kinds, np.array([0]), np.array([n]), np.array([0]), chat.END_COSTS[None, :])
        paid = sum(chat.COSTS[k, a, b] for k, a, b in zip(kinds, [0, *states[:-1]], states, strict=True)) + chat.END_COSTS[states[-1]]
        assert paid == (want[0] + chat.END_COSTS).min()


def test_hot_and_named_conversations_in_many_ranges(spark, monkeypatch):
    """Half of all turns in one conversation, ids that are text or null, texts of a megabyte, clashing columns."""
    monkeypatch.setattr(chat, "RANGE_BYTES", 4000)
    rng = random.Random(7)
    rows = [("hot", t, rng.choice(["user", "assistant", "system", None, "tool"]), f"t{t}", 1) for t in range(1500)]
    rows += [(f"c{c}", t, rng.choice(["user", "assistant"]), "x" * (1 << 20) if c == 3 and t == 1 else f"{c}", 2) for c in range(300) for t in range(rng.randint(1, 6))]
    rows += [(None, t, "user", None, 3) for t in range(20)]
    df = spark.createDataFrame(rows, "id string, turn int, role string, text string, segment int")
    turns = chat.rendered(chat.repaired(df, conv="id"))
    got = turns.collect()
    assert len(got) == len(rows) and turns.schema["conv_id"].dataType.simpleString() == "string"
    by = {}
    for r in sorted(got, key=lambda r: (r.segment, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    assert len(by) == 302
    for conv, of in by.items():
        assert [r.turn for r in of] == sorted(r.turn for r in of)
        out = []
        for r in of:
            out += [NUMBER[x] for x in r.inserted] + ([] if r.action == "merge" else [NUMBER[r.new_role]]) + [NUMBER[x] for x in r.appended]
        assert legal(out) and sum(r.opens for r in of) <= len(of) and [r.closes for r in of] == [False] * (len(of) - 1) + [True]
        kinds = np.array([NUMBER.get(r.role, 3) for r in of])
        paid = sum(r.cost for r in of) + chat.INSERT * sum(len(r.appended) for r in of)
        assert paid == (chat.run_total(kinds)[0] + chat.END_COSTS).min(), conv
    whole = {r.conv_id: r.text for r in chat.conversations(turns).collect()}
    assert whole == {c: "".join(r.fragment for r in of) for c, of in by.items()}
    cut = {}
    for r in sorted(chat.conversations(turns, most=5000).collect(), key=lambda r: r.part):
        cut[r.conv_id] = cut.get(r.conv_id, "") + r.text
    assert cut == whole and chat.conversations(turns, most=5000).where("part > 0").count() > 0
