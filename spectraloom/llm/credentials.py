"""Secret scans: base patterns, and formats learned by grammar inference.

Base matches label credentials. From a bounded sample of them, a prefix tree of
character classes is built for each kind and its statistically compatible states are
merged into a probabilistic automaton. Every other token is then scored by how much
likelier an automaton writes it, its length included, than the corpus's ordinary tokens are.
What a format never showed costs a small share each time it comes, so that near formats are
scored by degrees. Tokens are the runs of the characters that credentials may have, and those
runs without what often only stands beside a credential: dots, padding, a name before `=`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.textbatch import LOWER, small_batches, spread, steps, struct_udf, text_bytes, word_hashes, word_spans

KINDS = ("assign", "access", "hex", "grammar")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")  # a leftmost longest run of 24 or more is a whole run
_keywords = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_is_hex = np.zeros(256, bool)
_is_hex[list(b"0123456789abcdef")] = True
#: Characters inside tokens, and how many a token has at least: those of the assign pattern's value.
TOKEN, LEAST = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 6
_is_token = np.zeros(256, bool)
_is_token[list(TOKEN)] = True
_is_dotted, _is_wide = _is_token.copy(), _is_token.copy()
_is_dotted[list(b".")] = True
_is_wide[list(b".=")] = True

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Leftmost non-overlapping matches of each kind; the value is the credential itself."""
    out = [("assign", m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), m[0]) for m in _access.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end(), m[0]) for m in _hex.finditer(text)]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `least` or more, cut at text ends."""
    starts, ends, _ = word_spans(data, offsets, inside[data])
    long = ends - starts >= least
    return starts[long], ends[long]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, each once: maximal runs of wide characters (with dots and `=`), the same without dots
    around them and without padding behind, runs with dots (alone, and with the padding that follows), and runs with neither."""
    place = np.arange(len(data))

    def stripped(starts: np.ndarray, ends: np.ndarray, front: bytes, back: bytes) -> tuple[np.ndarray, np.ndarray]:
        inner = np.ones(256, bool)
        inner[list(back)] = False
        last = np.maximum.accumulate(np.where(inner[data], place, -1))
        inner[list(front)] = False
        next_ = np.minimum.accumulate(np.where(inner[data], place, len(data))[::-1])[::-1]
        return np.minimum(next_[starts], ends), np.maximum(last[ends - 1] + 1, starts)

    wide = runs(data, offsets, _is_wide, LEAST)
    dotted = runs(data, offsets, _is_dotted, LEAST)
    families = [wide, runs(data, offsets, _is_token, LEAST)]
    if len(wide[0]):
        families += [stripped(*wide, b".=", b"."), stripped(*wide, b".=", b".=")]
    if len(dotted[0]):
        families.append(stripped(*dotted, b".", b"."))
        after = np.append(np.minimum.accumulate(np.where(data != ord("="), place, len(data))[::-1])[::-1], len(data))[dotted[1]]
        families.append((families[-1][0], np.minimum(after, offsets[np.searchsorted(offsets, dotted[0], "right")])))
    starts, ends = (np.concatenate(x) for x in zip(*families, strict=True))
    long = ends - starts >= LEAST
    key = np.unique(starts[long] * (len(data) + 1) + ends[long])
    return key // (len(data) + 1), key % (len(data) + 1)


def marked(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """The texts that show a trace of a base match, found over the bytes."""
    hits = [runs(data, offsets, _is_hex, 24)[0]]
    for where, words in ((data.tobytes(), (b"AKIA",)), (LOWER[data].tobytes(), _keywords)):
        for word in words:
            at, found = where.find(word), []
            while at >= 0:
                found.append(at)
                at = where.find(word, at + 1)
            hits.append(np.array(found, np.int64))
    return set((np.searchsorted(offsets, np.concatenate(hits), "right") - 1).tolist())


# Character classes, what a format fixes; any other character of a credential is a class of its own.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
_class = {c: k for k, chars in CLASSES.items() for c in chars}
#: The classes by number; the last one is for bytes that no token has.
NAMES = (*CLASSES, *"+/_-.=", "")
_number = np.full(256, len(NAMES) - 1, np.uint8)
for _i, _name in enumerate(NAMES[:-1]):
    _number[list(CLASSES.get(_name, _name).encode())] = _i
SIZES = np.array([len(CLASSES.get(x, " ")) for x in NAMES], float)
#: The weight of what was never seen, in observations.
UNSEEN = 0.05


def classes(token: str) -> str:
    return "".join(_class.get(c, c) for c in token)


class Automaton:
    """A probabilistic automaton inferred from words by merging compatible prefix-tree states.

    States of one depth are merged first, which gathers the few words of each deep state to a
    number that tells something; then states of different depths, which makes loops. For that
    both must have been passed by `least` words, as anything is compatible with a rare state.
    """

    def __init__(self, words: list[str], alpha: float = 0.05, least: int = 30):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for word in words:
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.through.append(Counter()), self.ends.append(0)
                self.through[at][c] += 1
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.same = list(range(len(self.next)))
        self._merge_levels()
        self._merge_loops(least)
        self._renumber()

    def top(self, state: int) -> int:
        """The state that a state was merged into."""
        while self.same[state] != state:
            self.same[state] = self.same[self.same[state]]
            state = self.same[state]
        return state

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.through[state].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, red: int, blue: int) -> bool:
        """Hoeffding's bound on the shares of endings and of each character, here and below."""
        todo, met = [(red, blue)], set()
        while todo:
            p, q = pair = todo.pop()
            if p == q or pair in met:
                continue
            met.add(pair)
            n, m = self.total(p), self.total(q)
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.through[p].keys() | self.through[q].keys():
                if self._differ(self.through[p][c], n, self.through[q][c], m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.top(self.next[p][c]), self.top(self.next[q][c])))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            p, q = map(self.top, todo.pop())
            if p == q:
                continue
            self.same[q] = p
            self.ends[p] += self.ends[q]
            for c, n in self.through[q].items():
                self.through[p][c] += n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            below = dict.fromkeys(self.top(s) for p in level for s in self.next[p].values())
            kept: list[int] = []
            for state in sorted(below, key=self.total, reverse=True):
                match = next((r for r in kept if self._compatible(r, state)), None)
                if match is None:
                    kept.append(state)
                else:
                    self._fold(match, state)
            level = kept

    def _merge_loops(self, least: int) -> None:
        reds = {0: None}  # in order
        while (blue := next((b for p in reds for c in sorted(self.next[p]) if (b := self.top(self.next[p][c])) not in reds), None)) is not None:
            match = next((r for r in reds if self.total(r) >= least and self._compatible(r, blue)), None) if self.total(blue) >= least else None
            if match is None:
                reds[blue] = None
            else:
                self._fold(match, blue)
                reds = dict.fromkeys(map(self.top, reds))

    def _renumber(self) -> None:
        order = {0: 0}
        todo = [0]
        while todo:
            state = todo.pop()
            for c in sorted(self.next[state]):
                if (s := self.top(self.next[state][c])) not in order:
                    order[s] = len(order)
                    todo.append(s)
        self.next = [{c: order[self.top(s)] for c, s in self.next[r].items()} for r in order]
        self.through, self.ends = [self.through[r] for r in order], [self.ends[r] for r in order]
        self.same = list(range(len(order)))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and class: the next state and the log likelihood of the move; by state: that of ending.

        A class that a state never showed costs a small share, is written as in the automaton as a whole, and counts as
        a substitution: the walk goes on along the state's commonest move, or stays where there is none.
        """
        n, k = len(self.next), len(NAMES)
        whole = sum(self.through, Counter())
        pool = np.array([whole[x] + UNSEEN for x in NAMES])
        pool = np.log(pool / pool.sum() / SIZES)
        after, log, end = np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros(n)
        for s in range(n):
            total = self.total(s) + UNSEEN
            log[s] = math.log(UNSEEN / total) + pool
            end[s] = math.log((self.ends[s] or UNSEEN) / total)
            after[s] = self.next[s][max(sorted(self.through[s]), key=self.through[s].__getitem__)] if self.next[s] else s
            for c, to in self.next[s].items():
                i = NAMES.index(c)
                after[s, i], log[s, i] = to, math.log(self.through[s][c] / total / SIZES[i])
        return after, log, end


class Formats:
    """The automata of all kinds, the ordinary tokens they are held against, and their limits."""

    #: Tokens longer than this are scored one by one.
    LONG = 1024

    def __init__(self, labelled: dict[str, list[str]], ordinary: np.ndarray | None = None, low: float = 0.05, near: float = 0.7):
        """labelled: credentials by kind; ordinary: how often each class (and then the end) follows each class (and first the start) in the corpus's tokens.

        A kind's limit is the share `near` of what all but a share `low` of its credentials reach, and at least the logarithm
        of the number of tokens: by Markov's inequality, ordinary ones then reach it less than once in the corpus.
        """
        k = len(NAMES)
        counts = np.zeros((k + 1, k + 1)) if ordinary is None else ordinary
        share = np.log((counts + UNSEEN) / (counts.sum(axis=1, keepdims=True) + UNSEEN * (k + 1)))
        self.usual, self.usual_end = share[:, :k] - np.log(SIZES), share[:, k]
        self.automata = {kind: Automaton([classes(v) for v in values]) for kind, values in sorted(labelled.items()) if len(values) >= 3}
        self.tables = [a.tables() for a in self.automata.values()]
        self.limits = np.zeros(len(self.tables))
        for i, kind in enumerate(self.automata):
            own = np.sort(self.gains(*_joined(labelled[kind]))[i])
            reached = own[int(low * len(own))]
            self.limits[i] = max(near * reached if reached > 0 else reached, math.log(max(counts[-1].sum(), 1)))

    def gains(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, written: np.ndarray | None = None) -> np.ndarray:
        """By automaton and token: the log likelihood that its format writes it (or, in its place, `written`) less that of an ordinary token."""
        number = _number[data]
        format_number = number if written is None else _number[written]
        order = np.argsort(starts - ends, kind="stable")  # longest first
        lengths = (ends - starts)[order]
        begin = starts[order]
        out = np.zeros((len(self.tables), len(starts)))
        state = np.zeros((len(self.tables), len(starts)), np.int64)
        last = np.full(len(starts), len(NAMES))
        long = int(np.searchsorted(-lengths, -self.LONG, "left"))
        for i in range(long):
            place = slice(begin[i], begin[i] + lengths[i])
            out[:, i], state[:, i], last[i] = self._walk(number[place], format_number[place])
        for p in range(int(lengths[long]) if long < len(lengths) else 0):
            live = slice(long, int(np.searchsorted(-lengths, -p, "left")))
            c, f = number[begin[live] + p], format_number[begin[live] + p]
            usual = self.usual[last[live], c]
            for i, (after, log, _) in enumerate(self.tables):
                s = state[i, live]
                out[i, live] += log[s, f] - usual
                state[i, live] = after[s, f]
            last[live] = c
        for i, (_, _, end) in enumerate(self.tables):
            out[i] += end[state[i]] - self.usual_end[last]
        return out[:, np.argsort(order)]

    def _walk(self, token: np.ndarray, written: np.ndarray) -> tuple[list[float], list[int], int]:
        usual = float(self.usual[np.append(len(NAMES), token[:-1]), token].sum())
        sums, states = [], []
        for after, log, _ in self.tables:
            moves, logs, s, total = after.tolist(), log.tolist(), 0, -usual
            for c in written.tolist():
                total += logs[s][c]
                s = moves[s][c]
            sums.append(total), states.append(s)
        return sums, states, int(token[-1])

    def margin(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By token, how far it lies above the limit of the kind it fits best; a token that occurs more than once is scored once.

        A token in capitals may also be a format's small letters in capitals, at even odds.
        """
        if not len(self.tables) or not len(starts):
            return np.full(len(starts), -np.inf)
        _, first, where = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        best = self._above(self.gains(data, a, b))
        upper, lower = (np.concatenate([[0], np.cumsum((data >= x) & (data <= y))]) for x, y in (b"AZ", b"az"))
        capitals = np.flatnonzero((upper[b] > upper[a]) & (lower[b] == lower[a]))
        if len(capitals):
            best[capitals] = np.maximum(best[capitals], self._above(self.gains(data, a[capitals], b[capitals], LOWER[data]) - math.log(2)))
        return best[where]

    def _above(self, gains: np.ndarray) -> np.ndarray:
        return (gains - self.limits[:, None]).max(axis=0)

    def score(self, token: str) -> float:
        """The margin of one token: 0 and more is as likely a credential as nearly all labelled ones of some kind."""
        return float(self.margin(*_joined([token]))[0])


def _joined(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pa.array(tokens, pa.string()))
    return data, offsets[:-1], offsets[1:]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, n): the labelled credentials of each batch, and under kind `pair` how often each class follows each other in its tokens clear of those."""
    for batch in batches:
        seen: Counter = Counter()
        pairs = np.zeros((len(NAMES) + 1) ** 2, np.int64)
        for texts in steps(batch.column(0)):
            data, offsets = text_bytes(texts)
            raw = data.tobytes()
            taken = np.zeros(len(data) + 1, np.int64)
            for i in marked(data, offsets):
                text = raw[offsets[i] : offsets[i + 1]].decode()
                spans = sorted(base_spans(text), key=lambda x: x[1])
                for (kind, start, end, value), at in zip(spans, byte_places(text, [x[1] for x in spans]), strict=True):
                    seen[kind, value] += 1
                    taken[offsets[i] + at + 1 : offsets[i] + at + 1 + end - start] = 1  # matches are of ASCII characters
            starts, ends = tokens(data, offsets)
            taken = np.cumsum(taken)
            clear = taken[starts] == taken[ends]
            pairs += token_pairs(data, starts[clear], ends[clear])
        rows = [(kind, value, n) for (kind, value), n in seen.items()] + [("pair", str(i), n) for i, n in enumerate(pairs.tolist()) if n]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "n"])


def byte_places(text: str, places: list[int]) -> list[int]:
    """The bytes before each of some ascending code points."""
    out, at, before = [], 0, 0
    for place in places:
        before += len(text[at:place].encode())
        at = place
        out.append(before)
    return out


def token_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts by class before (or start) and class after (or end), flat; tokens may lie inside others."""
    k = len(NAMES)
    number = _number[data].astype(np.int64)
    held = np.zeros(len(data) + 1, np.int64)
    np.add.at(held, starts + 1, 1)  # a token's first character follows the start, not the character before
    np.subtract.at(held, ends, 1)
    often = np.cumsum(held)[: len(data)]
    at = np.flatnonzero(often)
    out = np.bincount(number[at - 1] * (k + 1) + number[at], often[at], (k + 1) ** 2)
    edges = np.concatenate([k * (k + 1) + number[starts], number[ends - 1] * (k + 1) + k])
    return (out + np.bincount(edges, minlength=(k + 1) ** 2)).astype(np.int64)


def fit_formats(texts: DataFrame, text_col: str = "text", sample: int = 400, longest: int = 256, seed: int = 5) -> Formats:
    """Learns from at most `sample` distinct labelled credentials of each kind (those of smallest hash) of up to `longest` characters; ordinary tokens are counted over all texts."""
    small_batches(texts.sparkSession)
    found = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_learned, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value", F.lit(seed)), "value")
    pair = F.col("kind") == "pair"
    # at most (classes + 1)^2 pairs, and `sample` credentials a kind
    rows = found.where(pair | (F.char_length("value") <= longest)).withColumn("r", F.row_number().over(order)).where(pair | (F.col("r") <= sample)).collect()
    k = len(NAMES)
    ordinary = np.zeros((k + 1) ** 2)
    labelled: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["r"])):
        if r["kind"] == "pair":
            ordinary[int(r["value"])] = r["n"]
        else:
            labelled.setdefault(r["kind"], []).append(r["value"])
    return Formats(labelled, ordinary.reshape(k + 1, k + 1))


def scan(texts: pa.Array, formats: Formats, threshold: float = 0.0) -> list[list[dict]]:
    """Each text's base spans, and as kind `grammar` its tokens of a margin of `threshold` or more that are clear of them, by start then kind.

    Of tokens that overlap, one without dots around it stands before others, then the one of the highest margin, then the longest.
    """
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    starts, ends = tokens(data, offsets)
    margins = formats.margin(data, starts, ends)
    likely = np.flatnonzero(margins >= threshold)
    edged = ~_is_token[data[starts[likely]]] | (data[ends[likely] - 1] == ord("."))
    likely = likely[np.lexsort((starts[likely], starts[likely] - ends[likely], -margins[likely].round(6), edged))]
    owners = np.searchsorted(offsets, starts[likely], "right") - 1
    mine: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip(owners.tolist(), starts[likely].tolist(), ends[likely].tolist(), strict=True):
        mine.setdefault(i, []).append((a, b))
    held = bytearray(len(raw))  # bytes in a span
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in marked(data, offsets) | mine.keys():
        text = raw[offsets[i] : offsets[i + 1]].decode()
        spans = sorted(base_spans(text), key=lambda x: x[1])
        for (_, start, end, _), at in zip(spans, byte_places(text, [x[1] for x in spans]), strict=True):
            at += int(offsets[i])
            held[at : at + end - start] = b"\1" * (end - start)
        added = []
        for a, b in mine.get(i, ()):
            if held.find(1, a, b) < 0:
                held[a:b] = b"\1" * (b - a)
                added.append((a, b))
        at, place = int(offsets[i]), 0
        for a, b in sorted(added):
            place += len(raw[at:a].decode())
            at = a
            spans.append(("grammar", place, place + b - a, raw[a:b].decode()))
        spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        out[i] = [dict(zip(SPAN.names, x, strict=True)) for x in spans]
    return out


def secret_scan(df: DataFrame, text_col: str = "text", sample: int = 400, threshold: float = 0.0) -> DataFrame:
    """`df` without its text, with `spans`: array of (kind, start, end, value), code points, end exclusive, by start then kind.

    Base spans always stay; kind `grammar` is added for tokens whose margin is `threshold`
    or more. Null and empty texts have none. Without labelled credentials (three of a kind)
    nothing is added. Repeated rows stay; an input column `spans` is replaced. The texts are
    read twice, to learn and to scan; nothing is shuffled but the distinct credentials.
    """
    sent = df.sparkSession.sparkContext.broadcast(fit_formats(df, text_col, sample))

    def make():
        formats = sent.value
        return lambda texts: [scan(texts, formats, threshold)]

    return spread(df, F.col(f"`{text_col}`"), "__found", struct_udf(FOUND, None, make=make)).drop(text_col)
