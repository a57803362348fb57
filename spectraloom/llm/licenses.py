"""License scans: exact base phrases by word, and fuzzy search of short notices.

A notice of n characters may be met with up to k edits. Cut into k + 1 seeds, at least
one stands exactly in any such place (pigeonhole), so exact seeds locate the candidates;
the regex library's bounded-error matching then verifies the edits and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.textbatch import LOWER, spread, struct_udf, text_bytes, word_spans

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices that the fuzzy search looks for, as lower-case words, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)

IS_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    IS_WORD[_low : _high + 1] = False
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
        T.StructField(
            "notices",
            T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("errors", T.LongType()), T.StructField("likeness", T.DoubleType())])),
        ),
    ]
)


def allowed(notice: str) -> int:
    """Edits a notice may show: one for each twelve characters."""
    return len(notice) // 12


def seeds(notice: str) -> list[tuple[int, bytes]]:
    """The k + 1 pieces of a notice and where each begins."""
    k = allowed(notice)
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _all(raw: bytes, seed: bytes) -> list[int]:
    out, at = [], raw.find(seed)
    while at >= 0:
        out.append(at)
        at = raw.find(seed, at + 1)
    return out


def _best(notice: str) -> Callable[[bytes], tuple[int, int, int] | None]:
    """Start, end and errors of the place of a window that is most like the notice; windows that return are remembered."""
    pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={allowed(notice)}}}")

    @lru_cache(maxsize=4096)
    def best(window: bytes) -> tuple[int, int, int] | None:
        m = pattern.search(window.decode("latin-1"))
        return m and (m.start(), m.end(), sum(m.fuzzy_counts))

    return best


def _scanner():
    plans = [(n, label, allowed(n), seeds(n), _best(n)) for n, label in NOTICES]

    def work(texts: pa.Array) -> list:
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, IS_WORD[data])
        # words with one space after each; the word that starts at `begins[i]` there starts at `starts[i]` in the data
        lengths = ends - starts
        gap = np.ones(len(starts), np.int64)
        begins = np.cumsum(lengths + gap) - lengths - gap
        flat = np.full(int((lengths + gap).sum()) + 1, 32, np.uint8)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat[np.repeat(begins, lengths) + within] = data[np.repeat(starts, lengths) + within]
        joined = flat.tobytes()
        lows = np.append(begins, len(joined))[first]
        places = [[] for _ in range(len(texts))]
        for phrase, label in BASE.items():
            for at in _all(b" " + joined, f" {phrase} ".encode()):
                word = int(np.searchsorted(begins, at))
                doc = int(np.searchsorted(first, word, "right")) - 1
                if word + phrase.count(" ") < first[doc + 1]:
                    places[doc].append({"label": label, "word": word - int(first[doc])})
        notices = [[] for _ in range(len(texts))]
        chars = np.zeros(len(data) + 1, np.int64)  # code points before each byte
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        held: dict[tuple[int, str], list[tuple[int, int]]] = {}  # by text and label: places so far, which don't overlap, in order
        for notice, label, k, parts, best in plans:
            found: dict[int, dict[tuple[int, int], int]] = {}
            tried: set[tuple[int, int]] = set()
            for offset, seed in parts:
                for at in _all(joined, seed):
                    doc = int(np.searchsorted(lows, at, "right")) - 1
                    doc = min(doc, len(texts) - 1)
                    low, high = max(int(lows[doc]), at - offset - k), min(int(lows[doc + 1]), at - offset + len(notice) + k)
                    if (low, high) in tried or high - low < len(notice) - k:
                        continue
                    tried.add((low, high))
                    if place := best(joined[low:high]):
                        found.setdefault(doc, {})[low + place[0], low + place[1]] = place[2]
            for doc, spans in found.items():
                places_held = held.setdefault((doc, label), [])
                for (a, b), errors in sorted(spans.items(), key=lambda x: (x[1], x[0])):
                    at = bisect_left(places_held, (a, b))
                    if (at and places_held[at - 1][1] > a) or (at < len(places_held) and places_held[at][0] < b):
                        continue
                    places_held.insert(at, (a, b))
                    i = min(int(np.searchsorted(begins, a, "right")) - 1, len(starts) - 1)
                    j = max(i, int(np.searchsorted(begins, b - 1, "right")) - 1)
                    origin = int(starts[i]) + a - int(begins[i])
                    end = min(int(starts[j]) + b - int(begins[j]), int(ends[j]))
                    first_char = int(chars[offsets[doc]])
                    notices[doc].append({"label": label, "start": int(chars[origin]) - first_char, "end": int(chars[end]) - first_char, "errors": errors, "likeness": round(1 - errors / len(notice), 4)})
        for found_here in notices:
            found_here.sort(key=lambda x: (x["start"], x["label"]))
        return [np.diff(first), [sorted(p, key=lambda x: (x["word"], x["label"])) for p in places], notices]

    return work


def license_scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, places (base phrases: label, word index) and notices (fuzzy: label, code point span, errors, likeness).

    Null and empty texts have no words, places or notices. Repeated rows stay; input
    columns named like the added ones are replaced.
    """
    return spread(df, F.col(f"`{text_col}`"), "__scan", struct_udf(RESULT, None, make=_scanner))
