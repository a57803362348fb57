"""Language identification by words first, then by ever shorter character n-grams.

Words and n-grams are known by 64-bit hashes, so a model is a few arrays: two items of one
hash count as one, which half a million items meet with a probability of about 1e-8.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.mixing import join_sources
from spectraloom.llm.textbatch import small_batches, spread, steps, struct_udf, text_bytes, word_hashes
from spectraloom.session import checkpointed, shuffle_width

_word = re.compile(r"[^\W\d_]+")
#: Sizes of the n-grams that unseen words fall back to, in this order.
SIZES = (5, 4, 3, 2, 1)
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def hashed(items: list[str]) -> np.ndarray:
    """64-bit hashes of non-empty strings."""
    data, offsets = text_bytes(pa.array(items, pa.large_string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text divides by 5; ids that are null are never held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def count_items(sample: DataFrame) -> DataFrame:
    """(lang, n, item, count): hashes of the words (n = 0) and n-grams of `sample` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in steps(batch.column(1)):  # the counts of a megabyte of text at a time: a task's memory stays small
                for lang, texts in _by_lang(batch.slice(low, len(part))):
                    words: Counter = Counter()
                    for text in texts:
                        words.update(_word.findall(text.lower()))
                    for n in (0, *SIZES) if words else ():
                        parts = [[w] if n == 0 else grams(w, n) for w in words]
                        lengths = [len(p) for p in parts]
                        flat = [g for p in parts for g in p]
                        if not flat:
                            continue
                        items, at = np.unique(hashed(flat), return_inverse=True)
                        times = np.bincount(at, np.repeat(list(words.values()), lengths), len(items)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items)), pa.array(np.full(len(items), n, np.int32)), pa.array(items.view(np.int64)), pa.array(times)], schema=_COUNTS)
                low += len(part)

    partial = sample.select("lang", "text").mapInArrow(run, "lang string, n int, item bigint, count bigint")
    return partial.groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))


_COUNTS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.int64()), ("count", pa.int64())])


def _by_lang(batch: pa.RecordBatch) -> list[tuple[str, list[str]]]:
    out: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        out.setdefault(lang, []).append(text or "")
    return list(out.items())


class Model:
    """Log frequencies by language of words and n-grams, from counts of (language, size, hash)."""

    #: Words whose scores a task remembers; beyond that it starts anew.
    REMEMBERED = 100_000

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, item: np.ndarray, count: np.ndarray):
        """langs: sorted names; lang: an index into them for each row, with size, hash and count beside it."""
        self.langs = langs
        self.items: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        for size in (0, *SIZES):
            here = n == size
            self.items[size], row = np.unique(item[here], return_inverse=True)
            seen = np.full((len(self.items[size]), len(langs)), 0.5)
            np.add.at(seen, (row, lang[here]), count[here])
            totals = np.bincount(lang[here], count[here], len(langs))
            self.logs[size] = np.log(seen) - np.log(np.maximum(totals, 1))
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs) + 1))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": np.zeros((0, len(self.langs) + 1))}

    def _rows(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """The rows of hashes among the items of size n, -1 for those never seen."""
        items = self.items[n]
        if not len(items):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(items, hashes), len(items) - 1)
        return np.where(items[at] == hashes, at, -1)

    def scored(self, words: list[str]) -> np.ndarray:
        """For each word its log frequency by language, or for an unseen word the mean over its longest n-grams that were seen; the last column is 0 if none was, else 1."""
        out = np.zeros((len(words), len(self.langs) + 1))
        left = np.arange(len(words))
        for n in (0, *SIZES):
            if not len(left):
                break
            parts = [[words[i]] if n == 0 else grams(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            rows = self._rows(n, hashed([g for p in parts for g in p]))
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            found = np.bincount(owner, minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner, self.logs[n][rows])
            hit = found > 0
            out[left[hit], :-1] = sums[hit] / found[hit, None]
            out[left[hit], -1] = 1
            left = left[~hit]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language and its share, text by text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts = [Counter(_word.findall(t.lower())) if t and any(map(str.isalpha, t)) else None for t in texts]
        if len(self.known) > self.REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        fresh = list(dict.fromkeys(w for c in counts if c for w in c if w not in self.known))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.scores = np.concatenate([self.scores, self.scored(fresh)])
        names, shares = [], []
        for c in counts:
            if c is None:
                names.append("und"), shares.append(0.0)
                continue
            times = np.fromiter(c.values(), float, len(c))
            total = times @ self.scores[np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))] if c else np.zeros(len(self.langs) + 1)
            n = total[-1]
            if not n:
                names.append(self.langs[0]), shares.append(1 / len(self.langs))
                continue
            mean = (total[:-1] - total[:-1].max()) / n * min(n, 20)
            share = np.exp(mean) / np.exp(mean).sum()
            best = int(share.argmax())
            names.append(self.langs[best]), shares.append(float(share[best]))
        return names, shares


def sampled(docs: DataFrame, id_col: str, sample: int, chars: int) -> DataFrame:
    """(lang, text) of the labelled documents of smallest hash: at most `sample` a language, and at most `chars` bytes of text together (one document at least).

    Rows that repeat id and text are one. Ranks need no text; the texts are then
    filtered by the hash at which a language's sample ends.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    rows = labelled.select("lang", "text", F.xxhash64(F.col(f"`{id_col}`").cast("string"), "text").alias("__h"))
    # first ranked inside slices of a language, so that no task ranks all of a frequent one; four times
    # a slice's share of the sample and 20 more leave none of the smallest hashes out but with odds under 1e-30
    once = rows.groupBy("lang", "__h").agg(F.max(F.octet_length("text")).alias("__size"))
    slices = shuffle_width(docs.sparkSession)
    inside = F.row_number().over(Window.partitionBy("lang", F.pmod("__h", F.lit(slices))).orderBy("__h"))
    order = Window.partitionBy("lang").orderBy("__h")
    ranked = once.withColumn("__r", inside).where(F.col("__r") <= 20 + 4 * sample // slices).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample)
    within = ranked.withColumn("__sum", F.sum("__size").over(order)).where((F.col("__sum") <= chars) | (F.col("__n") == 1))
    ends = checkpointed(within.groupBy(F.col("lang").alias("key")).agg(F.max("__h").alias("__end")))
    held = join_sources(rows, ends, ends.count(), F.col("lang"), F.col("__h")).where(F.col("__h") <= F.col("__end"))
    return held.groupBy("lang", "__h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", sample: int = 2000, chars: int = 16_000_000) -> Model:
    """Learns from at most `sample` documents and `chars` bytes a language (those of smallest hash), null languages, texts and ids and held-out ids aside.

    All words and n-grams of the sample are kept, so the sample bounds the model. Without
    a labelled document the model knows no language. Equal counts need no order: nothing is cut.
    """
    small_batches(docs.sparkSession)
    rows = count_items(sampled(docs, id_col, sample, chars)).toArrow()
    names = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    langs = names.dictionary.to_pylist()
    order = sorted(langs)
    at = np.array([order.index(x) for x in langs], np.int64)
    column = lambda c: rows.column(c).to_numpy()
    return Model(order, at[names.indices.to_numpy()] if langs else np.zeros(0, np.int64), column("n"), column("item").view(np.uint64), column("count"))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1); `und` with score 0 for texts that are null or have no letter.

    Texts of letters the model never saw get the first language with an even score, as do
    ties the first of the tied. Repeated rows stay; input columns named like the added ones are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        return lambda texts: list(own.predict(texts.to_pylist()))

    return spread(df, F.col(f"`{text_col}`"), "__lang", struct_udf(RESULT, None, make=make))
