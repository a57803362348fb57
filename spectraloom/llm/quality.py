"""Quality rules: statistics of whole texts, base limits, and an isolation forest over the statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spectraloom.llm.textbatch import IS_SPACE, SPACES, mixed, spread, struct_udf, text_bytes, word_hashes, word_spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
_blank = bytes(SPACES)
_three = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    windows = mixed(hashes[:-2] * _three[0] + mixed(hashes[1:-1] * _three[1] + mixed(hashes[2:] * _three[2])))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def batch_stats(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(texts)
    inside = ~IS_SPACE[data]
    starts, ends, first = word_spans(data, offsets, inside)
    hashes = word_hashes(data, starts, ends)
    raw = data.tobytes()
    dup, rep = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(_blank)]
        dup[i] = len(lines) - len(set(lines))
        rep[i] = repeated_words(hashes[first[i] : first[i + 1]])
    return [np.diff(first), _per_text(inside & ((data & 0xC0) != 0x80), offsets), _per_text(IS_SYMBOL[data], offsets), dup, rep]


def rule_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text (null: no words, zeros). Input columns of the same names are replaced; repeated rows stay."""
    schema = StructType([StructField(x, LongType()) for x in STATS])
    return spread(df, F.col(f"`{text_col}`"), "__stats", struct_udf(schema, batch_stats))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Shares, so that a long clean text looks like a short one."""
    words = np.maximum(n_words, 1)
    return np.column_stack([word_chars / words, n_symbols / np.maximum(word_chars, 1), n_dup_lines / words, n_repeat_words / words]).astype(float)


class IsolationForest:
    """Random splits over bounded samples; a row that few splits isolate scores near 1."""

    def __init__(self, rows: np.ndarray, trees: int = 100, size: int = 256, seed: int = 11, weights: np.ndarray | None = None):
        """weights: how often each column is split, in proportion (alike if None)."""
        rng = np.random.default_rng(seed)
        self.weights = np.ones(rows.shape[1]) if weights is None else weights
        self.size = max(2, min(size, len(rows)))
        depth = math.ceil(math.log2(self.size))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)], depth, rng) for _ in range(trees)]

    @staticmethod
    def usual_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, depth: int, rng) -> list[np.ndarray]:
        """Arrays by node: feature (-1 at a leaf), cut, left child (right is next to it), path added at a leaf."""
        feature, cut, child, tail = [], [], [], []
        todo = [(rows, depth)]
        feature.append(-1), cut.append(0.0), child.append(0), tail.append(0.0)
        at = 0
        while at < len(todo):
            part, left = todo[at]
            spans = np.ptp(part, axis=0) if len(part) else np.zeros(rows.shape[1])
            if left == 0 or len(part) <= 1 or not spans.any():
                tail[at] = self.usual_path(len(part))
            else:
                share = np.where(spans > 0, self.weights, 0)
                f = int(rng.choice(len(share), p=share / share.sum()))
                c = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                feature[at], cut[at], child[at] = f, c, len(todo)
                for side in (part[part[:, f] < c], part[part[:, f] >= c]):
                    todo.append((side, left - 1))
                    feature.append(-1), cut.append(0.0), child.append(0), tail.append(0.0)
            at += 1
        return [np.array(x) for x in (feature, cut, child, tail)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        paths = np.zeros(len(rows))
        for feature, cut, child, tail in self.trees:
            node = np.zeros(len(rows), np.int64)
            live = np.arange(len(rows))
            while len(live):
                f = feature[node[live]]
                done = f < 0
                paths[live[done]] += tail[node[live[done]]]
                live, f = live[~done], f[~done]
                paths[live] += 1
                node[live] = child[node[live]] + (rows[live, f] >= cut[node[live]])
        return 2.0 ** (-paths / len(self.trees) / max(self.usual_path(self.size), 1e-9))


def separation(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The largest gap between the two distribution functions of each column, squared; a hundredth at least."""
    gaps = []
    for a, b in zip(np.sort(good, axis=0).T, np.sort(bad, axis=0).T, strict=True):
        at = np.concatenate([a, b])
        gaps.append(np.abs(np.searchsorted(a, at, "right") / max(len(a), 1) - np.searchsorted(b, at, "right") / max(len(b), 1)).max())
    return np.maximum(np.array(gaps) ** 2, 0.01)


def fit_forest(labelled: DataFrame, sample: int = 4096, trees: int = 100, seed: int = 11) -> IsolationForest | None:
    """Fits on at most `sample` labelled rows (those whose hash is smallest); None without rows.

    A statistic is split the more often, the better it parts the sample's good from its bad rows.
    """
    order = F.xxhash64(*STATS, F.lit(seed))
    rows = np.array([tuple(r) for r in labelled.select(*STATS, "quality").orderBy(order, *STATS, "quality").limit(sample).collect()], float)
    if not len(rows):
        return None
    shares, good = features(*rows[:, :-1].T), rows[:, -1] != 0
    weights = separation(shares[good], shares[~good]) if good.any() and not good.all() else None
    return IsolationForest(shares, trees=trees, seed=seed, weights=weights)


def anomaly(df: DataFrame, forest: IsolationForest, name: str = "anomaly") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(features(*[np.asarray(x.fill_null(0), float) for x in (a, b, c, d, e)])).round(3), pa.float64())

    run.__annotations__ = {**dict.fromkeys("abcde", pa.Array), "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(run, "double")(*STATS))


def calibrate(scored: DataFrame, quality: str = "quality", spare: float = 0.0005) -> float:
    """The score from which a row is anomalous, over all labelled rows: the smallest that at most `spare`
    of the good rows reach, or, above it, the one that parts good from bad best."""
    counts: dict[float, list[int]] = {}
    for r in scored.groupBy("anomaly", quality).count().collect():  # scores have three decimals: some 1000 rows
        if r[quality] is not None:
            counts.setdefault(r["anomaly"], [0, 0])[int(r[quality] != 0)] += r["count"]
    good = sum(x[1] for x in counts.values())
    bad = sum(x[0] for x in counts.values())
    best, limit = 0.0, math.inf
    hit = lost = 0
    for score in sorted(counts, reverse=True):
        hit, lost = hit + counts[score][0], lost + counts[score][1]
        if lost > spare * good:
            break
        gain = hit / max(bad, 1) - lost / max(good, 1)
        if gain > best:
            best, limit = gain, score
    return limit


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4096) -> DataFrame:
    """Statistics, base_failed, the forest's anomaly score and `kept` of every document.

    The forest is fitted on at most `sample` of the labelled rows that pass the base limits;
    its threshold is calibrated on all of them. Without labelled rows the forest
    fails nothing (anomaly 0). Labels of a null or unknown id, and null qualities, count
    for nothing; a repeated label counts as often as it stands there.
    """
    from spectraloom.session import checkpointed

    stats = checkpointed(rule_stats(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).drop("text").withColumn("base_failed", base_failed()))
    known = stats.where(~F.col("base_failed")).join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id")
    forest = fit_forest(known, sample)
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    limit = calibrate(anomaly(known, forest))
    return anomaly(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))
