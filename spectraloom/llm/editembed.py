"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at each step it writes the character it stands on and moves on if a
random bit, shared by all texts and fixed by the step and the character, says so. Texts a
few edits apart soon walk in step again, so edit distance becomes Hamming distance. The
fingerprint samples the embedded string, ever more sparsely towards its end; bands of
sampled bits find candidates, which the edit distance verifies.

The shared bits repeat after PHASES steps. That lets one long text be walked in many blocks
at once: blocks start from a guessed phase, and those whose guess proves wrong are walked
again from the right one. Walks of most texts fall in step within a block, so that two rounds
do; where they don't (a run of one character), each block is walked from all phases as a map,
and the maps are composed. The outcome is that of one walk, the work linear whatever the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spectraloom.llm.minhash import components, only_ids, with_side
from spectraloom.llm.textbatch import mixed, small_batches
from spectraloom.session import checkpointed, removed, scratch, shuffle_width, tidied, written

PHASES, BLOCK, SAMPLES = 128, 2048, 32
#: Blocks whose maps are made side by side, and the characters between two looks at which phases have met.
ABREAST, MEET = 1024, 128
#: Octaves of the walk that are sampled: enough for 2^45 steps.
OCTAVES = 41
_bits = (mixed(np.arange(PHASES * 256, dtype=np.uint64) + np.uint64(0xA5A5)) & np.uint64(1)).reshape(PHASES, 256).astype(bool)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By phase and character: the phase after the character (times 256), and the steps spent on it."""
    twice = np.concatenate([_bits, _bits])
    stay = np.zeros((PHASES, 256), np.int64)
    for p in range(PHASES):
        stay[p] = np.argmax(twice[p : p + PHASES], axis=0) + 1
    after = (np.arange(PHASES)[:, None] + stay) % PHASES
    return (after * 256).astype(np.uint16).ravel(), stay.astype(np.uint8).ravel()


AFTER, STAY = _tables()


def _positions() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps, ascending, and the steps each stands for: all of the first 64, then 32 of each octave, one in each stratum."""
    at, weight = [np.arange(SAMPLES), np.arange(SAMPLES, 2 * SAMPLES)], [np.ones(SAMPLES), np.ones(SAMPLES)]
    for o in range(1, OCTAVES - 1):
        width = 1 << o
        jitter = (mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(o * 1000)) % np.uint64(width)).astype(np.int64)
        at.append(SAMPLES * width + np.arange(SAMPLES) * width + jitter)
        weight.append(np.full(SAMPLES, float(width)))
    return np.concatenate(at), np.concatenate(weight)


POSITIONS, WEIGHTS = _positions()


def maps(padded: np.ndarray, start: np.ndarray) -> np.ndarray:
    """By whole block and phase at its start: the phase at its end. Phases that meet go on as one."""
    out = np.empty((len(start), PHASES), np.uint8)
    for low in range(0, len(start), ABREAST):
        begin = start[low : low + ABREAST]
        key = np.arange(len(begin) * PHASES)
        place = key
        for met in range(0, BLOCK, MEET):
            block, state = key // PHASES, (key % PHASES * 256).astype(np.uint16)
            for t in range(met, met + MEET):
                state = AFTER[state | padded[begin + t].astype(np.uint16)[block]]
            key = block * PHASES + (state >> 8)
            seen = np.zeros(len(begin) * PHASES, bool)
            seen[key] = True
            place = (np.cumsum(seen) - 1)[key][place]
            key = np.flatnonzero(seen)
        out[low : low + ABREAST] = (key % PHASES)[place].reshape(-1, PHASES)
    return out


def _composed(guess: np.ndarray, padded: np.ndarray, start: np.ndarray, number: np.ndarray, text: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """The right phase of every block of the texts that a `wrong` block belongs to."""
    due = guess.copy()
    mine = np.flatnonzero(np.isin(text, text[wrong]))
    before = mine[np.append(number[mine[1:]] > 0, False)]  # blocks with a next one are whole
    ends = dict(zip(before.tolist(), maps(padded, start[before]).tolist(), strict=True))
    at = 0
    for b in mine.tolist():
        at = ends[b - 1][at] if number[b] else 0
        due[b] = at * 256
    return due


def phases(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The phase (times 256) at which the walk of its text reaches each character."""
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[text] + number * BLOCK
    out = np.zeros(len(classes) + BLOCK, np.uint16)
    padded = np.concatenate([classes, np.zeros(BLOCK, np.uint8)])
    guess, end = np.zeros(len(text), np.uint16), np.zeros(len(text), np.uint16)
    todo, rounds = np.arange(len(text)), 0
    size = np.minimum(offsets[text + 1] - start, BLOCK) if len(text) else start
    while len(todo):
        deep = int(size[todo].max())
        rows = padded[start[todo][None, :] + np.arange(deep)[:, None]].astype(np.uint16)
        seen = np.empty(rows.shape, np.uint16)
        at = guess[todo]
        for t in range(deep):
            seen[t] = at
            at = AFTER[at | rows[t]]
        end[todo] = at
        for_block = np.arange(deep)[:, None] < size[todo][None, :]
        out[(start[todo][None, :] + np.arange(deep)[:, None])[for_block]] = seen[for_block]
        due = np.where(number > 0, np.roll(end, 1), 0).astype(np.uint16)
        rounds += 1
        if rounds == 2 and (due != guess).any():
            due = _composed(guess, padded, start, number, text, np.flatnonzero(due != guess))
        todo = np.flatnonzero(due != guess)
        guess = due
    return out[: len(classes)]


def fingerprints(texts: list[str]) -> list[str]:
    """A hex digit for each sampled step (of the character written there), '.' past the walk's end; '' for the empty text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    classes = (mixed(points.astype(np.uint64)) >> np.uint64(11)).astype(np.uint8)
    steps = np.zeros(len(points) + 1, np.int64)
    np.cumsum(STAY[phases(classes, offsets) | classes], out=steps[1:])
    walked = steps[offsets[1:]] - steps[offsets[:-1]]
    octaves = np.where(walked > 0, 1 + np.ceil(np.log2(np.maximum(walked, SAMPLES) / SAMPLES)).astype(np.int64), 0)
    counts = octaves * SAMPLES
    ends = np.cumsum(counts)
    place = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts)
    step = POSITIONS[place]
    inside = step < np.repeat(walked, counts)
    char = np.searchsorted(steps, np.repeat(steps[offsets[:-1]], counts) + step, "right") - 1
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    out = np.where(inside, digits[classes[np.minimum(char, max(len(classes) - 1, 0))] & 15] if len(classes) else 0, ord(".")).astype(np.uint8).tobytes().decode()
    return [out[a - n : a] for a, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """The share of the embedded strings that agrees, 0 to 1, less what chance gives; 1 for two empty texts."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode(), np.uint8) for s in (a, b))
    counted = ((x != 46) | (y != 46)) * WEIGHTS[:n]
    share = float(counted[x == y].sum() / counted.sum())
    return max(0.0, (share - 1 / 16) / (15 / 16))


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text column (null: of the empty text)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = [t or "" for t in batch.to_pylist()], []
            for part in _parts(texts):
                out += fingerprints(part)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def _parts(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Partitions of (__copy, id, text) that hold a range of ids in ascending order and, last, the row that follows.

    One shuffle of the texts: ranges are cut at ids that occur in the data, and the rows of
    those ids go to the range before them too (those of the smallest id to the last range).
    """
    small_batches(df.sparkSession)
    width = shuffle_width(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    cuts = F.percentile_approx("id", F.array(*[F.lit(i / width) for i in range(1, width)]), F.lit(20 * width)) if width > 1 else F.array()
    low, most = rows.agg(F.min("id"), cuts).first()
    bounds = sorted({low, *(most or [])} - {None}) or [0]
    bucket = F.greatest(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))) - 1, F.lit(0))
    # nulls come first of all
    first = F.col("id").isNull() if rows.where("id is null").limit(1).count() else F.col("id") == F.lit(bounds[0])
    before = F.when(first, F.lit(len(bounds) - 1)).when(F.col("id").isin(bounds), bucket - 1)
    homes = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("copy")), F.when(before.isNotNull(), F.struct(before.alias("bucket"), F.lit(True).alias("copy")))))
    dealt = rows.withColumn("__home", F.explode(homes)).select("id", "text", F.col("__home.copy").alias("copy"), F.col("__home.bucket").alias("bucket"))
    return dealt.repartitionById(len(bounds), F.col("bucket").cast("int")).sortWithinPartitions("copy", "id", "text").select("id", "text", "copy")


def neighbour_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document by id (after the last: the first).

    Null texts count as empty; rows that share an id follow each other by text; null ids come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts = [r[1] for r in held]
            made = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            prints = fingerprints(texts + made)
            own, other = prints[: len(texts)], prints[len(texts) :]
            n = len(made)
            return pa.RecordBatch.from_pydict(
                {
                    "id": [r[0] for r in held[:n]],
                    "n_chars": [len(t) for t in texts[:n]],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made],
                    "fingerprint": own[:n],
                    "edited_fingerprint": other,
                    "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
                },
                schema=schema,
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][2]:
                    continue  # the row that follows is there already
                held.append(row)
                size += len(row[1])
                if size >= 1 << 20 and len(held) > 1:
                    yield flush()
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield flush()

    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ddl = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = in_order(df.withColumn(id_col, F.col(f"`{id_col}`").cast("bigint")), id_col, text_col)
    return ordered.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


#: Digits of a band: every run of so many samples in an octave, as edits spoil runs of samples too. A key has 2^32 values.
DIGITS = 8
#: Members of a key that meet in one task, and a document's pairs with others of its key that are tried at first.
MEMBERS, FEW = 4096, 256


def _band_keys(prints: list[str]) -> list[np.ndarray]:
    """By print, a number for each band: its octave, its place in it, and its digits (of 17: '.' is one)."""
    of, octave, parts = [], [], []
    for i, p in enumerate(prints):
        last = len(p) // SAMPLES - 1
        for at in range(max(last - 2, 0), last + 1):
            part = p[at * SAMPLES : (at + 1) * SAMPLES]
            if at < last or last == 0 or "." not in part:
                of.append(i), octave.append(at), parts.append(part)
    if not parts:
        return [np.zeros(0, np.int64) for _ in prints]
    digits = _DIGIT[np.frombuffer("".join(parts).encode(), np.uint8)].reshape(-1, SAMPLES)
    bands = np.lib.stride_tricks.sliding_window_view(digits, DIGITS, axis=1) @ (17 ** np.arange(DIGITS, dtype=np.int64))
    keys = (np.array(octave)[:, None] * SAMPLES + np.arange(bands.shape[1])) * 17**DIGITS + bands
    ends = np.searchsorted(of, np.arange(len(prints) + 1)) * keys.shape[1]
    return [keys.ravel()[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


_DIGIT = np.zeros(256, np.int64)
_DIGIT[np.frombuffer(b"0123456789abcdef.", np.uint8)] = np.arange(17)


def band_keys(print_col: str) -> Column:
    """Keys of bands over the three highest full octaves: near copies share one, whichever octave their ends fall in."""

    def run(prints: pa.Array) -> pa.Array:
        return pa.array(_band_keys(prints.to_pylist()), pa.list_(pa.int64()))

    run.__annotations__ = {"prints": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(print_col)


def _end(print_col: str) -> Column:
    """A print with zeros for the samples before its three highest octaves, which are in no band."""
    rest = F.greatest(F.length(print_col) - 3 * SAMPLES, F.lit(0))
    return F.concat(F.repeat(F.lit("0"), rest), F.substring(print_col, rest + 1, F.lit(3 * SAMPLES)))


#: Hashed counts of neighbouring characters that stand for a text; an edit changes four of them by one at most.
COUNTS = 256


def profiles(texts: list[str]) -> np.ndarray:
    """(texts × COUNTS): how often each class of character pairs occurs, 65,535 at most: texts d edits apart differ by 4 d at most in all."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = text[1:] == text[:-1]
    classes = mixed(points[:-1] * np.uint64(0x110000) + points[1:]) % np.uint64(COUNTS)
    counts = np.bincount(text[1:][inside] * COUNTS + classes[inside].astype(np.int64), minlength=len(texts) * COUNTS)
    return np.minimum(counts, 65535).astype(np.uint16).reshape(-1, COUNTS)


def profile(text: Column | str) -> Column:
    """A text's `profiles`, as bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([row.tobytes() for part in _parts(batch.to_pylist()) for row in profiles(part)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance, None above `most`: furthest-reaching diagonals, so the work grows with the distance."""
    if abs(len(a) - len(b)) > most:
        return None
    goal, reach = len(b) - len(a), {0: -1}

    def slide(i: int, k: int) -> int:
        """The first place from i on where a differs from b, k further on: by stretches that double, then halve."""
        end, step = min(len(a), len(b) - k), 16
        if i < end and a[i] != b[i + k]:
            return i
        while i < end and a[i : min(i + step, end)] == b[i + k : min(i + step, end) + k]:
            i, step = min(i + step, end), 2 * step
        while step > 1 and i < end:
            step //= 2
            if a[i : min(i + step, end)] == b[i + k : min(i + step, end) + k]:
                i = min(i + step, end)
        return i

    for d in range(most + 1):
        now = {}
        for k in range(max(-d, goal - most + d), min(d, goal + most - d) + 1):  # from others the goal is too far
            i = 0 if d == 0 else max(reach.get(k - 1, -2), reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1)
            if i < 0 or i > len(a) or i + k > len(b) or i + k < 0:
                continue
            now[k] = slide(i, k)
            if k == goal and now[k] >= len(a):
                return d
        reach = now
    return None


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20) -> DataFrame:
    """(id_a, id_b, edits), id_a < id_b: documents whose texts are at most `most` edits apart, as many pairs as connect all that are so near and share a text or a band.

    Equal texts go with their smallest id. A band's other documents are compared with its
    first; where that leaves a band in several components, those are compared with each
    other by size and profile, in memory, and what that leaves by text, in rounds. Null texts are empty, and empty texts equal; rows whose id is null are
    left out; rows that repeat an id count as one document, that of the smallest text. An empty
    table has no pairs. Columns other than the id and the text play no part.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("id is not null")
    width = shuffle_width(df.sparkSession)
    # a walk from each end: an edit can leave a walk out of step for long, but only beyond it
    # a number of partitions that is asked for stays: few texts are much work
    prints = docs.repartition(width, "id").groupBy("id").agg(F.min("text").alias("text")).withColumn("print", fingerprint("text")).withColumn("back", fingerprint(F.reverse("text")))
    # what is kept is written as files of columns: prints, which are a tenth of their keys, and one shuffle at a time
    spark, at = df.sparkSession, scratch(df.sparkSession, "bands")
    marked = written(prints.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("size"), profile("text").alias("profile"), *[_end(p).alias(p) for p in ("print", "back")]), f"{at}/marked")
    own = marked.groupBy("digest").agg(F.min("id").alias("id_a"))
    copies = written(marked.select("id", "digest").join(own, "digest").where("id_a < id").select("id_a", F.col("id").alias("id_b"), F.lit(0).alias("edits")), f"{at}/copies")
    tidied(spark)
    different = written(marked.join(copies.select(F.col("id_b").alias("id")), "id", "left_anti").drop("digest"), f"{at}/different")
    removed(spark, f"{at}/marked")
    tidied(spark)
    facts = different.select("id", "profile")
    keys = F.concat(band_keys("print"), F.transform(band_keys("back"), lambda k: -1 - k))
    of_key = Window.partitionBy("key")
    keyed = different.select("id", "size", F.explode(keys).alias("key")).select("*", F.min(F.struct("id", "size")).over(of_key).alias("first"), F.max("id").over(of_key).alias("last"))
    # a key of one document has no pair
    keyed = written(keyed.where("first.id < last").select("id", "size", "key", F.col("first.id").alias("id_a"), F.col("first.size").alias("size_a")), f"{at}/keyed")
    tidied(spark)
    pairs = keyed.where((F.col("id_a") < F.col("id")) & (F.abs(F.col("size") - F.col("size_a")) <= most)).select("id_a", F.col("id").alias("id_b")).distinct()
    links = _verified(pairs, facts, docs, most)
    keyed, found, tried, cap = keyed.select("id", "size", "key"), [links], [], FEW
    while True:
        met = checkpointed(_torn_pairs(keyed, reduce(DataFrame.union, found), facts, most, cap))
        if not met.limit(1).count():
            break
        fresh = met.select("id_a", "id_b").distinct()
        found.append(_verified(reduce(lambda d, t: d.join(t.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti"), tried, fresh), None, docs, most))
        tried.append(met)
        if not met.where("more").limit(1).count():
            break
        cap *= 8
    return copies.union(reduce(DataFrame.union, found).dropDuplicates(["id_a", "id_b"]))


def _verified(pairs: DataFrame, facts: DataFrame | None, docs: DataFrame, most: int) -> DataFrame:
    """(id_a, id_b, edits) of the pairs that are near: profiles rule out most others before texts are fetched."""

    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, COUNTS).astype(np.int32) for v in (a, b))
        return pa.array(np.abs(x - y).sum(axis=1) <= 4 * most)

    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([edits(x, y, most) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    for f in (near, check):
        f.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    if facts is not None:
        both = with_side(with_side(checkpointed(pairs), facts, "id_b", "id_a"), facts, "id_a", "id_b")
        pairs = both.where(F.arrow_udf(near, "boolean")("own_id_a", "own_id_b")).select("id_a", "id_b")
    pairs = checkpointed(pairs)
    needed = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    texts = only_ids(docs, "id", needed).groupBy("id").agg(F.min("text").alias("text"))
    both = with_side(with_side(pairs, texts, "id_b", "id_a"), texts, "id_a", "id_b").repartition(shuffle_width(docs.sparkSession))
    return checkpointed(both.select("id_a", "id_b", F.arrow_udf(check, "int")("own_id_a", "own_id_b").alias("edits")).where("edits is not null"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20) -> DataFrame:
    """(id, group_id, kept) of each row: the smallest id reachable over near_pairs, and whether it is the row's own.

    Rows that repeat an id stay, with one group; a row whose id is null is no one's near text: its group_id is null and it is kept.
    """
    pairs = checkpointed(near_pairs(df, id_col, text_col, most).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    group = components(pairs).toDF("__node", "__group")
    ids = df.select(F.col(f"`{id_col}`").alias(id_col)).join(group, F.col(f"`{id_col}`") == F.col("__node"), "left")
    own = F.coalesce("__group", F.col(f"`{id_col}`"))
    return ids.select(id_col, own.alias("group_id"), own.eqNullSafe(F.col(f"`{id_col}`")).alias("kept"))


def _torn_pairs(keyed: DataFrame, links: DataFrame, facts: DataFrame, most: int, cap: int) -> DataFrame:
    """(id_a, id_b, more): documents of one key that `links` leaves in different components and whose sizes and profiles may be near; of a document the first `cap` that a block holds, `more` where others are left.

    Members meet by size: those of a slot of `most` + 1 sizes with each other and with the next slot's, in blocks. Texts don't move.
    """
    parts = components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumnRenamed("node", "id")
    slot = F.floor(F.col("size") / (most + 1))
    rows = keyed.join(parts, "id", "left").select("id", "size", "key", F.coalesce("component", "id").alias("component"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    torn = rows.groupBy("key", "slot").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")).where("x < y")
    met = rows.join(torn.drop("x", "y"), ["key", "slot"])
    # the same members may meet in many keys: once is enough
    alike = met.groupBy("key", "slot", "blocks").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("xor"), F.count("*").alias("n"))
    once = alike.groupBy("slot", "sum", "xor", "n").agg(F.min("key").alias("key"))
    met = met.join(once.select("key", "slot"), ["key", "slot"])
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("key", "slot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "size", "component").join(facts, "id")
    group = ["key", "slot", "low", "high"]
    together = dealt.select(*group, "own", "id", "size", "component", "profile").repartition(*group).sortWithinPartitions(*group, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for *key, own, i, size, component, profile in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and at != key:
                    yield pa.RecordBatch.from_pylist(_candidates(held, at[1], at[2] != at[3], most, cap), schema)
                    held = []
                at = key
                held.append((own, i, size, component, profile))
        if held:
            yield pa.RecordBatch.from_pylist(_candidates(held, at[1], at[2] != at[3], most, cap), schema)

    kind = keyed.schema["id"].dataType
    schema = pa.schema([("id_a", to_arrow_type(kind)), ("id_b", to_arrow_type(kind)), ("more", pa.bool_())])
    return together.mapInArrow(compare, f"id_a {kind.simpleString()}, id_b {kind.simpleString()}, more boolean")


def _candidates(members: list, slot: int, across: bool, most: int, cap: int) -> list[dict]:
    """Pairs of (block, id, size, component, profile), by ascending id, in two components, with one in the slot, that sizes and profiles leave a chance; `across`: of different blocks only."""
    numbers: dict = {}
    block, size = (np.array([m[c] for m in members], np.int64) for c in (0, 2))
    component = np.array([numbers.setdefault(m[3], len(numbers)) for m in members])
    counts = np.frombuffer(b"".join(m[4] for m in members), np.uint16).reshape(-1, COUNTS).astype(np.int32)
    here, out = size // (most + 1) == slot, []
    for j in range(1, len(members)):
        may = (np.abs(size[:j] - size[j]) <= most) & (component[:j] != component[j]) & (here[:j] | here[j])
        at = np.flatnonzero(may & (block[:j] != block[j]) if across else may)
        at = at[np.abs(counts[at] - counts[j]).sum(axis=1) <= 4 * most]
        out += [{"id_a": members[i][1], "id_b": members[j][1], "more": len(at) > cap} for i in at[:cap].tolist()]
    return out
