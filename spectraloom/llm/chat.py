"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation opens with an optional system turn, then user and assistant turns
alternate, and the assistant closes. Dynamic programming over this automaton chooses for
each turn whether it keeps its role, takes another (RELABEL; NAME
where its own is unknown), is merged into the turn
before it (MERGE), or is preceded by empty turns (INSERT each), at the smallest total cost.

The costs of a run of turns are a small matrix of the states before and after, and runs
combine by min-plus products. Turns are dealt out in ranges of their order, so a conversation
may lie in several partitions; those of its runs are summed up by one matrix each, which settles
the states at the partitions' borders, and then each partition is solved apart, over many
conversations at once. No task needs a whole conversation, and none is called for each of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from spectraloom.llm.textbatch import small_batches
from spectraloom.session import checkpointed, shuffle_width

# The roles, other names of theirs, and the costs of the repairs.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, INSERT, RELABEL, NAME = 1.0, 2.0, 4.0, 1.0
#: States: 0 before the first turn, then 1 + the last turn's role. Legal next roles of each.
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FINAL = 3
STATES = 4
#: Turns of a run that are stepped through at once (longer runs are cut), turns of a segment, and bytes of text of a range.
FAN, SEGMENT, RANGE_BYTES = 256, 4096, 256 << 20


def routes(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns between a state and a role; None where no number helps."""
    for n in range(4):
        for between in itertools.product(range(3), repeat=n):
            at, legal = state, True
            for r in (*between, role):
                legal = legal and r in NEXT[at]
                at = 1 + r
            if legal:
                return between
    return None


def moves(role: int) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """(state before, state after) of one turn of `role` (3: none that is known): cost, action and empty turns put before it."""
    out: dict = {}
    for state in range(STATES):
        for new in range(3):
            relabel = 0.0 if new == role else NAME if role == 3 else RELABEL
            options = []
            if state == 1 + new:
                options.append((relabel + MERGE, "merge", ()))
            if (between := routes(state, new)) is not None:
                options.append((relabel + INSERT * len(between), "keep" if new == role else "relabel", between))
            if options:
                out[state, 1 + new] = min(options, key=lambda x: (x[0], x[1] != "keep", len(x[2])))
    return out


MOVES = [moves(r) for r in range(4)]
COSTS = np.full((4, STATES, STATES), np.inf)
for _r, _m in enumerate(MOVES):
    for (_a, _b), (_cost, *_rest) in _m.items():
        COSTS[_r, _a, _b] = _cost
#: From each state to the legal end, by empty turns.
ENDINGS = {s: (() if s in (0, FINAL) else routes(s, 2) + (2,)) for s in range(STATES)}
END_COSTS = np.array([INSERT * len(ENDINGS[s]) for s in range(STATES)])


Step = Callable[[np.ndarray], np.ndarray]


def _by_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs, longest first, and how many of them have a t-th turn, for each t."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max()) if len(lengths) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(most), "left")


def totals(step: Step, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The costs of each run from the state before to the state after: the min-plus product of its turns' matrices."""
    out = np.full((len(starts), STATES, STATES), np.inf)
    out[:, range(STATES), range(STATES)] = 0
    order, live = _by_length(starts, ends)
    for t, n in enumerate(live.tolist()):
        runs = order[:n]
        out[runs] = (out[runs][:, :, :, None] + step(starts[runs] + t)[:, None, :, :]).min(axis=2)
    return out


def paths(step: Step, size: int, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state after each turn on each run's cheapest way from `entry`; `last` are the run's costs of ending in each state. Ties: the smallest state, from the end on."""
    reach = np.where(np.arange(STATES) == entry[:, None], 0.0, np.inf)
    back, states = np.zeros((size, STATES), np.uint8), np.zeros(size, np.uint8)
    order, live = _by_length(starts, ends)
    for t, n in enumerate(live.tolist()):
        runs = order[:n]
        cost = reach[runs][:, :, None] + step(starts[runs] + t)
        back[starts[runs] + t] = cost.argmin(axis=1)
        reach[runs] = cost.min(axis=1)
    here = (reach + last).argmin(axis=1)
    for t, n in reversed(list(enumerate(live.tolist()))):
        runs = order[:n]
        at = starts[runs] + t
        states[at] = here[runs]
        here[runs] = back[at, here[runs]]
    return states


def _pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces of at most FAN turns, and each run's first piece (n + 1)."""
    counts = np.maximum(-(-(ends - starts) // FAN), 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(starts, counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * FAN
    return begin, np.minimum(begin + FAN, np.repeat(ends, counts)), first


def solved(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state after each turn of all runs: pieces are summed up first, so that long runs too are solved side by side."""
    turn = lambda at: COSTS[kinds[at]]
    begin, end, first = _pieces(starts, ends)
    if len(begin) > len(starts):
        sums = totals(turn, begin, end)
        leave = paths(lambda at: sums[at], len(begin), first[:-1], first[1:], entry, last).astype(np.int64)
        before = np.concatenate([[0], leave[:-1]])
        before[first[:-1]] = entry
        starts, ends, entry, last = begin, end, before, np.where(np.arange(STATES) == leave[:, None], 0.0, np.inf)
    return paths(turn, len(kinds), starts, ends, entry, last)


def run_total(kinds: np.ndarray) -> np.ndarray:
    """The costs of one run of any length."""
    begin, end, _ = _pieces(np.array([0]), np.array([len(kinds)]))
    sums = totals(lambda at: COSTS[kinds[at]], begin, end)
    return totals(lambda at: sums[at], np.array([0]), np.array([len(sums)]))[0]


def _starts(ids: pa.Array) -> np.ndarray:
    """The rows at which another id begins; nulls are equal."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _edges(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's first and last run of (conv, part, kind) rows, the runs that may go on elsewhere."""
    rows: list[dict] = []
    part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, kinds = batch.column(0), batch.column(2).to_numpy()
        part = batch.column(1)[0].as_py()
        cuts = [*_starts(ids).tolist(), batch.num_rows]
        for low, high in sorted({(cuts[0], cuts[1]), (cuts[-2], cuts[-1])}):
            conv, cost = ids[low].as_py(), run_total(kinds[low:high])
            if rows and rows[-1]["conv"] == conv:
                rows[-1]["cost"] = totals(lambda at, m=np.array([rows[-1]["cost"], cost]): m[at], np.array([0]), np.array([2]))[0]
            elif len(rows) < 2:
                rows.append({"conv": conv, "cost": cost})
            else:
                rows[1] = {"conv": conv, "cost": cost}
    yield pa.RecordBatch.from_pylist([{"part": part, "place": i, "conv": r["conv"], "cost": r["cost"].ravel().tolist()} for i, r in enumerate(rows)], schema)


def _borders(edges: list) -> dict[tuple[int, int], tuple[int, int, bool]]:
    """For each edge run (part, place): the state before it, the state after it and whether its conversation ends with it."""
    edges = sorted(edges, key=lambda r: (r["part"], r["place"]))
    if not edges:
        return {}
    cuts = np.array([i for i, r in enumerate(edges) if i == 0 or r["conv"] != edges[i - 1]["conv"]])
    costs = np.array([r["cost"] for r in edges]).reshape(-1, STATES, STATES)
    ends = np.append(cuts[1:], len(edges))
    leave = paths(lambda at: costs[at], len(edges), cuts, ends, np.zeros(len(cuts), np.int64), np.tile(END_COSTS, (len(cuts), 1))).tolist()
    opening, closing = set(cuts.tolist()), set((ends - 1).tolist())
    return {(r["part"], r["place"]): (0 if i in opening else leave[i - 1], leave[i], i in closing) for i, r in enumerate(edges)}


#: What repaired() adds to a turn.
TURN_FIELDS = [StructField(c, t) for c, t in (("segment", LongType()), ("place", IntegerType()), ("opens", BooleanType()), ("action", StringType()), ("new_role", StringType()), ("cost", DoubleType()), ("inserted", ArrayType(StringType())), ("appended", ArrayType(StringType())), ("closes", BooleanType()))]
#: By kind, state before and state after: what is done with the turn.
_codes = [(k, a, b) for k in range(4) for a in range(STATES) for b in range(STATES)]
_taken = [MOVES[k].get((a, b), (0.0, "keep", ())) for k, a, b in _codes]
ACTIONS = pa.array([t[1] for t in _taken])
PRICES = pa.array([t[0] for t in _taken])
INSERTED = pa.array([[ROLES[r] for r in t[2]] for t in _taken], pa.list_(pa.string()))
NEW_ROLES = pa.array([ROLES[max(b - 1, 0)] for _, _, b in _codes])
APPENDED = pa.array([[], *[[ROLES[r] for r in ENDINGS[s]] for s in range(STATES)]], pa.list_(pa.string()))


def _repairs(runs: pa.Table, cuts: np.ndarray, borders: list[tuple[int, int, bool] | None], row: int, schema: pa.Schema) -> pa.RecordBatch:
    """The repaired turns of whole runs (conv, turn, role, text, kind, part), which begin at `cuts`; `row` is their first row's number in its partition."""
    kinds = runs.column("kind").to_numpy().astype(np.int64)
    n, ends = len(kinds), np.append(cuts[1:], len(kinds))
    entry, last, closes = np.zeros(len(cuts), np.int64), np.tile(END_COSTS, (len(cuts), 1)), np.ones(len(cuts), bool)
    for i in [i for i, b in enumerate(borders) if b is not None]:
        entry[i], leave, closes[i] = borders[i]
        last[i] = np.where(np.arange(STATES) == leave, 0.0, np.inf)
    states = solved(kinds, cuts, ends, entry, last).astype(np.int64)
    before = np.concatenate([[0], states[:-1]])
    before[cuts] = entry
    code = pa.array((kinds * STATES + before) * STATES + states)
    closing = np.zeros(n, bool)
    closing[ends[closes] - 1] = True
    number = row + np.arange(n)
    part = runs.column("part").to_numpy().astype(np.int64)
    made = {
        "segment": pa.array((part << 32) + number // SEGMENT), "place": pa.array((number % SEGMENT).astype(np.int32)), "opens": pa.array(before == 0),
        "action": ACTIONS.take(code), "new_role": NEW_ROLES.take(code), "cost": PRICES.take(code), "inserted": INSERTED.take(code), "appended": APPENDED.take(pa.array(np.where(closing, states + 1, 0))), "closes": pa.array(closing),
    }
    own = [runs.column(c).combine_chunks() for c in ("conv", "turn", "role", "text")]
    return pa.RecordBatch.from_arrays([*own, *made.values()], schema=schema)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv_id, turn, role, text, segment and place in it (they order a conversation's turns), action (keep, relabel, merge),
    new_role, inserted and appended (roles of the empty turns before it, and after the conversation's last).

    Turns are ordered by number, then role, then text, nulls first; repeated rows stay. Null
    conversation ids are one conversation, and ids of any type that sorts will do. Role names
    count in any case, with their aliases; unknown and null roles are relabelled. Of equally
    cheap repairs the smallest states from the end of a run on are taken. A task holds one
    run at most: a conversation's turns in one range, which the number of ranges keeps near RANGE_BYTES. Rows
    alike in all four columns stay in one range. Columns other than the four play no part.
    """
    small_batches(df.sparkSession)
    name = F.lower(F.trim(F.col(f"`{role}`")))
    for alias, own in ALIASES.items():
        name = F.when(F.lower(F.trim(F.col(f"`{role}`"))) == alias, own).otherwise(name)
    number = F.coalesce(*[F.when(name == r, i) for i, r in enumerate(ROLES)], F.lit(3))
    turns = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"), number.cast("int").alias("kind"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    size = turns.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    ranges = max(shuffle_width(df.sparkSession), -(-size // RANGE_BYTES))
    ranged = checkpointed(turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    key = ranged.schema["conv"]
    edge_schema = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv", to_arrow_type(key.dataType)), ("cost", pa.list_(pa.float64()))])
    edges = ranged.select("conv", "part", "kind").mapInArrow(lambda batches: _edges(batches, edge_schema), f"part int, place int, conv {key.dataType.simpleString()}, cost array<double>")
    sent = df.sparkSession.sparkContext.broadcast(_borders(edges.collect()))  # two rows a partition at most

    result = StructType([StructField("conv_id", key.dataType), *[StructField(c, t) for c, t in (("turn", LongType()), ("role", StringType()), ("text", StringType()))], *TURN_FIELDS])
    schema = to_arrow_schema(result)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = sent.value
        held: list[pa.RecordBatch] = []
        row, fresh = 0, True

        def flush(runs: list[pa.RecordBatch], final: bool) -> pa.RecordBatch:
            whole = pa.Table.from_batches(runs)
            cuts, part = _starts(whole.column("conv").combine_chunks()), whole.column("part")[0].as_py()
            known: list = [None] * len(cuts)
            if fresh:
                known[0] = borders[part, 0]
            elif final:
                known[0] = borders[part, 1]  # the last run stands alone
            return _repairs(whole, cuts, known, row, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(batch.column(0))[-1])
            if last:
                done, held = [*held, batch.slice(0, last)], [batch.slice(last)]
            elif held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                done, held = held, [batch]
            else:
                held.append(batch)
                continue
            yield flush(done, False)
            row, fresh = row + sum(b.num_rows for b in done), False
        if held:
            yield flush(held, True)

    return ranged.mapInArrow(repair, result)


def rendered(turns: DataFrame) -> DataFrame:
    """Adds `fragment` to repaired turns: fragments in order, joined, are the rendered conversation. Null texts are empty; markers inside texts are broken up."""
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), "")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< |")
    opened = F.concat(F.when(F.col("opens"), "").otherwise("<|end|>\n"), empty("inserted"), F.lit("<|"), "new_role", F.lit("|>\n"), body)
    closing = F.when(F.col("closes"), F.concat(F.lit("\n<|end|>\n"), empty("appended"))).otherwise(F.lit(""))
    return turns.withColumn("fragment", F.concat(F.when(F.col("action") == "merge", F.concat(F.lit("\n"), body)).otherwise(F.concat(F.when(F.col("opens"), "").otherwise("\n"), opened)), closing))


#: Characters of a row of rendered text.
ROW_CHARS = 64 << 20


def conversations(turns: DataFrame, most: int = ROW_CHARS) -> DataFrame:
    """(conv_id, part, text): rendered conversations, whole in one row (part 0) but for those of more than `most` characters, which come in several rows to be joined in order.

    Fragments are joined by segment and only then by conversation, so no task holds more than a row's text.
    """
    joined = lambda what, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda p: p[what]), "").alias("text")
    segments = turns.groupBy("conv_id", "segment").agg(joined("fragment", "place"))
    before = F.sum(F.char_length("text").cast("bigint")).over(Window.partitionBy("conv_id").orderBy("segment")) - F.char_length("text")
    return segments.withColumn("part", F.floor(before / most)).groupBy("conv_id", "part").agg(joined("text", "segment"))
