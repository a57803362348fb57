"""User-declared derived columns: a closed set of operations, compiled to one select."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import roles, scalars

PAIRS = ("ratio", "log_ratio", "difference", "normalized_difference")
OPERATIONS = (*PAIRS, "product", "weighted_sum")
EPSILON = 1e-12
#: Finite values that a column must have to be kept.
LEAST_FINITE = 10
#: Roles that no descriptor may be made from.
FORBIDDEN = ("outcome", "performance", "structure_proxy", "test_condition", "identity", "quality", "spectrum_quality")


@dataclass(frozen=True)
class Spec:
    symbol: str
    operation: str
    inputs: tuple[str, ...]
    parameters: dict[str, float] = field(default_factory=dict)
    scope: tuple[str, ...] = ()
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    evidence: tuple[str, ...] = ()
    queries: tuple[str, ...] = ("search",)


def problems(spec: Spec) -> list[str]:
    """What is wrong with a spec by itself, in a fixed order; empty if nothing is."""
    allowed = {"epsilon"} | ({f"w{i + 1}" for i in range(len(spec.inputs))} if spec.operation == "weighted_sum" else set())
    ends = [v for pair in spec.bounds.values() for v in pair if v is not None]
    checks = (
        ("symbol", re.fullmatch(r"[A-Za-z][A-Za-z0-9_]{1,39}", spec.symbol) is not None),
        ("operation", spec.operation in OPERATIONS),
        ("arity", 2 <= len(spec.inputs) <= 8 and (spec.operation not in PAIRS or len(spec.inputs) == 2)),
        ("repeated input", len(set(spec.inputs)) == len(spec.inputs)),
        ("parameter", all(map(math.isfinite, spec.parameters.values())) and spec.parameters.get("epsilon", EPSILON) > 0),
        ("unknown parameter", not set(spec.parameters) - allowed),
        ("bounds", set(spec.bounds) <= set(spec.inputs) and all(map(math.isfinite, ends)) and all(a is None or b is None or a <= b for a, b in spec.bounds.values())),
        ("no query", bool(spec.queries)),
    )
    return [name for name, fine in checks if not fine]


def value(operation: str, inputs: list[Column], parameters: dict[str, float] | None = None) -> Column:
    """The operation over numeric columns; NULL wherever an input is, or the operation isn't defined."""
    parameters = parameters or {}
    eps = float(parameters.get("epsilon", EPSILON))
    a, b = inputs[0], inputs[1]
    if operation == "ratio":
        made = F.when(F.abs(b) > eps, a / b)
    elif operation == "log_ratio":
        made = F.when((a > eps) & (b > eps), F.ln(a / b))
    elif operation == "difference":
        made = a - b
    elif operation == "normalized_difference":
        made = F.when(F.abs(a) + F.abs(b) > eps, (a - b) / (F.abs(a) + F.abs(b)))
    elif operation == "product":
        made = reduce(mul, inputs)
    elif operation == "weighted_sum":
        made = reduce(add, [F.lit(float(parameters.get(f"w{i + 1}", 1.0))) * c for i, c in enumerate(inputs)])
    else:
        raise ValueError(f"unknown operation {operation}")
    return scalars.finite(made)


def numeric(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return scalars.finite_double(F.col(f"`{column}`")) if kind == "string" else scalars.finite(F.col(f"`{column}`").cast("double"))


def gate(df: DataFrame, spec: Spec, dataset: str = "dataset") -> Column:
    """Where the spec applies: its datasets, and each bounded input inside its bounds."""
    holds = [F.lit(True)]
    if spec.scope:
        holds.append(F.coalesce(F.col(dataset).isin(*spec.scope), F.lit(False)))
    for name, (low, high) in spec.bounds.items():
        v = numeric(df, name)
        holds += [F.coalesce(v >= low, F.lit(False))] if low is not None else []
        holds += [F.coalesce(v <= high, F.lit(False))] if high is not None else []
    return reduce(and_, holds)


def computed(df: DataFrame, spec: Spec, dataset: str = "dataset") -> Column:
    return F.when(gate(df, spec, dataset), value(spec.operation, [numeric(df, c) for c in spec.inputs], spec.parameters))


def materialised(df: DataFrame, specs: list[Spec], dataset: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """The table with the accepted specs' columns, and a manifest (symbol, accepted, reason, finite, coverage).

    A bad spec is rejected alone; the others take one pass for their counts and one select.
    A column needs LEAST_FINITE finite values. Symbols already taken, by the table or an
    earlier spec, are rejected.
    """
    taken, good, reasons = {c.lower() for c in df.columns}, [], {}
    for i, spec in enumerate(specs):
        found = problems(spec) + [f"input {c} is missing" for c in spec.inputs if c not in df.columns] + (["symbol is taken"] if spec.symbol.lower() in taken else [])
        if found:
            reasons[i] = "; ".join(found)
        else:
            taken.add(spec.symbol.lower())
            good.append((i, computed(df, spec, dataset)))
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in good]).first()
    manifest = []
    for i, spec in enumerate(specs):
        n = counts[f"n{i}"] if i not in reasons else None
        if n is not None and n < LEAST_FINITE:
            reasons[i] = "too few finite values"
        manifest.append((spec.symbol, i not in reasons, reasons.get(i), n, n / counts["rows"] if n is not None and counts["rows"] else None))
    kept = df.select("*", *[c.alias(specs[i].symbol) for i, c in good if i not in reasons])
    return kept, df.sparkSession.createDataFrame(manifest, "symbol string, accepted boolean, reason string, finite bigint, coverage double")


def references(specs: DataFrame, columns: DataFrame, evidence: DataFrame, reserved: DataFrame) -> DataFrame:
    """(spec_id, reasons): specs (spec_id, symbol, inputs, evidence_ids) whose inputs are missing from `columns` (name, role) or have a forbidden role,
    whose cited ids aren't in `evidence` (evidence_id), or whose symbol is in `reserved` (symbol); sorted reasons, specs without any are absent."""
    inputs = specs.select("spec_id", F.explode("inputs").alias("name"))
    missing = inputs.join(columns, "name", "left_anti").select("spec_id", F.concat(F.lit("missing:"), "name").alias("reason"))
    bad = F.col("role").isin(*FORBIDDEN) | roles.is_known_descriptor("name") | roles.is_quality("name")
    forbidden = inputs.join(columns.where(bad), "name").select("spec_id", F.concat(F.lit("forbidden:"), "name").alias("reason"))
    cited = specs.select("spec_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id", "left_anti").select("spec_id", F.concat(F.lit("evidence:"), "evidence_id").alias("reason"))
    symbols = specs.join(reserved, "symbol", "left_semi").select("spec_id", F.concat(F.lit("reserved:"), "symbol").alias("reason"))
    every = missing.unionByName(forbidden).unionByName(cited).unionByName(symbols)
    return every.groupBy("spec_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
