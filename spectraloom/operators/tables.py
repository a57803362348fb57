"""Shapes of work that several ledgers share: top rows by group, latest rows, upserts, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.session import checkpointed, running


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int, slices: int = 32, salt: list[str] | None = None) -> DataFrame:
    """The first k rows of each group, with their `place`.

    Groups may be few and large: rows are ranked inside hashed slices of a group first, so
    that the final window sees `slices` times k rows of each. `order` must break every tie.
    """
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*(salt or df.columns)), F.lit(slices)))
    first = sliced.withColumn("place", F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*order))).where(F.col("place") <= k)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("__slice")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, combined before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows, and the first incoming row of each key that isn't stored: inserting twice changes nothing."""
    rest = [c for c in incoming.columns if c not in keys]
    firsts = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
    return stored.unionByName(firsts.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows whose key no incoming row has, and the last incoming row of each key."""
    last = latest(incoming, keys, order)
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def distinct_in_order(df: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """(by…, name): each group's distinct values as a list, in the order of their first rows. Repeats are dropped before values are gathered."""
    firsts = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__first"))
    listed = F.array_sort(F.collect_list(F.struct("__first", value)))
    return firsts.groupBy(*by).agg(F.transform(listed, lambda r: r[value]).alias(name))


def long_values(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep…, field, value): each value of each numeric column as a row; nulls go."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]))
    return df.select(*keep, each.alias("__x")).select(*keep, "__x.*").where("value is not null")


#: Groups whose values are sent to all tasks, at most, and the slices of a group where there are more.
FEW_GROUPS, SLICES = 100_000, 32


def with_values(df: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their group's only row in `values`; rows of a group, however many, stay spread over tasks. Groups with a null key are left out."""
    values = checkpointed(values)
    if values.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return df.join(F.broadcast(values), by)
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*df.columns), F.lit(SLICES)))
    return sliced.join(values.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint")))), [*by, "__slice"]).drop("__slice")


def value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by…, field, value, n): how often each value of each column occurs."""
    return long_values(df, by, columns).groupBy(*by, "field", "value").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, by: list[str], shares: list[float], amounts: list[str] | None = None) -> DataFrame:
    """(by…, n, q) of value counts (by…, value, n): exact quantiles, linearly interpolated, however many values a group has.

    With `amounts`, the names of several count columns, (by…, q_<amount>…): the quantiles under each, NULL where
    it counts nothing. Values are placed by running sums over ranges, so no task holds a group. Groups with a null key are left out.
    """
    named = amounts or ["n"]
    both = running(counts, by, ["value"], named, [f"__before_{i}" for i in range(len(named))], [f"__total_{i}" for i in range(len(named))])
    place = lambda i, share: (F.col(f"__total_{i}") - 1) * F.lit(float(share))
    ends = [F.max(f"__total_{i}").alias(f"__total_{i}") for i in range(len(named))]
    for i, a in enumerate(named):
        for j, share in enumerate(shares):
            for end, at in (("low", F.floor(place(i, share))), ("high", F.ceil(place(i, share)))):
                here = (F.col(f"__before_{i}") <= at) & (at < F.col(f"__before_{i}") + F.col(a))
                ends.append(F.max(F.when(here, F.col("value"))).alias(f"__{end}_{i}_{j}"))
    each = both.groupBy(*by).agg(*ends)
    part = lambda i, share: place(i, share) - F.floor(place(i, share))
    cut = lambda i, j, share: F.col(f"__low_{i}_{j}") + (F.col(f"__high_{i}_{j}") - F.col(f"__low_{i}_{j}")) * part(i, share)
    cuts = [F.array(*[cut(i, j, share) for j, share in enumerate(shares)]) for i in range(len(named))]
    if amounts is None:
        return each.select(*by, F.col("__total_0").alias("n"), cuts[0].alias("q"))
    return each.select(*by, *[c.alias(f"q_{a}") for c, a in zip(cuts, named, strict=True)])
