"""Record tables: sheets as cells, headers, column profiles, numbering, and linkage to spectra and papers.

A cell table has (source, sheet, row_no, col_no, value); row_no is 1-based in the file, so
blank rows never shift it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.operators.tables import quantiles, value_counts, with_values

# Words of header cells.
HEADER_TERMS = ("doi", "sample", "membrane", "flux", "permeance", "rejection", "selectivity", "pressure", "temperature", "xps", "n1s", "o1s", "binding")
SHEET = ("source", "sheet")


def filled(c: str = "value") -> Column:
    return F.coalesce(scalars.stripped(c) != "", F.lit(False))


def header_rows(cells: DataFrame, first: int = 8, terms: tuple[str, ...] = HEADER_TERMS) -> DataFrame:
    """(source, sheet, header_row): the row, of the first eight, that looks most like a header; the first of equals.

    A row scores its non-numeric cells, thrice its cells with a header term, its share of
    distinct cells, less a tenth of its place.
    """
    text = scalars.stripped("value")
    term = F.lower(text).rlike("|".join(terms))
    place = F.col("row_no") - F.min("row_no").over(Window.partitionBy(*SHEET))
    rows = cells.withColumn("place", place).where((F.col("place") < first) & filled()).groupBy(*SHEET, "row_no", "place")
    scored = rows.agg(F.count_if(~text.rlike(scalars.NUMBER)).alias("texts"), F.count_if(term).alias("terms"), F.count_distinct(text).alias("kinds"), F.count("*").alias("n"))
    score = F.round(F.col("texts") + 3 * F.col("terms") + F.col("kinds") / F.col("n") - 0.1 * F.col("place"), 9)
    return scored.withColumn("score", score).groupBy(*SHEET).agg(F.max_by("row_no", F.struct("score", -F.col("row_no"))).alias("header_row"))


def three_level(cells: DataFrame) -> DataFrame:
    """(source, sheet, three_level): four rows or more; the first three rows half filled, hardly numeric; blanks in the first two."""
    w = Window.partitionBy(*SHEET)
    near = cells.withColumns({"place": F.col("row_no") - F.min("row_no").over(w), "width": F.max("col_no").over(w) - F.min("col_no").over(w) + 1, "height": F.max("row_no").over(w) - F.min("row_no").over(w) + 1})
    text, head = scalars.stripped("value"), F.col("place") < 3
    agg = near.groupBy(*SHEET).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.count_if(head & filled()).alias("full"), F.count_if(head & filled() & text.rlike(scalars.NUMBER)).alias("numeric"), F.count_if((F.col("place") < 2) & filled()).alias("top")
    )
    holds = (F.col("height") >= 4) & (F.col("full") >= 1.5 * F.col("width")) & (F.col("numeric") < 0.1 * F.greatest(F.col("full"), F.lit(1))) & (F.col("top") < 2 * F.col("width"))
    return agg.select(*SHEET, holds.alias("three_level"))


def hierarchical_names(cells: DataFrame, depth: int = 3) -> DataFrame:
    """(source, sheet, col_no, name): the first `depth` rows joined by ' | '. Level 0 is carried to the right, level 1 only within its section."""
    w = Window.partitionBy(*SHEET)
    rows = cells.withColumn("place", F.col("row_no") - F.min("row_no").over(w)).where(F.col("place") < depth)
    wide = rows.groupBy(*SHEET, "col_no").pivot("place", list(range(depth))).agg(F.first(F.when(filled(), scalars.stripped("value")), ignorenulls=True))
    right = w.orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    level = wide.withColumn("0", F.last("0", ignorenulls=True).over(right))
    section = F.sum(F.coalesce(~F.col("0").eqNullSafe(F.lag("0").over(w.orderBy("col_no"))), F.lit(True)).cast("int")).over(right)
    level = level.withColumn("section", section)
    inside = Window.partitionBy(*SHEET, "section").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    if depth > 1:
        level = level.withColumn("1", F.last("1", ignorenulls=True).over(inside))
    parts = F.array_distinct(F.array_compact(F.array(*[F.col(str(k)) for k in range(depth)])))
    return level.select(*SHEET, "col_no", F.array_join(parts, " | ").alias("name"))


def flat_names(names: DataFrame) -> DataFrame:
    """Cleaned names: spaces collapsed, blanks named by their place, the n-th repeat with suffix __n."""
    w = Window.partitionBy(*SHEET)
    plain = F.regexp_replace(scalars.stripped(F.coalesce("name", F.lit(""))), r"\s+", " ")
    place = F.row_number().over(w.orderBy("col_no")) - 1
    named = names.withColumn("name", F.when(plain == "", F.concat(F.lit("unnamed_"), place)).otherwise(plain))
    repeat = F.row_number().over(Window.partitionBy(*SHEET, "name").orderBy("col_no"))
    return named.withColumn("repeat", repeat).withColumn("name", F.when(F.col("repeat") > 1, F.concat_ws("__", "name", "repeat")).otherwise(F.col("name"))).drop("repeat")


def without_blank(cells: DataFrame) -> DataFrame:
    """Cells of rows, and then of columns, that hold anything."""
    kept = cells.where(filled())
    rows, columns = kept.select(*SHEET, "row_no").distinct(), kept.select(*SHEET, "col_no").distinct()
    return cells.join(rows, [*SHEET, "row_no"], "left_semi").join(columns, [*SHEET, "col_no"], "left_semi")


def cells_of_text(files: DataFrame, separator: str = ",") -> DataFrame:
    """Cells of whole delimited texts (source, sheet, content): lines numbered before blank ones go."""
    lines = files.select("source", "sheet", F.posexplode(F.split("content", r"\r?\n")).alias("r", "line"))
    cells = lines.where(F.trim("line") != "").select("source", "sheet", (F.col("r") + 1).alias("row_no"), F.posexplode(F.split("line", separator)).alias("col_no", "value"))
    return cells


def unpivoted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids…, column, value): the columns as texts, one row each."""
    return df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(ids, columns, "column", "value")


def column_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, column, rows, non_null, numeric_fraction over all rows, unique): what an audit reports of each column."""
    long = unpivoted(df, by or [], columns)
    return long.groupBy(*(by or []), "column").agg(
        F.count("*").alias("rows"), F.count("value").alias("non_null"), F.avg(scalars.finite_double("value").isNotNull().cast("int")).alias("numeric_fraction"), F.count_distinct("value").alias("unique")
    )


def wide_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, non_null, numeric_count, coverage, type) after marker cleaning: one aggregate of the wide table, then one row is unpivoted."""
    aggs = []
    for i, c in enumerate(columns):
        clean = scalars.clean_marker(F.col(f"`{c}`").cast("string"))
        aggs += [F.count(clean).alias(f"n{i}"), F.count(scalars.finite_double(clean)).alias(f"f{i}")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"f{i}").alias("numeric_count")) for i, c in enumerate(columns)]))
    long = one.select("rows", each.alias("c")).select("rows", "c.*")
    share = F.col("numeric_count") / F.greatest("non_null", F.lit(1))
    return long.select("column", "rows", "non_null", "numeric_count", F.when(F.col("rows") > 0, F.col("non_null") / F.col("rows")).alias("coverage"), F.when(share >= 0.8, "numeric").otherwise("categorical").alias("type"))


def reference_column(names: DataFrame) -> DataFrame:
    """(source, sheet, name): the last column named ref, ending in ' | ref', or holding the reference keyword; sheets without one have none."""
    lower = F.lower("name")
    match = (lower == "ref") | lower.endswith(" | ref") | F.col("name").contains("参考文献")
    return names.where(match).groupBy(*SHEET).agg(F.max_by("name", "col_no").alias("name"))


def sample_number(keys: list[str], order: list[str]) -> Column:
    """1, 2, … within the keys, in source order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def record_id(dataset: str, reference: str, sample: str) -> Column:
    return F.concat_ws("-", dataset, F.col(reference).cast("string"), F.col(sample).cast("string"))


def conflict_free(files: DataFrame, keys: list[str], content: str = "sha256", order: str = "path") -> DataFrame:
    """Files of each key with one distinct content: the first of identical copies; keys with several contents are left out."""
    conflicts = files.groupBy(*keys).agg(F.count_distinct(content).alias("n")).where("n > 1").select(*keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return files.join(conflicts, keys, "left_anti").withColumn("__first", first).where("__first = 1").drop("__first")


def linked(records: DataFrame, spectra: DataFrame, elements: list[str], metrics: list[str]) -> DataFrame:
    """Records with the metrics of each element's spectrum as <element>__<metric>, and a linkage label.

    `spectra` has (record_id, element, metrics…), one row a record and element.
    """
    each = spectra.groupBy("record_id").pivot("element", elements).agg(*[F.first(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("present"))
    renamed = each.select("record_id", *[F.col(f"`{e}_{m}`").alias(f"{e}__{m}") for e in elements for m in metrics], *[F.coalesce(f"`{e}_present`", F.lit(0)).alias(f"__{e}") for e in elements])
    joined = records.join(renamed, "record_id", "left")
    present = F.concat_ws("+", *[F.when(F.col(f"__{e}") > 0, e) for e in elements])
    return joined.withColumn("linkage", F.when(present == "", "none").otherwise(present)).drop(*[f"__{e}" for e in elements])


def unambiguous(bridge: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one distinct value, and it. No set is gathered: the least and the greatest agree."""
    return bridge.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__high")).where(F.col(value) == F.col("__high")).drop("__high")


def validation_group(doi: str, dataset: str, reference: str) -> Column:
    return F.coalesce(F.nullif(doi, F.lit("")), F.concat(dataset, F.lit(":ref:"), F.col(reference).cast("string")))


def field_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, p10, median, p90) of each numeric field, exact, linearly interpolated."""
    each = quantiles(value_counts(df, [], columns), ["field"], [0.1, 0.5, 0.9])
    return each.select("field", "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def histogram(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """(group, bin, n): counts in even bins between each group's extremes; the last bin is closed."""
    ends = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return with_values(df.select(group, value), ends, [group]).where(F.col(value).isNotNull()).groupBy(group, F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, q1, median, q3, low, high): quartiles and the whiskers, the furthest values within 1.5 times their distance."""
    cuts = quantiles(value_counts(df, [group], [value]).drop("field"), [group], [0.25, 0.5, 0.75]).drop("n")
    near = with_values(df.select(group, value), cuts, [group]).where(F.col(value).between(F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])))
    return near.groupBy(group, "q").agg(F.min(value).alias("low"), F.max(value).alias("high")).select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high")
