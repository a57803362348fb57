"""Queries over record tables: sheets, profiles, numbering and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import roles
from spectraloom.operators import records
from spectraloom.plans.registry import pick, pick_sql, query
from spectraloom.session import table

# --- sheets: a supplier's five lines of cells, some blank, under header rows of several kinds
LINES = ["DOI,sample,sample,,flux", "", "1,2,x{},,9", "{},,b,,7.5", ",,,,"]
SECTIONS = ["prep,,perf,,", "base,,R,flux,", "mw, t  1 ,NaCl,NaCl,{}"]


def sheet_texts(spark, sf_dir):
    """Every supplier is a sheet of one source; every third has a header of three levels."""
    lines = lambda ls: F.concat_ws("\n", *[F.replace(F.lit(x), F.lit("{}"), F.col("s_suppkey").cast("string")) for x in ls])
    content = F.when(F.col("s_suppkey") % 3 == 0, lines(SECTIONS + LINES[2:4])).otherwise(lines(LINES))
    return table(spark, sf_dir, "supplier").select(F.lit("book").alias("source"), F.col("s_suppkey").cast("string").alias("sheet"), content.alias("content"))


def _lines_sql(ls):
    return "concat_ws(chr(10), " + ", ".join(f"replace('{x}', '{{}}', CAST(s_suppkey AS VARCHAR))" for x in ls) + ")"


CELLS_SQL = f"""
texts AS (SELECT 'book' AS source, CAST(s_suppkey AS VARCHAR) AS sheet, CASE WHEN s_suppkey % 3 = 0 THEN {_lines_sql(SECTIONS + LINES[2:4])} ELSE {_lines_sql(LINES)} END AS content FROM supplier),
lines AS (SELECT source, sheet, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS row_no FROM texts),
cells AS (SELECT source, sheet, CAST(row_no AS INT) AS row_no, CAST(generate_subscripts(string_split(line, ','), 1) - 1 AS INT) AS col_no, unnest(string_split(line, ',')) AS value FROM lines WHERE trim(line) <> '')"""
NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TERMS = "|".join(records.HEADER_TERMS)


def cells(spark, sf_dir):
    return records.cells_of_text(sheet_texts(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT * FROM cells")
def s01_cells_keep_their_rows(spark, sf_dir):
    return cells(spark, sf_dir)


@query(rf"""
WITH {CELLS_SQL}, n AS (SELECT *, row_no - min(row_no) OVER (PARTITION BY sheet) AS place, trim(value) AS v FROM cells),
r AS (SELECT source, sheet, row_no, round(count(*) FILTER (NOT regexp_matches(v, '{NUM}')) + 3 * count(*) FILTER (regexp_matches(lower(v), '{TERMS}')) + count(DISTINCT v) / count(*) - 0.1 * any_value(place), 9) AS score
  FROM n WHERE place < 8 AND v <> '' GROUP BY source, sheet, row_no)
SELECT source, sheet, CAST(arg_max(row_no, score * 1000 - row_no * 1e-6) AS INT) AS header_row FROM r GROUP BY source, sheet""")
def c01_header_rows(spark, sf_dir):
    return records.header_rows(cells(spark, sf_dir))


@query(rf"""
WITH {CELLS_SQL}, n AS (SELECT *, row_no - min(row_no) OVER w AS place, max(col_no) OVER w - min(col_no) OVER w + 1 AS width, max(row_no) OVER w - min(row_no) OVER w + 1 AS height, trim(value) AS v FROM cells WINDOW w AS (PARTITION BY sheet)),
a AS (SELECT source, sheet, max(width) AS width, max(height) AS height, count(*) FILTER (place < 3 AND v <> '') AS f, count(*) FILTER (place < 3 AND v <> '' AND regexp_matches(v, '{NUM}')) AS m, count(*) FILTER (place < 2 AND v <> '') AS top FROM n GROUP BY source, sheet)
SELECT source, sheet, height >= 4 AND f >= 1.5 * width AND m < 0.1 * greatest(f, 1) AND top < 2 * width AS three_level FROM a""")
def c02_three_level_headers(spark, sf_dir):
    return records.three_level(cells(spark, sf_dir))


NAMES_SQL = f"""{CELLS_SQL}, n AS (SELECT *, row_no - min(row_no) OVER (PARTITION BY sheet) AS place, nullif(trim(value), '') AS v FROM cells),
p AS (SELECT source, sheet, col_no, max(v) FILTER (place = 0) AS l0, max(v) FILTER (place = 1) AS l1, max(v) FILTER (place = 2) AS l2 FROM n WHERE place < 3 GROUP BY source, sheet, col_no),
q AS (SELECT *, last_value(l0 IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS a FROM p),
r AS (SELECT *, CASE WHEN a IS NOT DISTINCT FROM lag(a) OVER (PARTITION BY sheet ORDER BY col_no) AND row_number() OVER (PARTITION BY sheet ORDER BY col_no) > 1 THEN 0 ELSE 1 END AS new FROM q),
t AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS section FROM r),
u AS (SELECT *, last_value(l1 IGNORE NULLS) OVER (PARTITION BY sheet, section ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS b FROM t),
named AS (SELECT source, sheet, col_no, concat_ws(' | ', a, CASE WHEN b IS DISTINCT FROM a THEN b END, CASE WHEN l2 IS DISTINCT FROM a AND l2 IS DISTINCT FROM b THEN l2 END) AS name FROM u)"""


@query(f"WITH {NAMES_SQL} SELECT * FROM named")
def c03_w10_hierarchical_headers(spark, sf_dir):
    return records.hierarchical_names(cells(spark, sf_dir))


@query(rf"""
WITH {NAMES_SQL}, plain AS (SELECT source, sheet, col_no, row_number() OVER (PARTITION BY sheet ORDER BY col_no) - 1 AS place, regexp_replace(trim(name), '\s+', ' ', 'g') AS name FROM (SELECT * REPLACE (split_part(name, ' | ', 1) AS name) FROM named)),
f AS (SELECT source, sheet, col_no, CASE WHEN name = '' THEN 'unnamed_' || place ELSE name END AS name FROM plain),
g AS (SELECT *, row_number() OVER (PARTITION BY sheet, name ORDER BY col_no) AS k FROM f)
SELECT source, sheet, col_no, name || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS name FROM g""")
def c04_flat_names(spark, sf_dir):
    named = records.hierarchical_names(cells(spark, sf_dir))
    return records.flat_names(named.withColumn("name", F.split_part("name", F.lit(" | "), F.lit(1))))


@query(f"""
WITH {CELLS_SQL} SELECT * FROM cells c WHERE EXISTS (SELECT 1 FROM cells d WHERE d.sheet = c.sheet AND d.row_no = c.row_no AND trim(d.value) <> '')
  AND EXISTS (SELECT 1 FROM cells d WHERE d.sheet = c.sheet AND d.col_no = c.col_no AND trim(d.value) <> '')""")
def c05_without_blank_rows_and_columns(spark, sf_dir):
    return records.without_blank(cells(spark, sf_dir))


@query(f"""
WITH {NAMES_SQL} SELECT sheet, arg_max(name, col_no) AS name FROM (SELECT sheet, col_no, CASE WHEN col_no = 2 AND CAST(sheet AS INT) % 2 = 0 THEN name || ' | Ref' WHEN col_no = 4 AND CAST(sheet AS INT) % 5 = 0 THEN '参考文献' ELSE name END AS name FROM named)
WHERE lower(name) = 'ref' OR lower(name) LIKE '% | ref' OR contains(name, '参考文献') GROUP BY sheet""")
def c17_reference_columns(spark, sf_dir):
    sheet = F.col("sheet").cast("int")
    name = F.when((F.col("col_no") == 2) & (sheet % 2 == 0), F.concat("name", F.lit(" | Ref"))).when((F.col("col_no") == 4) & (sheet % 5 == 0), "参考文献").otherwise(F.col("name"))
    return records.reference_column(records.hierarchical_names(cells(spark, sf_dir)).withColumn("name", name)).select("sheet", "name")


# --- profiles
PROFILED = ["p_name", "p_brand", "p_size", "p_retailprice", "note"]
NOTES = [None, "-", "3.5", "n/a", "7", "Not reported", "1d", "", "12", "x"]
WIDE_SQL = f"(SELECT p_type, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size, CAST(CAST(p_retailprice * 100 AS BIGINT) AS VARCHAR) AS p_retailprice, {pick_sql(NOTES, 'p_partkey')} AS note FROM part)"


def wide(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_name", "p_brand", "p_size", (F.col("p_retailprice") * 100).cast("bigint").alias("p_retailprice"), pick(NOTES, F.col("p_partkey")).alias("note"))


def _cells_sql(value):
    each = " UNION ALL ".join(f"SELECT p_type, '{c}' AS \"column\", {c} AS value FROM {WIDE_SQL}" for c in PROFILED)
    return f'(SELECT p_type, "column", {value} AS value FROM ({each}))'


@query(rf"""
SELECT p_type, "column", count(*) AS rows, count(value) AS non_null, round(avg(CASE WHEN regexp_matches(value, '{NUM}') AND isfinite(TRY_CAST(trim(value) AS DOUBLE)) THEN 1 ELSE 0 END), 9) AS numeric_fraction, count(DISTINCT value) AS "unique"
FROM {_cells_sql('value')} GROUP BY p_type, "column" """)
def c11_column_profiles(spark, sf_dir):
    return records.column_profile(wide(spark, sf_dir), PROFILED, ["p_type"]).withColumn("numeric_fraction", F.round("numeric_fraction", 9))


CLEAN = "CASE WHEN lower(trim(value)) NOT IN ('', '-', '—', '/', 'nan', 'none', 'n/a', 'na', 'not reported') THEN value END"
CATALOG_SQL = rf"""(SELECT *, CASE WHEN numeric_count / greatest(non_null, 1) >= 0.8 THEN 'numeric' ELSE 'categorical' END AS type, non_null / rows AS coverage FROM (
  SELECT "column", count(*) AS rows, count(value) AS non_null, count(CASE WHEN regexp_matches(value, '{NUM}') THEN 1 END) AS numeric_count FROM {_cells_sql(CLEAN)} GROUP BY "column"))"""


@query(f'SELECT "column", rows, non_null, numeric_count, round(coverage, 9) AS coverage, type FROM {CATALOG_SQL}')
def c12_field_catalog(spark, sf_dir):
    return records.wide_profile(wide(spark, sf_dir), PROFILED).withColumn("coverage", F.round("coverage", 9))


@query(f"""
SELECT "column", round(numeric_count / rows, 9) AS numeric_fraction, CASE WHEN "column" IN {roles.QUALITY} THEN 'quality' ELSE 'shape' END AS kind FROM {CATALOG_SQL} WHERE numeric_count / rows >= 0.1""")
def c13_c14_numeric_columns(spark, sf_dir):
    share = F.col("numeric_count") / F.col("rows")
    made = records.wide_profile(wide(spark, sf_dir), PROFILED).where(share >= 0.1)
    return made.select("column", F.round(share, 9).alias("numeric_fraction"), F.when(roles.is_quality("column"), "quality").otherwise("shape").alias("kind"))


@query(f"""SELECT "column", CAST(row_number() OVER (ORDER BY coverage DESC, "column") AS INT) AS place FROM {CATALOG_SQL} WHERE numeric_count >= 3""")
def c16_candidate_columns(spark, sf_dir):
    """The catalog has one row a column: ranking it in one task is bounded by the table's width."""
    from pyspark.sql import Window

    return records.wide_profile(wide(spark, sf_dir), PROFILED).where("numeric_count >= 3").select("column", F.row_number().over(Window.orderBy(F.desc("coverage"), "column")).alias("place"))


# --- the record table
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
NUMBERED_SQL = f"(SELECT *, l_returnflag || '-' || l_suppkey || '-' || row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY {', '.join(ORDER)}) AS record_id FROM lineitem)"


def numbered_records(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("sample", records.sample_number(["l_returnflag", "l_suppkey"], ORDER))
    return lines.withColumn("record_id", records.record_id("l_returnflag", "l_suppkey", "sample"))


@query(f"SELECT record_id, l_orderkey, l_linenumber, l_partkey FROM {NUMBERED_SQL}")
def w01_numbered_records(spark, sf_dir):
    return numbered_records(spark, sf_dir).select("record_id", "l_orderkey", "l_linenumber", "l_partkey")


SPECTRA_SQL = "(SELECT 'R-' || (vec_id // 2) || '-1' AS record_id, CASE WHEN vec_id % 2 = 0 THEN 'N' ELSE 'O' END AS element, round(list_sum(embedding)::DOUBLE, 4) AS total, label FROM embeddings WHERE vec_id % 9 <> 0)"


@query(f"""
SELECT r.record_id, r.l_partkey, n.total AS N__total, n.label AS N__label, o.total AS O__total, o.label AS O__label,
  CASE WHEN n.record_id IS NOT NULL AND o.record_id IS NOT NULL THEN 'N+O' WHEN n.record_id IS NOT NULL THEN 'N' WHEN o.record_id IS NOT NULL THEN 'O' ELSE 'none' END AS linkage
FROM {NUMBERED_SQL} r LEFT JOIN (SELECT * FROM {SPECTRA_SQL} WHERE element = 'N') n ON n.record_id = r.record_id LEFT JOIN (SELECT * FROM {SPECTRA_SQL} WHERE element = 'O') o ON o.record_id = r.record_id""")
def j01_linked_spectra(spark, sf_dir):
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    made = table(spark, sf_dir, "embeddings").where("vec_id % 9 <> 0").select(
        F.concat(F.lit("R-"), F.floor(F.col("vec_id") / 2), F.lit("-1")).alias("record_id"), F.when(F.col("vec_id") % 2 == 0, "N").otherwise("O").alias("element"), total.alias("total"), "label"
    )
    return records.linked(numbered_records(spark, sf_dir).select("record_id", "l_partkey"), made, ["N", "O"], ["total", "label"])


@query("""
WITH f AS (SELECT source, n_chars % 40 AS slot, sha256(text) AS sha256, doc_id AS path FROM documents),
k AS (SELECT source, slot FROM f GROUP BY ALL HAVING count(DISTINCT sha256) = 1)
SELECT f.source, f.slot, f.sha256, f.path FROM f JOIN k USING (source, slot) QUALIFY row_number() OVER (PARTITION BY f.source, f.slot ORDER BY f.path) = 1""")
def j02_conflicting_copies_left_out(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 40).alias("slot"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("path"))
    return records.conflict_free(files, ["source", "slot"])


BRIDGE_SQL = "(SELECT source AS dataset, doc_id % 37 AS reference, CASE WHEN doc_id % 5 <> 0 THEN '10.1234/' || lang END AS doi FROM documents)"


def bridge(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), (F.col("doc_id") % 37).alias("reference"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("10.1234/"), "lang")).alias("doi"))


@query(f"SELECT dataset, reference, min(doi) AS doi FROM {BRIDGE_SQL} WHERE doi IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doi) = 1")
def j03_unambiguous_dois(spark, sf_dir):
    return records.unambiguous(bridge(spark, sf_dir), ["dataset", "reference"], "doi")


@query(f"""
WITH k AS (SELECT dataset, reference, min(doi) AS doi FROM {BRIDGE_SQL} WHERE doi IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doi) = 1)
SELECT coalesce(nullif(k.doi, ''), source || ':ref:' || (doc_id % 37)) AS validation_group, count(*) AS n FROM documents LEFT JOIN k ON dataset = source AND reference = doc_id % 37 GROUP BY ALL""")
def j04_validation_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), (F.col("doc_id") % 37).alias("reference"))
    joined = docs.join(records.unambiguous(bridge(spark, sf_dir), ["dataset", "reference"], "doi"), ["dataset", "reference"], "left")
    return joined.groupBy(records.validation_group("doi", "dataset", "reference").alias("validation_group")).agg(F.count("*").alias("n"))


@query("""
SELECT 'orders' AS sheet, o_orderkey AS id, NULL AS p_brand, o_totalprice AS price, o_orderpriority FROM orders UNION ALL SELECT 'part', p_partkey, p_brand, p_retailprice, NULL FROM part""")
def u01_union_of_sheets(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select(F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    second = table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), F.col("p_partkey").alias("id"), "p_brand", F.col("p_retailprice").alias("price"))
    return first.unionByName(second, allowMissingColumns=True)


@query(f"""
WITH s AS (SELECT record_id, count(DISTINCT element) AS n FROM {SPECTRA_SQL} GROUP BY ALL), g AS ({BRIDGE_SQL[1:-1]})
SELECT (SELECT count(*) FROM {SPECTRA_SQL}) AS usable_spectra, (SELECT count(*) FROM s WHERE n >= 2) AS both_elements, (SELECT count(*) FROM g WHERE doi IS NOT NULL) AS resolved_rows, (SELECT count(*) FROM g WHERE doi IS NULL) AS unresolved_rows""")
def a04_linkage_profile(spark, sf_dir):
    made = table(spark, sf_dir, "embeddings").where("vec_id % 9 <> 0").select(F.floor(F.col("vec_id") / 2).alias("record"), (F.col("vec_id") % 2).alias("element"))
    each = made.groupBy("record").agg(F.count("*").alias("n"), F.count_distinct("element").alias("k")).agg(F.sum("n").alias("usable_spectra"), F.count_if(F.col("k") >= 2).alias("both_elements"))
    dois = bridge(spark, sf_dir).agg(F.count("doi").alias("resolved_rows"), F.count_if(F.col("doi").isNull()).alias("unresolved_rows"))
    return each.crossJoin(dois)  # one row each


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
SELECT field, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90
FROM (UNPIVOT (SELECT {', '.join(NUMERIC)} FROM lineitem) ON {', '.join(NUMERIC)} INTO NAME field VALUE value) GROUP BY field""")
def a05_field_summaries(spark, sf_dir):
    made = records.field_summary(table(spark, sf_dir, "lineitem"), NUMERIC)
    return made.select("field", "n", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")])


@query("""
WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 12), 11) AS INT) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL""")
def a06_histograms(spark, sf_dir):
    return records.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 12)


@query("""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN q USING (l_returnflag)
WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def a06_quartiles_and_whiskers(spark, sf_dir):
    made = records.box(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return made.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query(f"""
SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM {BRIDGE_SQL} WHERE doi IS NULL) AS unresolved_keys""")
def a19_key_audit(spark, sf_dir):
    duplicates = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    return duplicates.crossJoin(bridge(spark, sf_dir).agg(F.count_if(F.col("doi").isNull()).alias("unresolved_keys")))  # one row each


@query(f"""
SELECT record_id, l_returnflag AS dataset, l_suppkey AS reference FROM {NUMBERED_SQL} LEFT JOIN (SELECT DISTINCT record_id AS linked FROM {SPECTRA_SQL}) ON linked = record_id
WHERE l_returnflag IN ('A', 'R') AND linked IS NOT NULL AND regexp_matches(record_id, '(?i)^r-.?1')""")
def p01_record_explorer(spark, sf_dir):
    made = table(spark, sf_dir, "embeddings").where("vec_id % 9 <> 0").select(F.concat(F.lit("R-"), F.floor(F.col("vec_id") / 2), F.lit("-1")).alias("record_id")).distinct()
    rows = numbered_records(spark, sf_dir).where(F.col("l_returnflag").isin("A", "R") & F.col("record_id").rlike("(?i)^r-.?1"))
    return rows.join(made, "record_id", "left_semi").select("record_id", F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("reference"))


@query("""
SELECT name, n FROM (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents)""")
def a03_table_counts(spark, sf_dir):
    from functools import reduce

    names = ("orders", "part", "lineitem", "documents")
    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names])


@query("""
WITH a AS (SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY ALL),
u AS (UNPIVOT a ON rows, customers, large INTO NAME metric VALUE value)
SELECT metric, o.value AS previous, n.value AS new, n.value - o.value AS difference FROM (SELECT * FROM u WHERE o_orderstatus = 'F') o FULL JOIN (SELECT * FROM u WHERE o_orderstatus = 'O') n USING (metric)""")
def a24_profile_comparison(spark, sf_dir):
    made = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    long = made.unpivot(["o_orderstatus"], ["rows", "customers", "large"], "metric", "value")
    side = lambda status, name: long.where(F.col("o_orderstatus") == status).select("metric", F.col("value").alias(name))
    return side("F", "previous").join(side("O", "new"), "metric", "full").withColumn("difference", F.col("new") - F.col("previous"))
