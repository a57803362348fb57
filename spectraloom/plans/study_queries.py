"""Queries over derived columns, cohorts, folds, models and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectraloom.functions import roles
from spectraloom.operators import descriptors, study, validation
from spectraloom.operators.descriptors import Spec
from spectraloom.plans.registry import pick, pick_sql, query
from spectraloom.plans.scalar_queries import HEADERS
from spectraloom.session import table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
# stand-ins with zeros, negatives and gaps
LINES_SQL = """(SELECT *, l_returnflag AS dataset, round(l_tax - 0.03, 4) AS a, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_discount END AS b, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS c FROM lineitem)"""


def lines(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").withColumns(
        {"dataset": c("l_returnflag"), "a": F.round(c("l_tax") - 0.03, 4), "b": F.when(c("l_linenumber") % 3 == 0, 0.0).otherwise(c("l_discount")), "c": F.when(c("l_partkey") % 7 != 0, c("l_quantity"))}
    )


SPECS = [
    Spec("d_ratio", "ratio", ("a", "b")), Spec("d_log", "log_ratio", ("a", "b")), Spec("d_diff", "difference", ("a", "c")), Spec("d_norm", "normalized_difference", ("a", "b")),
    Spec("d_prod", "product", ("a", "b", "c")), Spec("d_sum", "weighted_sum", ("a", "b", "c"), {"w1": 2.0, "w3": -0.5}), Spec("d_gated", "difference", ("c", "a"), scope=("A", "R"), bounds={"c": (10.0, 40.0), "a": (None, 0.02)}),
]
VALUES_SQL = {
    "d_ratio": "CASE WHEN abs(b) > 1e-12 THEN a / b END", "d_log": "CASE WHEN a > 1e-12 AND b > 1e-12 THEN ln(a / b) END", "d_diff": "a - c", "d_norm": "CASE WHEN abs(a) + abs(b) > 1e-12 THEN (a - b) / (abs(a) + abs(b)) END",
    "d_prod": "a * b * c", "d_sum": "2 * a + b - 0.5 * c", "d_gated": "CASE WHEN dataset IN ('A', 'R') AND c >= 10 AND c <= 40 AND a <= 0.02 THEN c - a END",
}


@query(f"SELECT {', '.join(KEYS)}, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in VALUES_SQL.items() if k != 'd_gated')} FROM {LINES_SQL}")
def d01_to_d06_operations(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*KEYS, *[(F.round(descriptors.computed(df, s), 6) + 0.0).alias(s.symbol) for s in SPECS[:-1]])


@query(f"SELECT {', '.join(KEYS)}, dataset, round({VALUES_SQL['d_gated']}, 6) AS d_gated FROM {LINES_SQL}")
def p07_applicability_gate(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*KEYS, "dataset", F.round(descriptors.computed(df, SPECS[-1]), 6).alias("d_gated"))


BATCH = [*SPECS, Spec("habd x", "ratio", ("a", "b")), Spec("lone", "ratio", ("a",)), Spec("absent", "product", ("a", "zz")), Spec("c", "difference", ("a", "b")), Spec("rare", "difference", ("a", "b"), bounds={"c": (0.0, 1.0), "a": (0.9, None)}), Spec("narrow", "difference", ("a", "c"), bounds={"a": (0.9, None)})]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS symbol, count(CASE WHEN isfinite({v}) THEN 1 END) AS finite, count(*) AS rows FROM {LINES_SQL}" for k, v in {**VALUES_SQL, "narrow": "CASE WHEN a >= 0.9 THEN a - c END"}.items())


@query(f"""
SELECT symbol, finite >= 10 AS accepted, CASE WHEN finite < 10 THEN 'too few finite values' END AS reason, finite, round(finite / rows, 6) AS coverage FROM ({COUNTS_SQL})
UNION ALL SELECT * FROM (VALUES ('habd x', false, 'symbol', NULL, NULL), ('lone', false, 'arity', NULL, NULL), ('absent', false, 'input zz is missing', NULL, NULL), ('c', false, 'symbol; symbol is taken', NULL, NULL), ('rare', false, 'bounds', NULL, NULL))""")
def d07_d08_a21_materialised_batch(spark, sf_dir):
    _, manifest = descriptors.materialised(lines(spark, sf_dir), BATCH)
    return manifest.withColumn("coverage", F.round("coverage", 6))


@query(f"""
WITH names AS (SELECT DISTINCT p_brand AS name, {pick_sql(HEADERS, "CAST(substr(p_brand, 7) AS INT)")} AS header FROM part),
columns AS (SELECT name, {roles.rules_sql("header", roles.SCIENTIFIC, "unassigned")} AS role FROM names WHERE CAST(substr(name, 7) AS INT) % 6 <> 0),
specs AS (SELECT p_partkey AS spec_id, p_name AS symbol, [p_brand, 'Brand#' || (p_size % 25 + 1)] AS inputs, [p_partkey, p_partkey + p_size] AS evidence_ids FROM part),
r AS (
  SELECT spec_id, 'missing:' || n AS reason FROM (SELECT spec_id, unnest(inputs) AS n FROM specs) WHERE n NOT IN (SELECT name FROM columns)
  UNION SELECT spec_id, 'forbidden:' || n FROM (SELECT spec_id, unnest(inputs) AS n FROM specs) JOIN columns ON name = n WHERE role IN {descriptors.FORBIDDEN}
  UNION SELECT spec_id, 'evidence:' || e FROM (SELECT spec_id, unnest(evidence_ids) AS e FROM specs) WHERE e NOT IN (SELECT doc_id FROM documents)
  UNION SELECT spec_id, 'reserved:' || symbol FROM specs WHERE symbol IN (SELECT p_name FROM part WHERE p_size = 50))
SELECT spec_id, list_sort(list(reason)) AS reasons FROM r GROUP BY spec_id""")
def j11_u02_spec_references(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    number = F.substring("name", 7, 9).cast("int")
    columns = part.select(F.col("p_brand").alias("name")).distinct().where(number % 6 != 0).select("name", roles.scientific_role(pick(HEADERS, number)).alias("role"))
    specs = part.select(
        F.col("p_partkey").alias("spec_id"), F.col("p_name").alias("symbol"), F.array("p_brand", F.concat(F.lit("Brand#"), F.col("p_size") % 25 + 1)).alias("inputs"), F.array("p_partkey", F.col("p_partkey") + F.col("p_size")).alias("evidence_ids")
    )
    evidence = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"))
    return descriptors.references(specs, columns, evidence, part.where("p_size = 50").select(F.col("p_name").alias("symbol")).distinct())


# --- cohorts
COHORT_SQL = """(SELECT *, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS y, CASE l_suppkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' ELSE 'g' || l_suppkey END AS g,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '10.1/' || l_suppkey // 2 END AS doi, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS c, l_returnflag AS dataset FROM lineitem)"""


def cohort(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "y": F.when(c("l_linenumber") != 4, c("l_extendedprice")), "g": F.when(c("l_suppkey") % 11 == 0, " ").when(c("l_suppkey") % 11 == 1, "NaN").otherwise(F.concat(F.lit("g"), "l_suppkey")),
            "doi": F.when(c("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("10.1/"), F.floor(c("l_suppkey") / 2))), "c": F.when(c("l_partkey") % 7 != 0, c("l_quantity")), "dataset": c("l_returnflag"),
        }
    )


FLAGS_SQL = f"(SELECT *, y IS NOT NULL AS t, trim(lower(g)) NOT IN ('', 'nan') AS v, dataset IN ('A', 'R') AS s, doi <> '' AS r, c IS NOT NULL AS m FROM {COHORT_SQL})"


def flags(spark, sf_dir):
    validation.check_arguments(cohort(spark, sf_dir), "y", "g", ["l_quantity"], ["c"])
    return validation.flagged(cohort(spark, sf_dir), "y", "g", ["c"], scope=["A", "R"], doi="doi")


@query(f"SELECT {', '.join(KEYS)}, g FROM {FLAGS_SQL} WHERE t AND v AND s AND r AND m")
def m01_cohort_rows(spark, sf_dir):
    return flags(spark, sf_dir).where("eligible").select(*KEYS, "g")


@query(f"""
SELECT count(*) AS input_rows, count(*) FILTER (NOT (t AND v)) AS bad_target_or_group, count(*) FILTER (t AND v AND NOT s) AS outside_scope, count(*) FILTER (t AND v AND s AND NOT r) AS unresolved,
  count(*) FILTER (t AND v AND s AND r AND NOT m) AS missing_candidates, count(*) FILTER (t AND v AND s AND r AND m) AS rows_scored FROM {FLAGS_SQL}""")
def a07_attrition(spark, sf_dir):
    return validation.attrition(flags(spark, sf_dir))


@query(f"""
SELECT dataset, count(*) AS rows, count(*) FILTER (NOT t) AS missing_target, count(*) FILTER (NOT v) AS missing_group, count(*) FILTER (t AND v AND NOT m) AS missing_intermediates, count(DISTINCT g) FILTER (t AND v AND m) AS groups FROM {FLAGS_SQL} GROUP BY dataset""")
def a08_m02_relationship_cohorts(spark, sf_dir):
    c = F.col
    known = c("has_target") & c("has_group")
    return flags(spark, sf_dir).groupBy("dataset").agg(
        F.count("*").alias("rows"), F.count_if(~c("has_target")).alias("missing_target"), F.count_if(~c("has_group")).alias("missing_group"), F.count_if(known & ~c("measured")).alias("missing_intermediates"),
        F.count_distinct(F.when(known & c("measured"), c("g"))).alias("groups"),
    )


@query(f"SELECT doi, count(DISTINCT g) AS groups FROM {FLAGS_SQL} WHERE doi <> '' GROUP BY doi HAVING count(DISTINCT g) > 1")
def a20_split_dois(spark, sf_dir):
    return validation.split_groups(cohort(spark, sf_dir), "doi", "g")


# a feature of dataset A that has values in one fold alone
PATCHY_SQL = f"(SELECT *, CAST(l_suppkey % 5 AS INT) AS f, CASE WHEN dataset <> 'A' OR l_suppkey % 5 = 1 THEN c END AS z FROM {FLAGS_SQL})"


@query(f"""
SELECT dataset, rows, groups, CASE WHEN groups < 3 THEN 'too few groups' WHEN rows < 12 THEN 'too few rows' WHEN none THEN 'no training values: z' END AS reason FROM (
  SELECT dataset, count(*) AS rows, count(DISTINCT g) AS groups FROM {PATCHY_SQL} GROUP BY dataset)
JOIN (SELECT dataset, sum(n) = max(n) AS none FROM (SELECT dataset, f, count(z) AS n FROM {PATCHY_SQL} GROUP BY ALL) GROUP BY dataset) USING (dataset)""")
def m12_guards(spark, sf_dir):
    fold = (F.col("l_suppkey") % 5).cast("int")
    rows = cohort(spark, sf_dir).withColumns({"f": fold, "z": F.when((F.col("dataset") != "A") | (fold == 1), F.col("c"))})
    return validation.guards(rows, "g", ("dataset",), "f", ("c", "z"))


@query(f"""
SELECT {', '.join(KEYS)}, coalesce(CASE WHEN trim(doi) <> '' THEN doi END, CASE WHEN v THEN g END) AS study_group FROM {FLAGS_SQL} WHERE t AND s AND m AND (trim(doi) <> '' OR v)""")
def m02_relationship_cohort(spark, sf_dir):
    """Checked for its task, with the supplier as the group where no DOI is known."""
    roles_of = {"c": "xps", "l_tax": "test_condition", "y": "performance"}
    return study.cohort(cohort(spark, sf_dir), "xps_to_performance", "y", {"xps": ["c"]}, ["l_tax"], roles_of, ["A", "R"], fallback="g").select(*KEYS, "study_group")


# --- folds
K = 5
FOLDS_SQL = f"""(SELECT l_suppkey, rows, CAST(CASE WHEN (n // {K}) % 2 = 0 THEN n % {K} ELSE {K - 1} - n % {K} END AS INT) AS fold
  FROM (SELECT l_suppkey, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) - 1 AS n FROM lineitem GROUP BY l_suppkey))"""


def folds(spark, sf_dir):
    return validation.rank_folds(table(spark, sf_dir, "lineitem"), "l_suppkey", K)


@query(f"SELECT * FROM {FOLDS_SQL}")
def m04_group_folds(spark, sf_dir):
    return folds(spark, sf_dir)


def m04_greedy_folds(spark, sf_dir):
    """Sequential over the group counts, so it has no SQL: tests hold it against its rule."""
    return validation.greedy_folds(table(spark, sf_dir, "lineitem"), "l_suppkey", K)


query()(m04_greedy_folds)

NESTED_SQL = f"""(SELECT o.fold AS "outer", l_suppkey, CAST((row_number() OVER (PARTITION BY o.fold, f.fold ORDER BY rows DESC, l_suppkey) - 1 + f.fold) % 3 AS INT) AS "inner" FROM {FOLDS_SQL} f JOIN (SELECT DISTINCT fold FROM {FOLDS_SQL}) o ON o.fold <> f.fold)"""


@query(f"SELECT * FROM {NESTED_SQL}")
def m05_nested_folds(spark, sf_dir):
    return validation.nested_folds(folds(spark, sf_dir), "l_suppkey", 3)


@query(f"""
SELECT fold AS "outer", count(*) AS test_groups, (SELECT count(*) FROM {NESTED_SQL} n WHERE n."outer" = f.fold) AS train_groups, CAST(0 AS BIGINT) AS shared FROM {FOLDS_SQL} f GROUP BY fold""")
def u03_no_group_in_train_and_test(spark, sf_dir):
    assigned = folds(spark, sf_dir)
    shared = validation.overlaps(assigned, "l_suppkey").groupBy("outer").agg(F.count("*").alias("shared"))
    train = validation.nested_folds(assigned, "l_suppkey", 3).groupBy("outer").agg(F.count("*").alias("train_groups"))
    test = assigned.groupBy(F.col("fold").alias("outer")).agg(F.count("*").alias("test_groups"))
    return test.join(train, "outer").join(shared, "outer", "left").select("outer", "test_groups", "train_groups", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"))


ROWS_SQL = f"(SELECT l.*, f.fold FROM lineitem l JOIN {FOLDS_SQL} f USING (l_suppkey))"


def folded(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(folds(spark, sf_dir).select("l_suppkey", "fold"), "l_suppkey")


GAPS_SQL = f"(SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS d FROM {ROWS_SQL})"


def gaps(spark, sf_dir):
    return folded(spark, sf_dir).withColumns({"q": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")), "d": F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount"))})


@query(f"""
SELECT o.fold, count(*) AS n, round(avg(q), 6) AS mean_q, round(stddev_pop(q), 4) AS sd_q, round(avg(d), 6) AS mean_d, round(stddev_pop(d), 4) AS sd_d, round(median(q), 6) AS median_q, round(median(d), 6) AS median_d
FROM {GAPS_SQL} r JOIN (SELECT DISTINCT fold FROM {FOLDS_SQL}) o ON r.fold <> o.fold GROUP BY o.fold""")
def m06_train_only_statistics(spark, sf_dir):
    df = gaps(spark, sf_dir)
    both = validation.train_means(df, "fold", ["q", "d"]).join(validation.train_medians(df, "fold", ["q", "d"], K), "fold")
    return both.select("fold", "n", *[F.round(c, 4 if c[:2] == "sd" else 6).alias(c) for c in ("mean_q", "sd_q", "mean_d", "sd_d", "median_q", "median_d")])


@query(f"""
WITH o AS (SELECT DISTINCT fold AS "outer" FROM {FOLDS_SQL}), r AS (SELECT * FROM {GAPS_SQL}),
m AS (SELECT "outer", median(q) AS mq FROM r JOIN o ON fold <> "outer" GROUP BY "outer"),
f AS (SELECT r.*, o."outer", fold <> o."outer" AS is_train, coalesce(q, mq) AS fq, CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS miss_q FROM r, o JOIN m ON m."outer" = o."outer"),
s AS (SELECT "outer", avg(fq) AS mu, stddev_pop(fq) AS sd FROM f WHERE is_train GROUP BY "outer")
SELECT f."outer", is_train, count(*) AS n, round(sum(miss_q), 6) AS miss_q, round(sum((fq - mu) / sd), 3) + 0.0 AS z_q, count(*) FILTER (l_returnflag = 'A') AS is_a FROM f JOIN s ON s."outer" = f."outer" GROUP BY f."outer", is_train""")
def m06_prepared_rows(spark, sf_dir):
    made = validation.prepared(gaps(spark, sf_dir), "fold", ["q"], ["l_returnflag"], K)
    hot = F.when(F.col("l_returnflag") == "A", F.col("hot_l_returnflag").isNotNull().cast("int"))
    return made.groupBy("outer", "is_train").agg(F.count("*").alias("n"), F.round(F.sum("miss_q"), 6).alias("miss_q"), (F.round(F.sum("z_q"), 3) + 0.0).alias("z_q"), F.sum(hot).cast("bigint").alias("is_a"))


# --- predictions of two feature sets: the training mean, and a line on one feature
PREDICTED_SQL = f"""(
  WITH r AS (SELECT * FROM {ROWS_SQL}), o AS (SELECT DISTINCT fold FROM r),
  t AS (SELECT o.fold, avg(l_extendedprice) AS mean, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS base FROM r JOIN o ON r.fold <> o.fold GROUP BY o.fold)
  SELECT {', '.join(KEYS)}, l_suppkey, r.fold, 'baseline' AS feature_set, l_extendedprice AS observed, round(mean, 4) AS predicted FROM r JOIN t USING (fold)
  UNION ALL SELECT {', '.join(KEYS)}, l_suppkey, r.fold, 'augmented', l_extendedprice, round(base + slope * l_quantity, 4) FROM r JOIN t USING (fold))"""


def predictions(spark, sf_dir):
    """The study's own table: without a penalty, ridge is the least-squares line."""
    sets = validation.feature_sets({"xps": ["l_quantity"]}, [])
    named = {"baseline": sets["training_mean"], "augmented": sets["xps"]}
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", "l_quantity", "l_extendedprice")
    made = study.compared(rows, named, "l_suppkey", "l_extendedprice", K, grid=[("ridge", 0.0, 0.0)])[0]
    return made.select(*KEYS, "l_suppkey", "fold", "feature_set", "observed", F.round("predicted", 4).alias("predicted"))


@query(f"SELECT {', '.join(KEYS)}, fold, feature_set, round(observed, 2) AS observed, round(predicted, 2) AS predicted FROM {PREDICTED_SQL}")
def m03_m07_m11_out_of_fold_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select(*KEYS, "fold", "feature_set", F.round("observed", 2).alias("observed"), F.round("predicted", 2).alias("predicted"))


RANKS_SQL = "SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS {n} FROM {t}"


def _metrics_sql(by: str) -> str:
    ranked = RANKS_SQL.format(by=by, c="predicted", n="rb", t=f"({RANKS_SQL.format(by=by, c='observed', n='ra', t=PREDICTED_SQL)})")
    return f"""SELECT {by}, count(*) AS n, round(1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)), 4) AS r2, round(avg(abs(observed - predicted)), 4) AS mae, round(sqrt(avg((observed - predicted) ** 2)), 4) AS rmse,
  round(CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 4) AS spearman FROM ({ranked}) GROUP BY {by}"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query(_metrics_sql("feature_set"))
def a09_pooled_metrics(spark, sf_dir):
    return _rounded(validation.metrics(predictions(spark, sf_dir), ["feature_set"]), "r2", "mae", "rmse", "spearman")


@query(_metrics_sql("feature_set, fold"))
def a10_metrics_by_fold(spark, sf_dir):
    return _rounded(validation.metrics(predictions(spark, sf_dir), ["feature_set", "fold"]), "r2", "mae", "rmse", "spearman")


@query(f"""
SELECT feature_set, count(*) AS groups, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse FROM (
  SELECT feature_set, l_suppkey, avg(abs(observed - predicted)) AS mae, sqrt(avg((observed - predicted) ** 2)) AS rmse FROM {PREDICTED_SQL} GROUP BY ALL) GROUP BY feature_set""")
def a11_group_balanced_errors(spark, sf_dir):
    return _rounded(validation.group_balanced(predictions(spark, sf_dir), ["feature_set"], "l_suppkey"), "mae", "rmse")


BY_FOLD_SQL = f"(SELECT feature_set, fold, avg(abs(observed - predicted)) AS mae, 1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) AS r2 FROM {PREDICTED_SQL} GROUP BY ALL)"


def by_fold(spark, sf_dir):
    return validation.metrics(predictions(spark, sf_dir), ["feature_set", "fold"], rank=False)


@query(f"SELECT feature_set, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 3) AS std, round(median(mae), 4) AS median FROM {BY_FOLD_SQL} GROUP BY feature_set")
def a12_fold_summary(spark, sf_dir):
    made = by_fold(spark, sf_dir).groupBy("feature_set").agg(F.avg("mae").alias("mean"), F.round(F.stddev_samp("mae"), 3).alias("std"), F.percentile("mae", F.lit(0.5)).alias("median"))
    return _rounded(made, "mean", "median")


@query(f"SELECT a.fold, round(a.r2 - b.r2, 5) AS delta FROM {BY_FOLD_SQL} a JOIN {BY_FOLD_SQL} b ON a.fold = b.fold AND a.feature_set = 'augmented' AND b.feature_set = 'baseline'")
def a13_paired_deltas(spark, sf_dir):
    return validation.paired_delta(by_fold(spark, sf_dir), "r2", "baseline", "augmented").withColumn("delta", F.round("delta", 5))


DELTAS_SQL = "(SELECT l_linestatus || l_linenumber AS k, round(avg(l_discount) - 0.05, 5) AS delta FROM lineitem GROUP BY ALL)"


@query(f"""
WITH d AS (SELECT delta, row_number() OVER (ORDER BY delta, k) - 1 AS i FROM {DELTAS_SQL}), n AS (SELECT count(*) AS n, avg(delta) AS mean, sum(delta) AS total FROM d),
v AS (SELECT v, sum(CASE WHEN (v >> i) & 1 = 1 THEN delta ELSE -delta END) AS s FROM (SELECT unnest(range(CAST(2 ** (SELECT n FROM n) AS BIGINT))) AS v), d GROUP BY v)
SELECT any_value(n) AS n, round(any_value(mean), 6) AS mean_delta, round(count(*) FILTER (s >= total - 1e-12) / count(*), 6) AS p_value FROM v, n""")
def a14_sign_flip_p_value(spark, sf_dir):
    deltas = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.round(F.avg("l_discount") - 0.05, 5).alias("delta"))
    return validation.sign_flip(deltas).select(F.col("n").cast("bigint").alias("n"), F.round("mean_delta", 6).alias("mean_delta"), F.round("p_value", 6).alias("p_value"))


@query(f"SELECT DISTINCT l_returnflag, l_quantity, rk FROM ({RANKS_SQL.format(by='l_returnflag', c='l_quantity', n='rk', t='lineitem')})")
def w09_average_ranks(spark, sf_dir):
    return validation.average_ranks(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "rk")


RIDGE_SQL = f"""
WITH r AS (SELECT * FROM {GAPS_SQL}), n AS (SELECT * FROM {NESTED_SQL}),
c AS (SELECT r.*, o.fold AS "outer", f.j, CASE WHEN r.fold = o.fold THEN 'test' WHEN n."inner" = f.j THEN 'valid' ELSE 'train' END AS part
  FROM r CROSS JOIN (SELECT DISTINCT fold FROM r) o CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS j) f LEFT JOIN n ON n."outer" = o.fold AND n.l_suppkey = r.l_suppkey WHERE r.fold <> o.fold OR f.j = -1),
i AS (SELECT "outer", j, median(q) AS mid, avg(l_extendedprice) AS base FROM c WHERE part = 'train' GROUP BY ALL),
f AS (SELECT c.*, base, coalesce(q, mid) AS fq, CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS miss FROM c JOIN i USING ("outer", j)),
s AS (SELECT "outer", j, avg(fq) AS mu, stddev_pop(fq) AS sd FROM f WHERE part = 'train' GROUP BY ALL),
z AS (SELECT f.*, (fq - mu) / sd AS z, l_extendedprice - base AS y FROM f JOIN s USING ("outer", j)),
g AS (SELECT "outer", j, count(*) AS n, sum(z * z) AS zz, sum(z * miss) AS zm, sum(miss) AS m, sum(z) AS sz, sum(z * y) AS zy, sum(miss * y) AS my, sum(y) AS sy FROM z WHERE part = 'train' GROUP BY ALL),
h AS (SELECT "outer", j, a, n, zz - sz * sz / n + a AS p, zm - sz * m / n AS q, m - m * m / n + a AS r, zy - sz * sy / n AS u, my - m * sy / n AS v, sz, m, sy FROM g, (SELECT unnest([1.0, 10.0]) AS a)),
w AS (SELECT "outer", j, a, (r * u - q * v) / (p * r - q * q) AS wz, (p * v - q * u) / (p * r - q * q) AS wm, n, sz, m, sy FROM h),
k AS (SELECT *, (sy - wz * sz - wm * m) / n AS b FROM w),
e AS (SELECT "outer", a, avg(mae) AS mae FROM (SELECT "outer", j, a, avg(mae) AS mae FROM (SELECT z."outer", z.j, a, l_suppkey, avg(abs(y - b - wz * z - wm * miss)) AS mae FROM z JOIN k USING ("outer", j) WHERE part = 'valid' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
t AS (SELECT "outer", arg_min(a, struct_pack(m := mae, a := a)) AS a FROM e GROUP BY ALL)
SELECT {', '.join(KEYS)}, fold, a AS alpha, round(base + b + wz * z + wm * miss, 3) AS predicted FROM z JOIN t USING ("outer") JOIN k USING ("outer", j, a) WHERE part = 'test'"""


@query(RIDGE_SQL)
def m08_m10_ridge_study(spark, sf_dir):
    """Imputed, standardised and solved inside each fold; the penalty is chosen over inner folds, each group alike."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", "l_extendedprice", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"))
    made, _, chosen = study.compared(rows, {"xps": ["q"]}, "l_suppkey", "l_extendedprice", K, 3, [("ridge", a, 0.0) for a in validation.RIDGE])
    alpha = pick_value({outer: c[1] for outer, *c in chosen["xps"]}, F.col("fold"))
    return made.select(*KEYS, "fold", alpha.alias("alpha"), F.round("predicted", 3).alias("predicted"))


def pick_value(values: dict, key):
    """A value of a fold, from few."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def m08_m10_linear_study(spark, sf_dir):
    """Nested selection among all ridge and elastic-net candidates over prepared columns; coordinate descent has no SQL: tests hold it against brute force."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_extendedprice", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"))
    made = study.compared(rows, {"combined": ["q", "l_discount", "l_tax", "l_returnflag"]}, "l_suppkey", "l_extendedprice", K, 3)[0]
    return made.select(*KEYS, "fold", F.round("predicted", 4).alias("predicted"))


@query(f"""
WITH r AS (SELECT * FROM {ROWS_SQL}), o AS (SELECT DISTINCT fold FROM r),
t AS (SELECT o.fold, l_partkey, count(*) AS n, sum(l_extendedprice) AS s FROM r JOIN o ON r.fold <> o.fold GROUP BY ALL),
b AS (SELECT fold, sum(s - n * s / (n + 10.0::DOUBLE)) / sum(n - n * n / (n + 10.0::DOUBLE)) AS b FROM t GROUP BY fold)
SELECT {', '.join('r.' + k for k in KEYS)}, r.fold, round(b + coalesce((t.s - b * t.n) / (t.n + 10.0::DOUBLE), 0), 3) AS predicted
FROM r JOIN b ON b.fold = r.fold LEFT JOIN t ON t.fold = r.fold AND t.l_partkey = r.l_partkey""")
def m08_ridge_over_parts(spark, sf_dir):
    """Ridge over a categorical of as many levels as there are parts."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", "l_extendedprice", F.concat(F.lit("p"), F.col("l_partkey")).alias("part"))
    made = study.compared(rows, {"preparation": ["part"]}, "l_suppkey", "l_extendedprice", K, grid=[("ridge", 10.0, 0.0)])[0]
    return made.select(*KEYS, "fold", F.round("predicted", 3).alias("predicted"))


@query(f"""
SELECT fold AS "outer", 'test' AS part, NULL AS "inner", l_suppkey FROM {FOLDS_SQL} UNION ALL SELECT "outer", 'train', "inner", l_suppkey FROM {NESTED_SQL}""")
def m05_split_manifest(spark, sf_dir):
    assigned = folds(spark, sf_dir)
    return study.manifest(assigned, validation.nested_folds(assigned, "l_suppkey", 3), "l_suppkey")


@query(f"""
WITH r AS (SELECT * FROM {ROWS_SQL}), o AS (SELECT DISTINCT fold FROM r),
t AS (
  SELECT o.fold, 0 AS f, l_quantity AS v, count(*) AS n, sum(l_extendedprice) AS s FROM r JOIN o ON r.fold <> o.fold GROUP BY ALL
  UNION ALL SELECT o.fold, 1, l_discount, count(*), sum(l_extendedprice) FROM r JOIN o ON r.fold <> o.fold GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, lead(v) OVER (PARTITION BY fold, f ORDER BY v) AS nv, sum(n) OVER (PARTITION BY fold, f) AS tn, sum(s) OVER (PARTITION BY fold, f) AS ts FROM t WINDOW w AS (PARTITION BY fold, f ORDER BY v)),
b AS (SELECT * FROM c WHERE nv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, f, v) = 1)
SELECT {', '.join(KEYS)}, fold, round(CASE WHEN CASE f WHEN 0 THEN l_quantity ELSE l_discount END <= v + (nv - v) / 2 THEN ls / ln ELSE (ts - ls) / (tn - ln) END, 3) AS predicted FROM r JOIN b USING (fold)""")
def m09_one_split_trees(spark, sf_dir):
    """A tree a fold with its best split, over all training rows."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    made = validation.forest_study(rows, folds(spark, sf_dir), "l_suppkey", ["l_quantity", "l_discount"], "l_extendedprice", trees=1, depth=1, bootstrap=False)
    return made.select(*KEYS, "fold", F.round("predicted", 3).alias("predicted"))


def m09_random_forest(spark, sf_dir):
    """All nine candidates of 400 trees, chosen over three inner folds. Random splits have no SQL: tests hold trees against brute force, and the study's cover, choice and gain over the mean."""
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_suppkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"), "l_discount", "l_tax", "l_extendedprice")
    assigned = folds(spark, sf_dir)
    made = validation.forest_study(rows, assigned, "l_suppkey", ["q", "l_discount", "l_tax"], "l_extendedprice", nested=validation.nested_folds(assigned, "l_suppkey", 3))
    return made.select(*KEYS, "fold", F.round("predicted", 4).alias("predicted"))


query()(m08_m10_linear_study)
query()(m09_random_forest)


@query("""
WITH h AS (SELECT o_orderkey, o_custkey, o_orderdate, md5(o_orderstatus || o_orderpriority) AS data_hash FROM orders)
SELECT o_orderkey, count(*) OVER (PARTITION BY data_hash, o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_runs FROM h""")
def a23_prior_runs(spark, sf_dir):
    hashed = table(spark, sf_dir, "orders").withColumn("data_hash", F.md5(F.concat("o_orderstatus", "o_orderpriority").cast("binary")))
    before = Window.partitionBy("data_hash", "o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("o_orderkey", F.count("*").over(before).alias("prior_runs"))
