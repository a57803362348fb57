"""Queries over spectra: embeddings as regular grids, events of a user as irregular ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import records, spectra
from spectraloom.plans.registry import query
from spectraloom.session import table


def regular(spark, sf_dir):
    """Positions as energies; every seventh vector is flat and every eleventh is cut to four points."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    kept = vectors.where((F.col("vec_id") % 11 != 0) | (F.col("pos") < 4))
    return kept.select(F.col("vec_id").alias("spectrum_id"), F.col("pos").cast("double").alias("x"), F.when(F.col("vec_id") % 7 == 0, 1.0).otherwise(F.col("v").cast("double")).alias("y"))


def irregular(spark, sf_dir):
    """Days since the first of the year, rounded, so that energies repeat."""
    days = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 8_640_000_000) / 10
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("spectrum_id"), days.alias("x"), F.col("value").alias("y"))


REGULAR_SQL = "SELECT vec_id AS spectrum_id, CAST(i AS DOUBLE) AS x, CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS y FROM embeddings, unnest(range(len(embedding))) AS t(i) WHERE vec_id % 11 <> 0 OR i < 4"
IRREGULAR_SQL = "SELECT user_id AS spectrum_id, floor(epoch_us(ts) / 8640000000) / 10 AS x, value AS y FROM events"


def _quantile_sql(q: float) -> str:
    low, lows = f"max(x) FILTER (share <= {q})", f"max(share) FILTER (share <= {q})"
    high, highs = f"min(x) FILTER (share > {q})", f"min(share) FILTER (share > {q})"
    return f"({low} + coalesce(({q} - {lows}) / ({highs} - {lows}) * ({high} - {low}), 0))"


def summary_sql(points: str) -> str:
    t = lambda a, b: f"step * (({a}) + ({b})) / 2"
    info = lambda d: f"CASE WHEN {d} > 0 THEN {d} * ln({d} * (highest - lowest)) ELSE 0 END"
    moment = lambda p: f"sum({t(f'pow(x - centre, {p}) * density', f'pow(x_before - centre, {p}) * density_before')})"
    return f"""
WITH points AS ({points}),
g AS (SELECT spectrum_id, x, avg(y) AS y, count(*) AS n, sum(CASE WHEN abs(y) <= 1e-8 THEN 1 ELSE 0 END) AS zeros FROM points GROUP BY spectrum_id, x),
b AS (SELECT spectrum_id, x, n, zeros, y - min(y) OVER (PARTITION BY spectrum_id) AS y FROM g),
s AS (SELECT *, x - lag(x) OVER w AS step, lag(y) OVER w AS y_before, lag(x) OVER w AS x_before, min(x) OVER (PARTITION BY spectrum_id) AS lowest, max(x) OVER (PARTITION BY spectrum_id) AS highest FROM b WINDOW w AS (PARTITION BY spectrum_id ORDER BY x)),
p AS (SELECT *, coalesce({t("y", "y_before")}, 0) AS piece FROM s),
r AS (SELECT *, sum(piece) OVER (PARTITION BY spectrum_id) AS area, sum(piece) OVER (PARTITION BY spectrum_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM p),
d AS (SELECT *, CASE WHEN area > 0 THEN y / area END AS density, CASE WHEN area > 0 THEN y_before / area END AS density_before, CASE WHEN area > 0 THEN run / area END AS share FROM r),
c AS (SELECT *, sum({t("x * density", "x_before * density_before")}) OVER (PARTITION BY spectrum_id) AS centre FROM d),
e AS (SELECT spectrum_id, CAST(sum(n) AS BIGINT) AS points, count(*) AS grid_points, sum(zeros) AS zeros, max(area) AS area, max(centre) AS centroid, {moment(2)} AS variance, {moment(3)} AS third,
  sum({t(info("density"), info("density_before"))}) AS info, {_quantile_sql(0.1)} AS q10, {_quantile_sql(0.5)} AS q50, {_quantile_sql(0.9)} AS q90,
  sum(CASE WHEN x_before > centre THEN {t("density", "density_before")} WHEN x > centre THEN (x - centre) * (density + density_before + (density - density_before) / step * (centre - x_before)) / 2 END) AS high,
  min(x) AS x_min, max(x) AS x_max, avg(step) AS step_mean, stddev_pop(step) AS step_sd FROM c GROUP BY spectrum_id),
f AS (SELECT *, CASE WHEN points < 5 THEN 'fewer than five finite points' WHEN grid_points < 5 THEN 'fewer than five distinct energies' WHEN NOT coalesce(area > 0, false) THEN 'no positive area' END AS reason FROM e)"""


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _shape_sql() -> str:
    made = {
        "integrated_area_arb_eV": "area", "centroid_eV": "centroid", "spread_eV": "sqrt(greatest(variance, 0))", "energy_skewness": "CASE WHEN variance > 0 THEN third / pow(variance, 1.5) ELSE 0 END",
        "spectral_entropy_effective_fraction": "exp(least(0, -info))", "energy_q10_eV": "q10", "energy_q50_eV": "q50", "energy_q90_eV": "q90", "central_80_width_eV": "q90 - q10", "high_energy_fraction_above_centroid": "high",
    }
    return ", ".join(f"round(CASE WHEN reason IS NULL THEN {v} END, 6) AS {k}" for k, v in made.items())


SUMMARY_COLUMNS = f"SELECT spectrum_id, CASE WHEN reason IS NULL THEN 'usable' ELSE 'failed' END AS status, reason, {_shape_sql()} FROM f"


@query(summary_sql(REGULAR_SQL) + SUMMARY_COLUMNS)
def x01_to_x08_summaries_regular(spark, sf_dir):
    return rounded(spectra.summaries(regular(spark, sf_dir), False).select("spectrum_id", "status", "reason", *spectra.SHAPE), spectra.SHAPE)


@query(summary_sql(IRREGULAR_SQL) + SUMMARY_COLUMNS)
def x01_to_x08_summaries_irregular(spark, sf_dir):
    return rounded(spectra.summaries(irregular(spark, sf_dir), False).select("spectrum_id", "status", "reason", *spectra.SHAPE), spectra.SHAPE)


@query(
    summary_sql(IRREGULAR_SQL)
    + """SELECT spectrum_id, points AS point_count, round(x_min, 6) AS energy_min_eV, round(x_max, 6) AS energy_max_eV, points - grid_points AS duplicate_energy_points,
  round(step_sd / (step_mean + 1e-12), 6) AS energy_step_cv, round(zeros / points, 6) AS zero_intensity_fraction, reason IS NULL AS usable FROM f"""
)
def x09_x10_quality_and_status(spark, sf_dir):
    made = spectra.summaries(irregular(spark, sf_dir), False).select("spectrum_id", *spectra.QUALITY, (F.col("status") == "usable").alias("usable"))
    return rounded(made, ("energy_min_eV", "energy_max_eV", "energy_step_cv", "zero_intensity_fraction"))


@query(
    summary_sql(IRREGULAR_SQL)
    + """, k AS (SELECT f.spectrum_id, i, x_min + i * (x_max - x_min) / 255 AS at FROM f, range(256) AS t(i) WHERE reason IS NULL),
v AS (SELECT k.spectrum_id, k.i, coalesce(s.y + (k.at - s.x) / (s.x_next - s.x) * (s.y_next - s.y), s.y) AS v
  FROM k ASOF JOIN (SELECT spectrum_id, x, y, lead(x) OVER w AS x_next, lead(y) OVER w AS y_next FROM b WINDOW w AS (PARTITION BY spectrum_id ORDER BY x)) s ON k.spectrum_id = s.spectrum_id AND k.at >= s.x)
SELECT spectrum_id, round(-sum(v / total * ln(v / total + 1e-12)), 6) AS spectral_entropy, round(skewness(v), 6) AS intensity_skewness
FROM (SELECT *, sum(v) OVER (PARTITION BY spectrum_id) AS total FROM v) GROUP BY spectrum_id"""
)
def x05_x06_resampled_shape(spark, sf_dir):
    made = spectra.summaries(irregular(spark, sf_dir)).where("status = 'usable'").select("spectrum_id", *spectra.RESAMPLED)
    return rounded(made, spectra.RESAMPLED)


@query(summary_sql(IRREGULAR_SQL) + "SELECT spectrum_id, round(x, 6) AS x, round(share, 6) AS share FROM d")
def w08_cumulative_share(spark, sf_dir):
    return rounded(spectra.cumulative(irregular(spark, sf_dir)).select("spectrum_id", "x", "share"), ("x", "share"))


@query(f"""
SELECT spectrum_id, element, median_x, coalesce(CASE element WHEN 'N' THEN median_x BETWEEN 10 AND 40 WHEN 'O' THEN median_x BETWEEN 40 AND 70 END, false) AS in_window
FROM (SELECT spectrum_id, CASE WHEN spectrum_id % 2 = 0 THEN 'N' ELSE 'O' END AS element, median(x) AS median_x FROM ({REGULAR_SQL}) GROUP BY ALL)""")
def p05_energy_window_gate(spark, sf_dir):
    element = F.when(F.col("spectrum_id") % 2 == 0, "N").otherwise("O")
    return spectra.window_gate(regular(spark, sf_dir), element, {"N": (10.0, 40.0), "O": (40.0, 70.0)})


@query(f"SELECT spectrum_id, list(x ORDER BY x, y) AS xs, list(y ORDER BY x, y) AS ys FROM ({IRREGULAR_SQL}) GROUP BY spectrum_id")
def x11_traces(spark, sf_dir):
    return spectra.traces(irregular(spark, sf_dir))


PROFILE_SQL = """SELECT s_suppkey AS file, c.name AS "column", c.pos AS position, (s_suppkey * c.pos) % 9 AS numeric_count FROM supplier,
  (SELECT unnest(['Time', 'Binding Energy', 'Raw counts', 'fit', 'energy loss', 'note']) AS name, unnest([0, 1, 2, 3, 4, 5]) AS pos) c"""


@query(f"""
WITH u AS (SELECT *, lower("column") AS l FROM ({PROFILE_SQL}) WHERE numeric_count >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY NOT (l IN ('x', 'be') OR regexp_matches(l, 'binding energy|binding_energy|b\\.e\\.|energy|ev')), position) AS e, count(*) OVER (PARTITION BY file) AS n,
  NOT (l IN ('y', 'intensity') OR regexp_matches(l, 'intensity|counts|cps|signal|area|raw|fit')) AS off FROM u)
SELECT a.file, a."column" AS energy, (SELECT arg_min(b."column", b.position + CASE WHEN b.off THEN 100 ELSE 0 END) FROM r b WHERE b.file = a.file AND b.e > 1) AS intensity FROM r a WHERE a.e = 1 AND a.n >= 2""")
def c15_spectrum_columns(spark, sf_dir):
    names = ["Time", "Binding Energy", "Raw counts", "fit", "energy loss", "note"]
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.posexplode(F.array(*map(F.lit, names))).alias("position", "column"))
    return spectra.chosen_columns(made.withColumn("numeric_count", F.col("file") * F.col("position") % 9))


@query(
    summary_sql(REGULAR_SQL)
    + """, l AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS sample FROM lineitem),
j AS (SELECT l.*, f.centroid, sqrt(greatest(f.variance, 0)) AS spread FROM l JOIN f ON f.spectrum_id = l.l_partkey AND f.reason IS NULL)
SELECT l_suppkey AS reference, count(*) AS n_records, CAST(max(sample) AS INT) AS last_sample, round(avg(spread), 6) AS mean_spread, round(quantile_cont(l_extendedprice, 0.1), 6) AS target_p10,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS target_p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS target_p90, round(corr(spread, l_extendedprice), 6) AS spread_target_corr FROM j GROUP BY l_suppkey"""
)
def flagship_broad_spectra(spark, sf_dir):
    """Which papers' spectra are broad, and how that relates to the measured target."""
    lines = table(spark, sf_dir, "lineitem").withColumn("sample", records.sample_number(["l_returnflag", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]))
    made = spectra.summaries(regular(spark, sf_dir), False).where("status = 'usable'").select(F.col("spectrum_id").alias("l_partkey"), "centroid_eV", "spread_eV")
    joined = lines.join(made, "l_partkey")
    cuts = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    each = joined.groupBy(F.col("l_suppkey").alias("reference")).agg(
        F.count("*").alias("n_records"), F.max("sample").alias("last_sample"), F.round(F.avg("spread_eV"), 6).alias("mean_spread"), cuts.alias("p"), F.round(F.corr("spread_eV", "l_extendedprice"), 6).alias("spread_target_corr")
    )
    return each.select("reference", "n_records", "last_sample", "mean_spread", *[F.round(F.col("p")[i], 6).alias(f"target_p{q}") for i, q in enumerate((10, 50, 90))], "spread_target_corr")
