"""Spectra: points (spectrum_id, x, y) to grid-invariant summaries.

Points are shuffled once, by spectrum; every aggregate and window after that reuses the
partitioning. Only resampling to a fixed grid uses a vectorised helper.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spectraloom.functions.scalars import finite

SHAPE = (
    "integrated_area_arb_eV", "centroid_eV", "spread_eV", "energy_skewness", "spectral_entropy_effective_fraction",
    "energy_q10_eV", "energy_q50_eV", "energy_q90_eV", "central_80_width_eV", "high_energy_fraction_above_centroid",
)
RESAMPLED = ("spectral_entropy", "intensity_skewness")
QUALITY = ("point_count", "energy_min_eV", "energy_max_eV", "duplicate_energy_points", "energy_step_cv", "zero_intensity_fraction")
#: Where the median energy of an element's spectrum must lie.
WINDOWS = {"N": (350.0, 450.0), "O": (480.0, 580.0)}
RESAMPLE = 256
EDGE = 1e-12


def _id():
    return Window.partitionBy("spectrum_id")


def _along():
    return _id().orderBy("x")


def finite_points(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are both finite."""
    return points.withColumns({"x": finite(F.col("x")), "y": finite(F.col("y"))}).where("x is not null and y is not null")


def grid(points: DataFrame) -> DataFrame:
    """The clean grid: one row a distinct x with the mean y and the counts of raw points and of zeros among them; partitioned by spectrum."""
    near_zero = (F.abs("y") <= 1e-8).cast("int")
    return finite_points(points).repartition("spectrum_id").groupBy("spectrum_id", "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"), F.sum(near_zero).alias("zeros"))


def _between(value: Column, before: Column, step: Column) -> Column:
    """A trapezoid over the step from the point before."""
    return step * (value + before) / 2


def cumulative(points: DataFrame) -> DataFrame:
    """The grid with baseline-shifted y, its step from the point before, the area and, where that is positive, density and cumulative share."""
    based = grid(points).withColumn("y", F.col("y") - F.min("y").over(_id()))
    stepped = based.withColumns({"step": F.col("x") - F.lag("x").over(_along()), "y_before": F.lag("y").over(_along())})
    piece = F.coalesce(_between(F.col("y"), F.col("y_before"), F.col("step")), F.lit(0.0))
    summed = stepped.withColumn("piece", piece).withColumns({"area": F.sum("piece").over(_id()), "run": F.sum("piece").over(_along().rowsBetween(Window.unboundedPreceding, 0))})
    share = lambda c: F.when(F.col("area") > 0, F.col(c) / F.col("area"))
    return summed.withColumns({"density": share("y"), "density_before": share("y_before"), "share": share("run")})


def _quantile(q: float) -> Column:
    """x where the cumulative share reaches q: between the last point at or under it and the first above."""
    low = F.max_by(F.struct("x", "share"), F.when(F.col("share") <= q, F.col("x")))
    high = F.min_by(F.struct("x", "share"), F.when(F.col("share") > q, F.col("x")))
    return low["x"] + F.coalesce((q - low["share"]) / (high["share"] - low["share"]) * (high["x"] - low["x"]), F.lit(0.0))


def _resampled(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Entropy and bias-corrected skewness of y on an even grid over the spectrum's range."""
    entropy, skewness = [], []
    for x, y in zip(xs, ys, strict=True):
        p, v = (a.values.to_numpy(zero_copy_only=False) if a.is_valid else np.zeros(0) for a in (x, y))
        if len(p) < 5 or v.max() <= v.min():
            entropy.append(None), skewness.append(None)
            continue
        even = np.interp(np.linspace(p[0], p[-1], RESAMPLE), p, v - v.min())
        share = even / even.sum()
        entropy.append(float(-(share * np.log(share + EDGE)).sum()))
        off = even - even.mean()
        spread = (off**2).mean()
        skewness.append(float((off**3).mean() / spread**1.5 * np.sqrt(RESAMPLE * (RESAMPLE - 1)) / (RESAMPLE - 2)) if spread > 0 else None)
    return pa.StructArray.from_arrays([pa.array(entropy, pa.float64()), pa.array(skewness, pa.float64())], list(RESAMPLED))


_resampled.__annotations__ = {"xs": pa.Array, "ys": pa.Array, "return": pa.Array}


def resampled(xs: Column, ys: Column) -> Column:
    return F.arrow_udf(_resampled, StructType([StructField(c, DoubleType()) for c in RESAMPLED]))(xs, ys)


def summaries(points: DataFrame, with_resampled: bool = True) -> DataFrame:
    """One row a spectrum: status usable or failed, its reason, the shape metrics (NULL where failed) and the quality metrics.

    Spectra of fewer than five finite points or distinct energies, or without positive area
    over their baseline, fail; spectra without one finite point have no row.
    """
    c = F.col
    walked = cumulative(points).withColumns({"x_before": F.lag("x").over(_along()), "lowest": F.min("x").over(_id()), "highest": F.max("x").over(_id())})
    centre = walked.withColumn("centre", F.sum(_between(c("x") * c("density"), c("x_before") * c("density_before"), c("step"))).over(_id()))

    def moment(power: int) -> Column:
        return F.sum(_between((c("x") - c("centre")) ** power * c("density"), (c("x_before") - c("centre")) ** power * c("density_before"), c("step")))

    width = c("highest") - c("lowest")
    info = lambda d: F.when(d > 0, d * F.ln(d * width)).otherwise(0.0)
    # above the centroid: whole steps, and the part of the step that holds it
    slope = (c("density") - c("density_before")) / c("step")
    at_centre = c("density_before") + slope * (c("centre") - c("x_before"))
    above = F.when(c("x_before") > c("centre"), _between(c("density"), c("density_before"), c("step"))).when(c("x") > c("centre"), _between(c("density"), at_centre, c("x") - c("centre")))
    agg = {
        "points": F.sum("n"), "grid_points": F.count("*"), "zeros": F.sum("zeros"), "area": F.max("area"), "centroid_eV": F.max("centre"), "variance": moment(2), "third": moment(3),
        "info": F.sum(_between(info(c("density")), info(c("density_before")), c("step"))), "energy_q10_eV": _quantile(0.1), "energy_q50_eV": _quantile(0.5), "energy_q90_eV": _quantile(0.9),
        "high": F.sum(above), "energy_min_eV": F.min("x"), "energy_max_eV": F.max("x"), "step_mean": F.avg("step"), "step_sd": F.stddev_pop("step"),
    }
    if with_resampled:
        agg["curve"] = F.array_sort(F.collect_list(F.struct("x", "y")))
    each = centre.groupBy("spectrum_id").agg(*[v.alias(k) for k, v in agg.items()])
    reason = F.when(c("points") < 5, "fewer than five finite points").when(c("grid_points") < 5, "fewer than five distinct energies").when(~(c("area") > 0), "no positive area")
    usable = reason.isNull()
    shape = {
        "integrated_area_arb_eV": c("area"), "centroid_eV": c("centroid_eV"), "spread_eV": F.sqrt(F.greatest(c("variance"), F.lit(0.0))), "energy_skewness": F.when(c("variance") > 0, c("third") / c("variance") ** 1.5).otherwise(0.0),
        "spectral_entropy_effective_fraction": F.exp(F.least(F.lit(0.0), -c("info"))), **{f"energy_q{q}_eV": c(f"energy_q{q}_eV") for q in (10, 50, 90)},
        "central_80_width_eV": c("energy_q90_eV") - c("energy_q10_eV"), "high_energy_fraction_above_centroid": c("high"),
    }
    if with_resampled:
        each = each.withColumn("made", resampled(c("curve.x"), c("curve.y")))
        shape |= {m: c(f"made.{m}") for m in RESAMPLED}
    return each.select(
        "spectrum_id",
        F.when(usable, "usable").otherwise("failed").alias("status"),
        reason.alias("reason"),
        *[F.when(usable, v).alias(k) for k, v in shape.items()],
        c("points").alias("point_count"),
        "energy_min_eV",
        "energy_max_eV",
        (c("points") - c("grid_points")).alias("duplicate_energy_points"),
        (c("step_sd") / (c("step_mean") + EDGE)).alias("energy_step_cv"),
        (c("zeros") / c("points")).alias("zero_intensity_fraction"),
    )


def window_gate(points: DataFrame, element: Column, windows: dict[str, tuple[float, float]] = WINDOWS) -> DataFrame:
    """(spectrum_id, element, median_x, in_window): whether the median energy suits the element; unknown elements don't."""
    low, high = (F.coalesce(*[F.when(F.col("element") == e, F.lit(w[k])) for e, w in windows.items()]) for k in (0, 1))
    medians = finite_points(points).withColumn("element", element).groupBy("spectrum_id", "element").agg(F.percentile("x", F.lit(0.5)).alias("median_x"))
    return medians.withColumn("in_window", F.coalesce(F.col("median_x").between(low, high), F.lit(False)))


def traces(points: DataFrame) -> DataFrame:
    """(spectrum_id, xs, ys): the points in order."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "y")))
    return finite_points(points).groupBy("spectrum_id").agg(ordered.alias("t")).select("spectrum_id", F.col("t.x").alias("xs"), F.col("t.y").alias("ys"))


def chosen_columns(profile: DataFrame) -> DataFrame:
    """(file, energy, intensity): from (file, column, position, numeric_count), the energy column (by name, else the first numeric) and the intensity column (by name, else the next)."""
    useful = profile.where("numeric_count >= 5").withColumn("lower", F.lower("column"))
    # What the names of the columns hold.
    energy = F.col("lower").isin("x", "be") | F.col("lower").rlike("binding energy|binding_energy|b\\.e\\.|energy|ev")
    intensity = F.col("lower").isin("y", "intensity") | F.col("lower").rlike("intensity|counts|cps|signal|area|raw|fit")
    ranked = useful.withColumns({"e": F.struct((~energy).alias("off"), "position"), "i": F.struct((~intensity).alias("off"), "position")})
    firsts = ranked.groupBy("file").agg(F.min_by("column", "e").alias("energy"), F.count("*").alias("n")).where("n >= 2")
    others = ranked.join(firsts, "file").where(F.col("column") != F.col("energy"))
    return others.groupBy("file", "energy").agg(F.min_by("column", "i").alias("intensity"))
