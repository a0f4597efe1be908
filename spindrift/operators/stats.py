"""Statistics of each series, computed together in one pass over the signal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.signal import in_time, series, finite_trials

NAN = float("nan")


def _centroid(fs: float) -> Column:
    top, bottom = F.sum(F.col("t") / fs * F.col("v") * F.col("v")), F.sum(F.col("v") * F.col("v"))
    return F.when((F.abs(top) < 1e-10) & (F.abs(bottom) < 1e-10), 0.0).otherwise(F.try_divide(top, bottom))


def _burstiness() -> Column:
    ratio = F.try_divide(F.stddev_pop(F.col("v")), F.avg(F.col("v")))
    return F.when(F.first("trial_mean") == 0, 0.0).otherwise(F.try_divide(ratio - 1, ratio + 1))


def simple(fs: float = 1.0, threshold: float = 0.02, dx: float = 1.0, x: list[float] | None = None) -> dict[str, Column]:
    """Name -> aggregate over a series with the columns v, t, m (mean), med (median), trial_mean, d (step), s (sign change).

    A seizure starts at the largest step if that is at least the threshold. The area's samples are dx apart, or stand at the places x.
    """
    at = F.array(*[F.lit(float(a)) for a in x or []]).cast("array<double>")
    gap = F.lit(float(dx)) if x is None else F.get(at, F.col("t") + 1) - F.get(at, F.col("t"))
    x = F.col("v") - F.col("m")
    return {
        "abs_energy": F.sum(F.col("v") * F.col("v")),
        "average_power": F.try_divide(F.sum(F.col("v") * F.col("v")), (F.max(F.col("t")) - F.min(F.col("t"))) / fs),
        "calc_mean": F.avg(F.col("v")),
        "calc_var": F.var_pop(F.col("v")),
        "calc_std": F.stddev_pop(F.col("v")),
        "calc_skewness": F.coalesce(F.skewness(F.col("v")), F.lit(NAN)),
        "calc_kurtosis": F.coalesce(F.kurtosis(F.col("v")), F.lit(NAN)),
        "calc_max": F.max(F.col("v")),
        "calc_min": F.min(F.col("v")),
        "calc_median": F.median(F.col("v")),
        "mean_abs_dev": F.avg(F.abs(x)),
        "median_abs_dev": F.median(F.abs(F.col("v") - F.col("med"))),
        "rms": F.sqrt(F.avg(F.col("v") * F.col("v"))),
        "interq_range": F.percentile(F.col("v"), 0.75) - F.percentile(F.col("v"), 0.25),
        "burstiness": _burstiness(),
        "calc_centroid": _centroid(fs),
        "zero_crossing": F.sum(F.coalesce(F.col("s"), F.lit(0))).cast("double"),
        "seizure_onset": F.when(F.max("d") < threshold, 0.0).otherwise(F.max_by(F.col("t"), F.struct("d", -F.col("t"))).cast("double")),
        "auc": F.coalesce(F.sum((F.col("v") + F.col("d") / 2) * gap), F.lit(0.0)),
    }


def _needs(names: list[str], signal: DataFrame) -> DataFrame:
    """Only the helper columns that the chosen features read; all windows share the partitioning of the aggregation."""
    if "mean_abs_dev" in names:
        signal = signal.withColumn("m", F.avg("v").over(series()))
    if "median_abs_dev" in names:
        signal = signal.withColumn("med", F.median("v").over(series()))
    if {"seizure_onset", "auc"} & set(names):
        signal = signal.withColumn("d", F.lead("v").over(in_time()) - F.col("v"))
    if "zero_crossing" in names:
        signal = signal.withColumn("s", (F.signum("v") != F.lag(F.signum("v")).over(in_time())).cast("int"))
    if "burstiness" in names:
        signal = signal.join(signal.groupBy("trial").agg(F.avg("v").alias("trial_mean")), "trial")
    return signal


def region_stats(signal: DataFrame, names: list[str], fs: float = 1.0, gated: bool = True, **options) -> DataFrame:
    """(trial, region, one column a feature). A trial with a value that is not finite gets NaN throughout. options: as in ``simple``."""
    table = simple(fs, **options)
    unknown = [n for n in names if n not in table]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    found = _needs(names, signal).groupBy("trial", "region").agg(*[table[n].alias(n) for n in names])
    if not gated:
        return found
    ok = finite_trials(signal)
    return found.join(ok, "trial").select("trial", "region", *[F.when(F.col("ok"), F.col(n)).otherwise(F.lit(NAN)).alias(n) for n in names])


def long(stats: DataFrame, names: list[str]) -> DataFrame:
    """(trial, region, feature, label, value): labels are <feature>_<region>."""
    tall = stats.unpivot(["trial", "region"], names, "feature", "value")
    return tall.select("trial", "region", "feature", F.concat_ws("_", "feature", "region").alias("label"), "value")


def moments(signal: DataFrame, orders: list[int] = (2, 3, 4, 5, 6)) -> DataFrame:
    """(trial, region, k, value): central moments."""
    x = F.col("v") - F.col("m")
    wide = signal.withColumn("m", F.avg("v").over(series())).groupBy("trial", "region").agg(*[F.avg(F.pow(x, F.lit(k))).alias(str(k)) for k in orders])
    return wide.unpivot(["trial", "region"], [str(k) for k in orders], "k", "value").withColumn("k", F.col("k").cast("int"))


def ecdf(signal: DataFrame) -> DataFrame:
    """(trial, region, rank, v, p): sorted values with k / n; ties get increasing ranks."""
    by_value = series().orderBy("v", "t")
    return signal.select("trial", "region", F.row_number().over(by_value).alias("rank"), "v").withColumn("p", F.col("rank") / F.count("*").over(series()))


def auc_limits(signal: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """(trial, region, interval, value): trapezoid over t inside each closed interval; empty ones are left out."""
    spark = signal.sparkSession
    intervals = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(limits)], "interval int, lo double, hi double")
    step = signal.withColumn("next_v", F.lead("v").over(in_time())).withColumn("next_t", F.lead("t").over(in_time()))
    inside = step.join(F.broadcast(intervals), (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    area = F.when(F.col("next_t") <= F.col("hi"), (F.col("v") + F.col("next_v")) / 2 * (F.col("next_t") - F.col("t"))).otherwise(0.0)
    return inside.groupBy("trial", "region", "interval").agg(F.sum(area).alias("value"))


def kuramoto(signal: DataFrame, mean: bool = True) -> DataFrame:
    """Order of the phases v over regions at each t, or its mean over t; at least two regions."""
    order = signal.groupBy("trial", "t").agg(F.count("*").alias("n"), F.sqrt(F.pow(F.avg(F.cos("v")), 2) + F.pow(F.avg(F.sin("v")), 2)).alias("value")).filter("n >= 2").drop("n")
    return order.groupBy("trial").agg(F.avg("value").alias("value")) if mean else order


def autocorrelation(signal: DataFrame, lags: int) -> DataFrame:
    """(trial, region, lag, value): biased autocovariance over the variance, both over n; 0 for a constant series.

    Lagged values come from the sorted window, so nothing is joined.
    """
    x = signal.withColumn("x", F.col("v") - F.avg("v").over(series()))
    lagged = x.select("trial", "region", "x", *[F.lag("x", k).over(in_time()).alias(f"x{k}") for k in range(lags + 1)])
    sums = lagged.groupBy("trial", "region").agg(*[F.sum(F.col("x") * F.col(f"x{k}")).alias(str(k)) for k in range(lags + 1)])
    tall = sums.withColumn("power", F.col("0")).unpivot(["trial", "region", "power"], [str(k) for k in range(lags + 1)], "lag", "value")
    return tall.select("trial", "region", F.col("lag").cast("int").alias("lag"), F.coalesce(F.try_divide("value", "power"), F.lit(0.0)).alias("value"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
