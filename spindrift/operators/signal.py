"""Recordings as tables.

Long form: signal(trial BIGINT, region INT, t INT, v DOUBLE). Array form: recordings(trial, region, v ARRAY<DOUBLE>),
one row per series, which kernels that need a whole recording use. A recording is the unit that must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def series() -> WindowSpec:
    return Window.partitionBy("trial", "region")


def in_time() -> WindowSpec:
    return series().orderBy("t")


def number_regions(df: DataFrame, trial: str, order: str) -> DataFrame:
    """Add ``region``: 0, 1, ... within the trial by ``order``."""
    return df.withColumn("region", F.row_number().over(Window.partitionBy(trial).orderBy(order)) - 1)


def number_rows(df: DataFrame, trial: str, order: list[str], rows: int = 1 << 17) -> DataFrame:
    """number_regions for trials too large for one task: ``order`` starts with a whole number, ranges of which are numbered apart and moved by the rows before them."""
    lead = F.col(order[0])
    n, low, high = df.agg(F.count("*"), F.min(lead), F.max(lead)).first()
    if low is None or low == high or n <= rows:
        return number_regions(df, trial, F.struct(*order))
    # Nulls come first, as in an ascending order.
    dealt = df.withColumn("_range", F.coalesce(F.width_bucket(lead, F.lit(float(low)), F.lit(float(high)), F.lit(-(-n // rows))), F.lit(-1)))
    counted = dealt.groupBy(F.col(trial).alias("_trial"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = counted.select("_trial", "_r", (F.sum("_n").over(Window.partitionBy("_trial").orderBy("_r")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(trial, "_range").orderBy(F.struct(*order)))
    met = dealt.withColumn("_k", inside).join(F.broadcast(before), F.col(trial).eqNullSafe(F.col("_trial")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("region", (F.col("_before") + F.col("_k") - 1).cast("int")).drop("_range", "_trial", "_r", "_before", "_k")


def recordings(df: DataFrame, trial: str, region: str, values: str) -> DataFrame:
    return df.select(F.col(trial).cast("long").alias("trial"), F.col(region).cast("int").alias("region"), F.col(values).cast("array<double>").alias("v"))


def to_signal(recordings: DataFrame) -> DataFrame:
    """Array form to long form."""
    return recordings.select("trial", "region", F.posexplode("v").alias("t", "v"))


def to_recordings(signal: DataFrame) -> DataFrame:
    """Long form to array form, by time."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    return signal.groupBy("trial", "region").agg(ordered.alias("s")).select("trial", "region", F.col("s.v").alias("v"))


def from_wide(df: DataFrame, trial: str, t: str, columns: list[str]) -> DataFrame:
    """One column per series to long form; regions count in the order of the columns."""
    numbered = df.select(F.col(trial).alias("trial"), F.col(t).cast("int").alias("t"), *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    return numbered.unpivot(["trial", "t"], [str(i) for i in range(len(columns))], "region", "v").select("trial", F.col("region").cast("int").alias("region"), "t", "v")


def from_events(events: DataFrame, ts: str, series: str, value: str, step: str = "day") -> DataFrame:
    """Event log to long form: the mean value per step of time; steps without events carry the last value on (0 before the first)."""
    per_step = events.groupBy(F.col(series).alias("series"), F.date_trunc(step, F.col(ts)).alias("at")).agg(F.avg(value).alias("v"))
    span = per_step.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    grid = span.select(F.posexplode(F.expr(f"sequence(lo, hi, interval 1 {step})")).alias("t", "at"))
    names = per_step.select("series").distinct()
    regions = names.select("series", (F.row_number().over(Window.orderBy("series")) - 1).alias("region"))
    full = F.broadcast(regions).crossJoin(grid).join(per_step, ["series", "at"], "left")
    filled = F.coalesce(F.last("v", ignorenulls=True).over(Window.partitionBy("region").orderBy("t")), F.lit(0.0))
    return full.select(F.lit(0).cast("long").alias("trial"), "region", "t", filled.alias("v"))


def finite_trials(signal: DataFrame) -> DataFrame:
    """(trial, ok): whether the trial has samples and all are finite."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != F.lit(float("inf")))
    return signal.groupBy("trial").agg(F.bool_and(finite).alias("ok"))


def gate(features: DataFrame, signal: DataFrame, value: str = "value") -> DataFrame:
    """NaN for every value of a trial that is not finite throughout."""
    ok = finite_trials(signal)
    return features.join(ok, "trial", "left").withColumn(value, F.when(F.col("ok"), F.col(value)).otherwise(F.lit(float("nan")))).drop("ok")


def region_select(signal: DataFrame, indices: list[int]) -> DataFrame:
    """Rows of the given regions; an index that no trial has is an error."""
    most = signal.agg(F.max("region")).first()[0]
    if most is None or any(not 0 <= i <= most for i in indices):
        raise ValueError(f"regions must lie between 0 and {most}")
    return signal.filter(F.col("region").isin(indices))


def transient_cut(signal: DataFrame, dt: float, t_cut: float) -> DataFrame:
    """Drop samples up to t_cut and count time anew."""
    kept = signal.filter(F.col("t") * dt > t_cut)
    return kept.withColumn("t", (F.row_number().over(in_time()) - 1).cast("int"))


def decimate(signal: DataFrame, every: int) -> DataFrame:
    return signal.filter(F.col("t") % every == 0).withColumn("t", (F.col("t") / every).cast("int"))


def offset_trim(signal: DataFrame, first: int) -> DataFrame:
    return signal.filter(F.col("t") >= first)


def _with(signal: DataFrame, value: Column) -> DataFrame:
    return signal.select("trial", "region", "t", value.alias("v"))


def zscore(signal: DataFrame) -> DataFrame:
    return _with(signal, F.try_divide(F.col("v") - F.avg("v").over(series()), F.stddev_pop("v").over(series())))


def minmax(signal: DataFrame) -> DataFrame:
    low, high = F.min("v").over(series()), F.max("v").over(series())
    return _with(signal, F.try_divide(F.col("v") - low, high - low))


def maxnorm(signal: DataFrame) -> DataFrame:
    return _with(signal, F.try_divide(F.col("v"), F.max("v").over(series())))


def demean(signal: DataFrame) -> DataFrame:
    return _with(signal, F.col("v") - F.avg("v").over(series()))


def detrend(signal: DataFrame) -> DataFrame:
    """Less the least-squares line over t; moments are centred, so long series lose no digits."""
    t, v = F.col("t") - F.avg("t").over(series()), F.col("v") - F.avg("v").over(series())
    centred = signal.withColumn("tc", t).withColumn("vc", v)
    slope = F.coalesce(F.try_divide(F.sum(F.col("tc") * F.col("vc")).over(series()), F.sum(F.col("tc") * F.col("tc")).over(series())), F.lit(0.0))
    return _with(centred, F.col("vc") - slope * F.col("tc"))


def clip_artefacts(signal: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Clip to threshold standard deviations about zero."""
    limit = threshold * F.stddev_pop("v").over(series())
    return _with(signal, F.least(F.greatest(F.col("v"), -limit), limit))


#: Steps of preprocess, in the order they are applied.
STEPS = ("zscores", "offset", "demean", "detrend", "filter", "remove_strong_artefacts")


def preprocess(signal: DataFrame, config: dict, fs: float = 1.0) -> DataFrame:
    """Apply the configured steps once, in the fixed order of STEPS; a step is on if config has it with use = True."""
    from spindrift.operators import kernels

    unknown = set(config) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    on = {k: v for k, v in config.items() if v.get("use", True)}
    if "zscores" in on:
        signal = zscore(signal)
    if "offset" in on:
        signal = offset_trim(signal, on["offset"]["value"])
    if "demean" in on:
        signal = demean(signal)
    if "detrend" in on:
        signal = detrend(signal)
    if "filter" in on:
        f = on["filter"]
        signal = to_signal(kernels.band_pass(to_recordings(signal), f["low_cut"], f["high_cut"], 1 / fs, f.get("order", 2)))
    if "remove_strong_artefacts" in on:
        signal = clip_artefacts(signal, on["remove_strong_artefacts"].get("threshold", 3.0))
    return signal
