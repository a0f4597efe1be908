"""The 22 canonical time-series characteristics, and mean and deviation, of z-scored series.

Most are aggregates over the long signal; those that fit curves, or search whole series or all lags, run as kernels per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import kernels, states
from spindrift.operators.signal import in_time, series, zscore
from spindrift.operators.stats import autocorrelation



def _per(df: DataFrame, value) -> DataFrame:
    return df.groupBy("trial", "region").agg(value.alias("value"))


def histogram_mode(signal: DataFrame, bins: int) -> DataFrame:
    """Centre of the fullest of equal bins over the range; ties are averaged."""
    low, high = F.min("v").over(series()), F.max("v").over(series())
    placed = signal.withColumn("low", low).withColumn("width", (high - low) / bins)
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("width")), F.lit(0.0))), F.lit(bins - 1))
    counted = placed.groupBy("trial", "region", bin_.alias("bin")).agg(F.count("*").alias("c"), F.first("low").alias("low"), F.first("width").alias("width"))
    fullest = counted.withColumn("top", F.max("c").over(series())).filter("c = top")
    return _per(fullest, F.avg(F.col("low") + F.col("width") * (F.col("bin") + 0.5)))


def gaussian_ami_minimum(signal: DataFrame, lags: int = 40) -> DataFrame:
    """First minimum over lags of -1/2 ln(1 - r^2), r the autocorrelation."""
    by_lag = series().orderBy("lag")
    ami = autocorrelation(signal, lags).filter("lag > 0").withColumn("m", -0.5 * F.log(F.greatest(1 - F.col("value") * F.col("value"), F.lit(1e-300))))
    near = ami.withColumn("before", F.lag("m").over(by_lag)).withColumn("after", F.lead("m").over(by_lag))
    return _per(near, F.coalesce(F.min(F.when((F.col("m") < F.col("before")) & (F.col("m") < F.col("after")), F.col("lag"))), F.lit(lags)).cast("double"))


def histogram_ami(signal: DataFrame, tau: int = 2, bins: int = 5) -> DataFrame:
    """Mutual information in nats of samples tau apart, in equal bins a little wider than the range."""
    low, high = F.min("v").over(series()) - 0.1, F.max("v").over(series()) + 0.1
    placed = signal.withColumn("b", F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
    joint = placed.withColumn("c", F.lead("b", tau).over(in_time())).filter("c is not null").groupBy("trial", "region", "b", "c").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    row, column = Window.partitionBy("trial", "region", "b"), Window.partitionBy("trial", "region", "c")
    shares = joint.withColumn("total", F.sum("n").over(series())).withColumn("nb", F.sum("n").over(row)).withColumn("nc", F.sum("n").over(column))
    return _per(shares, F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nb") * F.col("nc")))))


def trev(signal: DataFrame) -> DataFrame:
    return _per(signal.withColumn("d", F.lead("v").over(in_time()) - F.col("v")), F.avg(F.pow("d", F.lit(3))))


def pnn40(signal: DataFrame) -> DataFrame:
    d = signal.withColumn("d", F.abs(F.lead("v").over(in_time()) - F.col("v")) * 1000).filter("d is not null")
    return _per(d, F.avg((F.col("d") > 40).cast("double")))


def longest(path: DataFrame, state: int) -> DataFrame:
    """Longest run of a state in a path (trial, region, t, state); 0 without one."""
    return _per(states.runs(path), F.coalesce(F.max(F.when(F.col("state") == state, F.col("length"))), F.lit(0)).cast("double"))


def longest_above_mean(signal: DataFrame) -> DataFrame:
    return longest(signal.select("trial", "region", "t", (F.col("v") > F.avg("v").over(series())).cast("int").alias("state")), 1)


def longest_decrease(signal: DataFrame) -> DataFrame:
    d = signal.withColumn("d", F.lead("v").over(in_time()) - F.col("v")).filter("d is not null")
    return longest(d.select("trial", "region", "t", (F.col("d") >= 0).cast("int").alias("state")), 0)


def letters(signal: DataFrame, n: int = 3) -> DataFrame:
    """(trial, region, t, letter): equally filled classes of the values, by rank."""
    rank = F.row_number().over(series().orderBy("v", "t")) - 1
    return signal.select("trial", "region", "t", F.floor(rank * n / F.count("*").over(series())).cast("int").alias("letter"))


def motif_entropy(signal: DataFrame) -> DataFrame:
    """Entropy in nats of pairs of successive letters of three."""
    pairs = letters(signal).withColumn("next", F.lead("letter").over(in_time())).filter("next is not null").groupBy("trial", "region", "letter", "next").agg(F.count("*").alias("n"))
    p = pairs.withColumn("p", F.col("n") / F.sum("n").over(series()))
    return _per(p, -F.sum(F.col("p") * F.log("p")))


def forecast_residual(signal: DataFrame, past: int) -> DataFrame:
    """Each sample less the mean of the ``past`` ones before it."""
    mean = F.avg("v").over(in_time().rowsBetween(-past, -1))
    full = F.count("v").over(in_time().rowsBetween(-past, -1)) == past
    return signal.withColumn("r", F.when(full, F.col("v") - mean)).filter("r is not null").select("trial", "region", "t", F.col("r").alias("v"))


def mean3_stderr(signal: DataFrame) -> DataFrame:
    return _per(forecast_residual(signal, 3), F.stddev_samp("v"))


def mean(signal: DataFrame) -> DataFrame:
    return _per(signal, F.avg("v"))


def spread(signal: DataFrame) -> DataFrame:
    return _per(signal, F.stddev_samp("v"))


def _kernel(fn):
    """A statistic of each z-scored series by a kernel, where the series is; NaN for a series of under two samples."""

    def run(recordings: DataFrame) -> DataFrame:
        return kernels.per_series(recordings, lambda x: [fn(kernels.standard(x)) if len(x) > 1 else float("nan")]).select("trial", "region", F.get("v", F.lit(0)).alias("value"))

    return run


#: On the z-scored signal.
SIGNAL = {
    "DN_HistogramMode_5": lambda s: histogram_mode(s, 5),
    "DN_HistogramMode_10": lambda s: histogram_mode(s, 10),
    "CO_HistogramAMI_even_2_5": histogram_ami,
    "CO_trev_1_num": trev,
    "MD_hrv_classic_pnn40": pnn40,
    "SB_BinaryStats_mean_longstretch1": longest_above_mean,
    "SB_BinaryStats_diff_longstretch0": longest_decrease,
    "SB_MotifThree_quantile_hh": motif_entropy,
    "IN_AutoMutualInfoStats_40_gaussian_fmmi": gaussian_ami_minimum,
    "FC_LocalSimple_mean3_stderr": mean3_stderr,
}
#: On the recordings, each series z-scored inside the kernel.
SERIES_KERNELS = {
    "CO_f1ecac": _kernel(kernels.first_1e_crossing),
    "CO_FirstMin_ac": _kernel(kernels.first_minimum),
    "FC_LocalSimple_mean1_tauresrat": _kernel(kernels.residual_ratio),
    "SB_TransitionMatrix_3ac_sumdiagcov": _kernel(kernels.transition_spread),
    "DN_OutlierInclude_p_001_mdrmd": _kernel(lambda x: kernels.outlier_timing(x)),
    "DN_OutlierInclude_n_001_mdrmd": _kernel(lambda x: kernels.outlier_timing(-x)),
    "SP_Summaries_welch_rect_area_5_1": _kernel(kernels.low_power),
    "SP_Summaries_welch_rect_centroid": _kernel(kernels.power_centre),
    "PD_PeriodicityWang_th0_01": _kernel(kernels.periodicity),
    "CO_Embed2_Dist_tau_d_expfit_meandiff": _kernel(kernels.embedding_fit),
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": _kernel(lambda x: kernels.fluctuation(x, "range")),
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": _kernel(lambda x: kernels.fluctuation(x, "dfa")),
}
#: On the raw signal.
RAW = {"DN_Mean": mean, "DN_Spread_Std": spread}
NAMES = [*SIGNAL, *SERIES_KERNELS, *RAW]


def feature(name: str, signal: DataFrame, recordings: DataFrame) -> DataFrame:
    """(trial, region, value) of one characteristic."""
    if name in SIGNAL:
        return SIGNAL[name](zscore(signal))
    return RAW[name](signal) if name in RAW else SERIES_KERNELS[name](recordings)
