"""Spectra and what is read off them. A spectrum is the table (trial, region, k, freq, mag), one row a bin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import kernels
from spindrift.operators.signal import in_time, series

spectrum = kernels.spectrum


def periodogram(spectrum_fft: DataFrame, n: int, dt: float) -> DataFrame:
    """One-sided 2 dt^2 / T |FFT|^2 of series of n samples."""
    return spectrum_fft.withColumn("mag", 2 * dt * dt / (n * dt) * F.col("mag") * F.col("mag"))


def average(spec: DataFrame) -> DataFrame:
    """Mean spectrum over the regions of a trial, as region 0."""
    return spec.groupBy("trial", "k").agg(F.first("freq").alias("freq"), F.avg("mag").alias("mag")).select("trial", F.lit(0).alias("region"), "k", "freq", "mag")


def levels(spec: DataFrame) -> DataFrame:
    """(trial, region, k, freq, mag): every spectrum and, with a null region, the mean one of each trial, in one set of groups."""
    found = spec.groupingSets([["trial", "region", "k"], ["trial", "k"]], "trial", "region", "k").agg(F.min("freq").alias("freq"), F.avg("mag").alias("mag"))
    return found.select("trial", "region", "k", "freq", "mag")


def _helped(spec: DataFrame) -> DataFrame:
    """With neighbours, running sum, totals and centroid; one sort of each spectrum serves all."""
    by_bin = series().orderBy("k")
    near = spec.withColumns({"before": F.lag("mag").over(by_bin), "after": F.lead("mag").over(by_bin), "running": F.sum("mag").over(by_bin)})
    whole = {"total": F.sum("mag").over(series()), "highest": F.max("mag").over(series()), "bins": F.count("*").over(series())}
    return near.withColumns(whole).withColumn("centre", F.coalesce(F.try_divide(F.sum(F.col("freq") * F.col("mag")).over(series()), F.col("total")), F.lit(0.0)))


def statistics() -> dict[str, Column]:
    """Name -> aggregate over a helped spectrum."""
    total, centre = F.sum(F.col("mag")), F.first("centre")
    spread2 = F.coalesce(F.try_divide(F.sum(F.pow(F.col("freq") - F.col("centre"), 2) * F.col("mag")), total), F.lit(0.0))
    fourth = F.try_divide(F.sum(F.pow(F.col("freq") - F.col("centre"), 4) * F.col("mag")), total)
    products, later, earlier = F.sum(F.col("mag") * F.col("after")), F.sum(F.col("after") * F.col("after")), F.sum(F.when(F.col("after").isNotNull(), F.col("mag") * F.col("mag")))
    peak = (F.col("k") > 0) & (F.col("mag") >= 0.3 * F.col("highest")) & (F.col("mag") > F.col("before")) & (F.col("after").isNotNull()) & (F.col("mag") >= F.col("after"))
    line = F.col("total") * F.col("k") / F.greatest(F.col("bins") - 1, F.lit(1))
    return {
        "spectral_distance": F.sum(line - F.col("running")) / F.first("bins"),
        "fundamental_frequency": F.coalesce(F.min(F.when(peak, F.col("freq"))), F.lit(0.0)),
        "max_frequency": F.max_by(F.col("freq"), F.struct(F.col("mag"), -F.col("k"))),
        "max_psd": F.max(F.col("mag")),
        "median_frequency": F.min(F.when(F.col("running") > F.col("total") / 2, F.col("freq"))),
        "spectral_centroid": centre,
        "spectral_kurtosis": F.when(spread2 == 0, 0.0).otherwise(F.try_divide(fourth, spread2 * spread2)),
        "spectral_variation": F.when((later == 0) | (earlier == 0), 1.0).otherwise(1 - F.try_divide(products, F.sqrt(later * earlier))),
        "spectral_spread": F.sqrt(spread2),
    }


def stats(spec: DataFrame, names: list[str]) -> DataFrame:
    """(trial, region, one column a statistic). fundamental_frequency: lowest local peak of at least 0.3 of the highest; a plateau counts at its first bin."""
    table = statistics()
    return _helped(spec).groupBy("trial", "region").agg(*[table[n].alias(n) for n in names])


def distance_as_printed(spec: DataFrame) -> DataFrame:
    """The value that -1/2 of the summed running sums gives, for comparison with older feature tables."""
    return _helped(spec).groupBy("trial", "region").agg((-0.5 * F.sum("running")).alias("value"))


def band_auc(spec: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """(trial, region, band, value): trapezoid over bins in each half-open band [lo, hi); bands without bins are left out."""
    spark = spec.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "band int, lo double, hi double")
    inside = spec.join(F.broadcast(table), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi")))
    ahead = inside.withColumn("next", F.lead("mag").over(Window.partitionBy("trial", "region", "band").orderBy("k")))
    return ahead.groupBy("trial", "region", "band").agg(F.coalesce(F.sum((F.col("mag") + F.col("next")) / 2), F.lit(0.0)).alias("value"))


def moments(spec: DataFrame, orders: list[int] = (2, 3, 4, 5, 6), normalize: bool = False) -> DataFrame:
    """(trial, region, order, value): central moments of the spectrum's values."""
    m = F.try_divide(F.col("mag"), F.max("mag").over(series())) if normalize else F.col("mag")
    x = spec.withColumn("x", m).withColumn("x", F.col("x") - F.avg("x").over(series()))
    wide = x.groupBy("trial", "region").agg(*[F.avg(F.pow("x", F.lit(o))).alias(str(o)) for o in orders])
    return wide.unpivot(["trial", "region"], [str(o) for o in orders], "order", "value").withColumn("order", F.col("order").cast("int"))


def nearest_bin(spec: DataFrame, freq: float) -> DataFrame:
    """(trial, region, k, freq, mag) of the bin nearest to freq, the lower one on a tie."""
    best = F.min_by(F.struct("k", "freq", "mag"), F.struct(F.abs(F.col("freq") - freq), F.col("k"))).alias("b")
    return spec.groupBy("trial", "region").agg(best).select("trial", "region", "b.*")


def interpolate(spec: DataFrame, step: float) -> DataFrame:
    """(trial, region, g, freq, mag) on a grid 0, step, 2 step, ... up to the highest frequency, linear between bins.

    Each gap between neighbouring bins fills the grid points in it, so nothing is compared with bins elsewhere.
    """
    by_bin = series().orderBy("k")
    gaps = spec.withColumn("f2", F.lead("freq").over(by_bin)).withColumn("m2", F.lead("mag").over(by_bin))
    first, last = F.ceil(F.col("freq") / step - 1e-9), F.when(F.col("f2").isNull(), F.floor(F.col("freq") / step + 1e-9)).otherwise(F.ceil(F.col("f2") / step - 1e-9) - 1)
    points = gaps.withColumn("g", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("g") * step
    value = F.when(F.col("f2").isNull(), F.col("mag")).otherwise(F.col("mag") + (F.col("m2") - F.col("mag")) * (at - F.col("freq")) / (F.col("f2") - F.col("freq")))
    return points.select("trial", "region", F.col("g").cast("int").alias("g"), at.alias("freq"), value.alias("mag"))


def psd_raw(spec: DataFrame, step: float, bands: list[tuple[float, float]], normalize: bool = False, at_freq: float | None = None) -> DataFrame:
    """(trial, region, band, g, value): the interpolated spectrum inside each band, optionally over its maximum or its value nearest a frequency."""
    if normalize and at_freq is not None:
        raise ValueError("normalize by the maximum or at a frequency, not both")
    fine = interpolate(spec, step)
    if normalize:
        fine = fine.withColumn("mag", F.try_divide("mag", F.max("mag").over(series())))
    if at_freq is not None:
        ref = nearest_bin(fine.withColumnRenamed("g", "k"), at_freq).select("trial", "region", F.col("mag").alias("ref"))
        fine = fine.join(ref, ["trial", "region"]).withColumn("mag", F.try_divide("mag", "ref"))
    table = spec.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "band int, lo double, hi double")
    return fine.join(F.broadcast(table), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi"))).select("trial", "region", "band", "g", F.col("mag").alias("value"))


def mel_weights(fs: float, nfft: int, nfilt: int) -> list[tuple[int, int, float]]:
    """(m, k, weight) of triangular filters evenly spaced on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + fs / 2 / 700), nfilt + 2)
    bins = np.floor((nfft + 1) * 700 * (10 ** (mel / 2595) - 1) / fs).astype(int)
    out = []
    for m in range(1, nfilt + 1):
        lo, mid, hi = bins[m - 1 : m + 2]
        out += [(m - 1, int(k), float((k - lo) / (mid - lo))) for k in range(lo, mid)]
        out += [(m - 1, int(k), float((hi - k) / (hi - mid))) for k in range(mid, hi)]
    return out


def filterbank(signal: DataFrame, fs: float, nfft: int = 64, nfilt: int = 10, pre_emphasis: float = 0.97) -> DataFrame:
    """(trial, region, m, db): mel filter energies of the pre-emphasised series, in decibels; signal in long form, of nfft samples."""
    from spindrift.operators.signal import to_recordings

    first = signal.withColumn("v", F.col("v") - pre_emphasis * F.coalesce(F.lag("v").over(in_time()), F.lit(0.0)))
    power = rfft_power(to_recordings(first), nfft)
    weights = signal.sparkSession.createDataFrame(mel_weights(fs, nfft, nfilt), "m int, k int, weight double")
    energy = power.join(F.broadcast(weights), "k").groupBy("trial", "region", "m").agg(F.sum(F.col("weight") * F.col("p")).alias("e"))
    return energy.select("trial", "region", "m", (20 * F.log10(F.greatest("e", F.lit(2.220446049250313e-16)))).alias("db"))


def rfft_power(recordings: DataFrame, nfft: int) -> DataFrame:
    """(trial, region, k, p): |rfft|^2 / nfft of the series as it is."""
    found = kernels.per_series(recordings, lambda x: np.abs(np.fft.rfft(x, nfft)) ** 2 / nfft)
    return found.select("trial", "region", F.posexplode("v").alias("k", "p"))


def cwt(recordings: DataFrame, widths: list[int] = tuple(range(1, 10))) -> DataFrame:
    """(trial, region, width, t, c): continuous wavelet transform with Ricker wavelets of min(10 width, n) points."""

    def run(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.convolve(x, kernels.ricker(min(10 * w, len(x)), w)[::-1], mode="same") for w in widths])

    flat = kernels.per_series(recordings.filter(F.size("v") > 0), run)
    n = (F.size("v") / len(widths)).cast("int")
    rows = flat.withColumn("n", n).select("trial", "region", "n", F.posexplode("v").alias("p", "c"))
    width = F.element_at(F.array(*map(F.lit, widths)), (F.floor(F.col("p") / F.col("n")) + 1).cast("int"))
    return rows.select("trial", "region", width.alias("width"), (F.col("p") % F.col("n")).alias("t"), "c")


def wavelet_stats(coefficients: DataFrame) -> DataFrame:
    """(trial, region, width, abs_mean, std, energy) of each scale."""
    c = F.col("c")
    return coefficients.groupBy("trial", "region", "width").agg(F.abs(F.avg(c)).alias("abs_mean"), F.stddev_pop(c).alias("std"), F.sqrt(F.avg(c * c)).alias("energy"))


def envelope(analytic: DataFrame) -> DataFrame:
    """(trial, region, label, value): mean, std, median, max, min of amplitude and phase."""
    five = lambda c: {"mean": F.avg(c), "std": F.stddev_pop(c), "median": F.median(c), "max": F.max(c), "min": F.min(c)}
    columns = {f"env_{short}_{k}": v for short, c in (("amp", "amp"), ("ph", "phase")) for k, v in five(c).items()}
    return analytic.groupBy("trial", "region").agg(*[v.alias(k) for k, v in columns.items()]).unpivot(["trial", "region"], list(columns), "label", "value")
