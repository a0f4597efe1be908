"""Entropies, mutual information and transfer entropy.

Nearest-neighbour estimators search the samples of one pair of series, a row of its own, in the order of one of them:
the work grows with the number of pairs, and with the series' length to a power between one and two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import kernels
from spindrift.operators.signal import in_time, series

NAT_TO_BIT = 1.4427  # fixed value
TINY = 2.2250738585072014e-308  # least positive double


def entropy_bin(signal: DataFrame, digits: int | None = None) -> DataFrame:
    """(trial, region, value): Shannon entropy of the value frequencies over log2 of the number of samples."""
    v = F.round("v", digits) if digits is not None else F.col("v")
    counted = signal.groupBy("trial", "region", v.alias("v")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(series())
    shares = counted.withColumn("p", p).withColumn("n", F.sum("c").over(series()))
    return shares.groupBy("trial", "region").agg(F.coalesce(F.try_divide(-F.sum(F.col("p") * F.log2("p")), F.log2(F.first("n"))), F.lit(0.0)).alias("value"))


def _grid_entropy(density: DataFrame, points: int) -> DataFrame:
    p = F.try_divide("d", F.sum("d").over(series()))
    return density.withColumn("p", p).filter("p > 0").groupBy("trial", "region").agg((-F.sum(F.col("p") * F.log2("p")) / math.log2(points)).alias("value"))


def _grid(stats: DataFrame, points: int) -> DataFrame:
    g = stats.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return g.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("g") / (points - 1))


def entropy_gauss(signal: DataFrame, points: int = 100) -> DataFrame:
    """The same of a fitted normal on an even grid over the range."""
    stats = signal.groupBy("trial", "region").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).filter("s > 0")
    z = (F.col("x") - F.col("m")) / F.col("s")
    return _grid_entropy(_grid(stats, points).withColumn("d", F.exp(-0.5 * z * z)), points)


def entropy_kde(signal: DataFrame, points: int = 50) -> DataFrame:
    """The same of a Gaussian kernel density with Silverman's bandwidth."""
    stats = signal.groupBy("trial", "region").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).filter("s > 0")
    stats = stats.withColumn("h", F.col("s") * F.pow(F.col("n") * 0.75, F.lit(-0.2)))
    met = signal.select("trial", "region", "v").join(_grid(stats, points).select("trial", "region", "g", "x", "h"), ["trial", "region"])
    z = (F.col("x") - F.col("v")) / F.col("h")
    return _grid_entropy(met.groupBy("trial", "region", "g").agg(F.sum(F.exp(-0.5 * z * z)).alias("d")), points)


def entropy_nearest(signal: DataFrame) -> DataFrame:
    """(trial, region, value): Kozachenko-Leonenko differential entropy in bits; equal neighbours count at the least distance."""
    by_value = series().orderBy("v", "t")
    gap = F.least(F.col("v") - F.lag("v").over(by_value), F.lead("v").over(by_value) - F.col("v"))
    near = signal.withColumn("gap", F.greatest(gap, F.lit(2.2250738585072014e-308)))
    found = near.groupBy("trial", "region").agg(F.avg(F.log("gap")).alias("g"), F.count("*").alias("n")).filter("n > 1")
    # digamma(n) - digamma(1) is the harmonic number of n - 1; a ball of one dimension has length 2.
    harmonic = F.aggregate(F.sequence(F.lit(1), (F.col("n") - 1).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return found.select("trial", "region", ((F.col("g") + math.log(2) + harmonic) / math.log(2)).alias("value"))


def entropy_pooled(signal: DataFrame, buckets: int = 64) -> DataFrame:
    """(trial, value): the same over all samples of a trial together, whatever their region.

    The values of a trial are dealt over buckets of its range; what a bucket's ends need of the next filled ones are two numbers.
    """
    span = signal.groupBy("trial").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    dealt = signal.join(span, "trial").select("trial", "v", place.alias("bucket"))
    ends, by_bucket = dealt.groupBy("trial", "bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), Window.partitionBy("trial").orderBy("bucket")
    beside = ends.select("trial", "bucket", F.lag("hi").over(by_bucket).alias("before"), F.lead("lo").over(by_bucket).alias("after"))
    by_value = Window.partitionBy("trial", "bucket").orderBy("v")
    near = dealt.join(beside, ["trial", "bucket"]).withColumn("left", F.coalesce(F.lag("v").over(by_value), "before")).withColumn("right", F.coalesce(F.lead("v").over(by_value), "after"))
    gap = F.greatest(F.least(F.col("v") - F.col("left"), F.col("right") - F.col("v")), F.lit(TINY))
    found = near.groupBy("trial").agg(F.avg(F.log(gap)).alias("g"), F.count("*").alias("n")).filter("n > 1")
    return found.select("trial", ((F.col("g") + math.log(2) + _harmonic_number(F.col("n") - 1)) / math.log(2)).alias("value"))


def _harmonic_number(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; from 1,000 on by its asymptotic series, which is exact to the last digits there."""
    m = m.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(1000.0)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return F.when(m <= 1000, summed).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))


def entropy_levels(signal: DataFrame, digits: int | None = None) -> DataFrame:
    """(trial, region, value): ``entropy_bin`` of every series and, with a null region, of all samples of a trial together: both levels in one set of groups."""
    v = F.round("v", digits) if digits is not None else F.col("v")
    rows = signal.select("trial", "region", v.alias("v"))
    counted = rows.groupingSets([["trial", "region", "v"], ["trial", "v"]], "trial", "region", "v").agg(F.count("*").alias("c"), F.grouping("region").alias("pooled"))
    # Over log2 of the samples: -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n.
    found = counted.groupBy("trial", "region", "pooled").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    value = F.when(F.col("n") > 1, 1 - F.col("s") / F.col("n") / F.log2("n")).otherwise(0.0)
    return found.select("trial", "region", value.alias("value"))


def pairs_build(spark, sources: list[int], targets: list[int], mode: str = "all") -> DataFrame:
    """(source, target): the product of the lists, or position by position ("pairwise", equal lengths)."""
    if mode == "pairwise":
        if len(sources) != len(targets):
            raise ValueError("pairwise needs lists of equal length")
        return spark.createDataFrame(list(zip(sources, targets)), "source int, target int")
    if mode != "all":
        raise ValueError(f"unknown mode {mode}")
    listed = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    return listed("source", sources).crossJoin(F.broadcast(listed("target", targets)))


def lag_pairs(signal: DataFrame, lag: int) -> DataFrame:
    """(trial, region, t, v, past): each sample with the one lag steps before."""
    return signal.withColumn("past", F.lag("v", lag).over(in_time())).filter("past is not null")


Pairs = list[tuple[int, int]] | DataFrame


def neighbours(recordings: DataFrame) -> DataFrame:
    """(trial, source, target): each region of a trial with the next one."""
    return recordings.select("trial", F.col("region").alias("source"), (F.col("region") + 1).alias("target"))


def mutual_information(recordings: DataFrame, pairs: Pairs, k: int = 4, lag: int = 0) -> DataFrame:
    """(trial, source, target, value): mutual information in bits by nearest neighbours (second form of the estimator), floored at 0."""
    return _per_pair(recordings, pairs, lambda s, t: max(0.0, kernels.ksg_mi(s[: len(s) - lag] if lag else s, t[lag:], k)) * NAT_TO_BIT)


def transfer_entropy(recordings: DataFrame, pairs: Pairs, k: int = 4, delay: int = 1) -> DataFrame:
    """(trial, source, target, value): transfer entropy in nats by nearest neighbours."""
    return _per_pair(recordings, pairs, lambda s, t: kernels.ksg_te(s, t, k, delay))


def _per_pair(recordings: DataFrame, pairs: Pairs, fn, also: str | None = None) -> DataFrame:
    """fn of both series of each pair, and of an integer column ``also``: a list for all trials, or a table (source, target) or (trial, source, target). A pair is a row, so the pairs of a trial are dealt over tasks."""
    if not isinstance(pairs, DataFrame):
        # As many rows as the call names.
        pairs = F.broadcast(recordings.sparkSession.createDataFrame([(int(s), int(t)) for s, t in pairs], "source int, target int"))
    of_trial = ["trial"] if "trial" in pairs.columns else []
    side = lambda name, v: recordings.select("trial", F.col("region").alias(name), F.col("v").alias(v))
    rows = side("source", "x").join(pairs, [*of_trial, "source"]).join(side("target", "y"), ["trial", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series = lambda x: np.asarray(x.values.to_numpy(zero_copy_only=False), float)
        for batch in batches:
            more = [[v.as_py() for v in batch.column(c)] for c in extra]
            values = [float(fn(series(x), series(y), *z)) for x, y, *z in zip(batch.column("x"), batch.column("y"), *more)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("trial", "source", "target", *extra)] + [pa.array(values, pa.float64())], ["trial", "source", "target", *extra, "value"])

    extra = [also] if also else []
    rows = rows.select("trial", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), *extra, "x", "y")
    return rows.mapInArrow(run, "trial bigint, source int, target int, " + "".join(f"{c} int, " for c in extra) + "value double")


def pooled(per_pair: DataFrame) -> DataFrame:
    """(trial, value): the mean over all pairs."""
    return per_pair.groupBy("trial").agg(F.avg("value").alias("value"))


def surrogate_null(recordings: DataFrame, pairs: Pairs, surrogates: int = 5, k: int = 4, seed: int = 0, lag: int = 0) -> DataFrame:
    """(trial, source, target, value): mutual information less its mean over shuffles of the source, floored at 0. Each shuffle of a pair is a row, dealt over tasks like the pairs."""
    if not isinstance(pairs, DataFrame):
        pairs = recordings.sparkSession.createDataFrame([(int(s), int(t)) for s, t in pairs], "source int, target int")
    each = pairs.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(surrogates))))

    def estimate(s: np.ndarray, t: np.ndarray, shuffle: int) -> float:
        s, t = s[: len(s) - lag] if lag else s, t[lag:]
        # Shuffle 0 is the series as it stands.
        s = np.random.default_rng([seed, shuffle]).permutation(s) if shuffle else s
        return max(0.0, kernels.ksg_mi(s, t, k))

    found = _per_pair(recordings, each, estimate, "shuffle")
    null = F.coalesce(F.avg(F.when(F.col("shuffle") > 0, F.col("value"))), F.lit(0.0))
    own = F.max(F.when(F.col("shuffle") == 0, F.col("value")))
    return found.groupBy("trial", "source", "target").agg((F.greatest(own - null, F.lit(0.0)) * NAT_TO_BIT).alias("value"))


def nat2bit(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.col(column) * NAT_TO_BIT)
