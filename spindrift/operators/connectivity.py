"""Functional connectivity: matrices as edge lists with i < j, and what is derived from them.

Dense products run tile by tile (``tiles``): a trial's regions fall into blocks, and every two blocks are multiplied in a
group of their own. Everything after that, masks, statistics, histograms, is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import kernels, tiles
from spindrift.operators.signal import to_recordings, to_signal, zscore

EDGES = "i int, j int, w double"


def fc_matrix(recordings: DataFrame, kind: str = "corr", positive: bool = False, block: int = tiles.BLOCK, digits: int | None = None, mask: str = "full") -> DataFrame:
    """(trial, i, j, w) for i < j: Pearson correlation or covariance (over n - 1) of the regions' series, NaN where one is constant (correlation) or not finite; rounded to ``digits``.
    Blocks of regions meet tile by tile. With a named mask only the entries that it has: where they are rounded in the tiles, others are not made."""
    if mask != "full":
        regions, samples = tiles.shape(recordings)
        if digits is None or positive or samples > tiles.CUT:
            return only_mask(fc_matrix(recordings, kind, positive, block, digits), sizes(recordings), mask)
        _rule(mask)  # an unknown name is an error
        beside = sizes(recordings).select("trial", F.array(F.col("n").cast("long")).alias("aside"))
        series = tiles.over_series(recordings, _prepare(kind)).join(F.broadcast(beside), "trial")
        return tiles.valued(series, regions, [(0, samples)], lambda a, b: a @ b.T, digits, None, block, keep=lambda i, j, aside: _pairs_of(mask, i, j, aside[0]))
    found = tiles.products(recordings, _prepare(kind), block, digits=digits)
    return found.withColumn("w", F.when(F.isnan("w"), F.col("w")).otherwise(F.greatest("w", F.lit(0.0)))) if positive else found


def fisher_matrix(recordings: DataFrame, block: int = tiles.BLOCK, digits: int | None = None) -> DataFrame:
    """(trial, i, j, z): Fisher z of fc_matrix."""
    return tiles.products(recordings, _prepare("corr"), block, digits=digits, of=(np.arctanh, F.atanh)).withColumnRenamed("w", "z")


def fc_join(signal: DataFrame, digits: int | None = None) -> DataFrame:
    """The same correlation from long form, over the samples that both regions have: (trial, i, j, w); rounded to ``digits``."""
    return _shared_values(zscore(signal), "w", True, digits)


def inner_products(signal: DataFrame, digits: int | None = None) -> DataFrame:
    """(trial, i, j, value) for i < j: sums of products over the samples that both regions have; rounded to ``digits``."""
    return _shared_values(signal, "value", False, digits)


def _shared_values(signal: DataFrame, name: str, mean: bool, digits: int | None) -> DataFrame:
    """(trial, i, j, name): sums of products of _shared_samples, or their means over the samples; null where a pair has no sample with both values.
    Rounded ones are made inside the tiles, which they leave by value where every sample is there."""
    series, regions, cuts = _laid_out(signal)
    if digits is None or len(cuts) > 1:
        found = _shared_samples(signal).select("trial", "i", "j", (F.try_divide("xy", "n") if mean else F.when(F.col("n") > 0, F.col("xy"))).alias(name))
        return tiles._near(found.withColumnRenamed(name, "w"), digits).withColumnRenamed("w", name)

    def rows(cut, tile, aside):
        a, b, names_a, names_b, same = tile
        if all(m[:, k::3].all() for m in (a, b) for k in (0, 1)):
            values = tuple(np.ascontiguousarray(m[:, 2::3]) for m in (a, b))
            yield from tiles.rounded_rows((*values, names_a, names_b, same), lambda x, y: x @ y.T / (x.shape[1] if mean else 1), digits)
            return
        for at, to, n, *_, xy in _sums(tiles.chunks(tile)):
            with np.errstate(all="ignore"):
                w = tiles.near(xy / n if mean else xy, digits)
            order = tiles.in_order(w)
            yield [at[order], to[order], pa.array(w[order], mask=(n == 0)[order])]

    return tiles.grouped(series, regions, cuts, rows, f"i int, j int, {name} double", numbers=3)


def _shared_samples(signal: DataFrame) -> DataFrame:
    """(trial, i, j, n, x, y, xx, yy, xy) for i < j: number, sums and sums of products of the values of both regions, over samples where neither is null; pairs that
    share no sample are left out. The samples of a series are laid out by their t, so that pairs meet tile by tile and no sample of a pair is a row.
    """
    series, regions, cuts = _laid_out(signal)
    sums = ["n", "x", "y", "xx", "yy", "xy"]
    found = tiles.chunked(series, regions, cuts, lambda cut, chunks, aside: map(list, _sums(chunks)), ", ".join(["i int, j int", *(f"{c} double" for c in sums)]), numbers=3)
    return tiles.summed(found, len(cuts), *sums)


def _laid_out(signal: DataFrame) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """Series (trial, region, x) with three numbers a sample by its t: whether there is a row, whether it has a value, and the value or 0; the number of regions; cuts of the samples."""
    last, most = signal.agg(F.max("t"), F.max("region")).first()
    length = 0 if last is None else last + 1

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, v in zip(batch.column("ts"), batch.column("vs")):
                x, t, v = np.zeros((length, 3)), t.values.to_numpy(), v.values
                x[t, 0], x[t, 1], x[t, 2] = 1, v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0.0).to_numpy(zero_copy_only=False)
                out.append(x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("trial"), batch.column("region"), pa.array(out, pa.list_(pa.float64()))], ["trial", "region", "x"])

    samples = signal.groupBy("trial", "region").agg(F.collect_list(F.struct("t", "v")).alias("s"))
    series = samples.select("trial", "region", F.col("s.t").alias("ts"), F.col("s.v").alias("vs")).mapInArrow(lay, "trial bigint, region int, x array<double>")
    return series, (most or 0) + 1, tiles.in_cuts(length, tiles.CUT)


def _sums(chunks: Iterator[tuple]) -> Iterator[tuple]:
    """(i, j, n, x, y, xx, yy, xy) of the pairs of each chunk that share a sample, as in _shared_samples."""
    for i, j, a, b, names_a, names_b in chunks:
        (ra, na, va), (rb, nb, vb) = ([m[:, k::3] for k in range(3)] for m in (a, b))
        if ra.all() and rb.all() and na.all() and nb.all():
            ones = np.full(len(i), float(va.shape[1]))
            found = [ones, ones, va.sum(axis=1)[i], vb.sum(axis=1)[j], (va * va).sum(axis=1)[i], (vb * vb).sum(axis=1)[j], tiles.of_pairs(va @ vb.T, i, j)]
        else:
            found = [tiles.of_pairs(m, i, j) for m in (ra @ rb.T, na @ nb.T, va @ nb.T, na @ vb.T, (va * va) @ nb.T, na @ (vb * vb).T, va @ vb.T)]
        keep = found[0] > 0
        if keep.any():
            yield names_a[i][keep].astype(np.int32), names_b[j][keep].astype(np.int32), *(f[keep] for f in found[1:])


def region_pairs(signal: DataFrame) -> DataFrame:
    """(trial, t, i, j, x, y): every pair of regions at every sample."""
    a, b = signal.select("trial", "t", F.col("region").alias("i"), F.col("v").alias("x")), signal.select("trial", "t", F.col("region").alias("j"), F.col("v").alias("y"))
    return a.join(b, ["trial", "t"]).filter("i < j")


def corr_between(one: DataFrame, other: DataFrame) -> DataFrame:
    """(trial, i, j, w): Pearson correlation of each series of one with each of other, over the samples that both have."""
    # Regions of both sides stand in one table, those of the other side at odd places; pairs of one side are left out in the tiles' rows.
    both = one.withColumn("region", F.col("region") * 2).unionByName(other.select(*one.columns).withColumn("region", F.col("region") * 2 + 1))
    n, x, y, xx, yy, xy = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    cov, spread = xy / n - x / n * (y / n), lambda s, q: F.sqrt(F.greatest(q / n - s / n * (s / n), F.lit(0.0)))
    met = _shared_samples(both).filter("(i + j) % 2 = 1").withColumn("w", F.when(n > 0, F.try_divide(cov, spread(x, xx) * spread(y, yy))))
    first = F.col("i") % 2 == 0
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return met.select("trial", F.when(first, half("i")).otherwise(half("j")).alias("i"), F.when(first, half("j")).otherwise(half("i")).alias("j"), "w")


def sliding_fc(recordings: DataFrame, width: int, digits: int | None = None) -> DataFrame:
    """(trial, w0, i, j, w): correlation of every pair in every window of ``width`` samples, one sample apart; rounded to ``digits``."""
    return _windows(recordings, lambda n: (width, np.arange(max(0, n - width + 1))), digits)


def sliding_fc_strided(recordings: DataFrame, width: int, overlap: float, most: int = 200, digits: int | None = None) -> DataFrame:
    return _windows(recordings, lambda n: kernels.strided(n, width, overlap, most), digits)


def _windows(recordings: DataFrame, windows, digits: int | None) -> DataFrame:
    regions, samples = tiles.shape(recordings)
    return tiles.windows(recordings, *windows(samples), regions, digits=digits)


def fcd_matrix(recordings: DataFrame, width: int, mask: DataFrame | None = None) -> DataFrame:
    """(trial, i, j, w) for windows i < j, one sample apart: correlation of the windows' vectors of pair correlations.

    A mask (i, j) or (trial, i, j) restricts the pairs. NaN where a region is constant or not finite in a window. Recordings of
    under two widths have no rows; it is an error if all are as short.
    """
    long = recordings.filter(F.size("v") >= 2 * width)
    regions, samples = tiles.shape(long)
    if not samples:
        raise ValueError(f"no recording has two windows of {width} samples")
    return _fcd(long, regions, width, np.arange(samples - width + 1), mask)


def fcd_strided(recordings: DataFrame, width: int, overlap: float, most: int = 200, mask: DataFrame | None = None) -> DataFrame:
    regions, samples = tiles.shape(recordings)
    return _fcd(recordings, regions, *kernels.strided(samples, width, overlap, most), mask)


def _fcd(recordings: DataFrame, regions: int, width: int, starts: np.ndarray, mask: DataFrame | None) -> DataFrame:
    if mask is None and len(starts) and len(starts) * width <= tiles.IN_WINDOWS and regions > 2 * width:
        return tiles.correlated(tiles.window_sums(recordings, width, starts), 1e-12)
    vectors = tiles.window_vectors(recordings, width, starts, regions)
    return tiles.window_products(vectors if mask is None else masked(vectors, mask))


def plv_matrix(recordings: DataFrame, block: int = tiles.BLOCK, digits: int | None = None) -> DataFrame:
    """(trial, i, j, w): phase-locking value of each pair, tile by tile; rounded to ``digits``."""

    def phases(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            z = kernels.analytic(x) if len(x) else np.zeros(0, complex)
            return z / np.abs(z) / np.sqrt(len(x))

    return tiles.moduli(recordings, phases, block, digits=digits)


def plv_of_phases(phases: DataFrame) -> DataFrame:
    """The same from a table of phases (trial, region, t, phase), by a pair join."""
    pairs = region_pairs(phases.withColumnRenamed("phase", "v")).withColumn("d", F.col("x") - F.col("y"))
    return pairs.groupBy("trial", "i", "j").agg(F.sqrt(F.pow(F.avg(F.cos("d")), 2) + F.pow(F.avg(F.sin("d")), 2)).alias("w"))


# Masks


def mask_grid(spark, n: int) -> DataFrame:
    """(i, j): all pairs of n regions with i <> j."""
    return spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter("i <> j")


def mask_custom(spark, n: int, indices: list[int]) -> DataFrame:
    if any(not 0 <= x < n for x in indices):
        raise ValueError(f"indices must lie between 0 and {n - 1}")
    return mask_grid(spark, n).filter(F.col("i").isin(indices) & F.col("j").isin(indices))


def mask_named(spark, n: int, name: str) -> DataFrame:
    same = (F.col("i") < n // 2) == (F.col("j") < n // 2)
    named = {"full": F.lit(True), "intrah": same, "interh": ~same}
    if name not in named:
        raise ValueError(f"unknown mask {name}; there are {sorted(named)}")
    return mask_grid(spark, n).filter(named[name])


def _rule(name: str) -> Column:
    """Which pairs (i, j) of n regions a named mask has; the first half of the regions is one hemisphere."""
    same = F.expr("(i < n div 2) = (j < n div 2)")
    named = {"full": F.lit(True), "intrah": same, "interh": ~same}
    if name not in named:
        raise ValueError(f"unknown mask {name}; there are {sorted(named)}")
    return named[name]


def mask_pairs(n: DataFrame, name: str = "full", wanted: Column | None = None) -> DataFrame:
    """(trial, i, j): pairs of each trial's own regions, i <> j, in a named mask; n: (trial, n). ``wanted`` is a further condition on i, j and n.

    A mask's rows i are dealt over tasks before they meet every j, so that no task makes a whole mask.
    """
    up = F.expr("explode(sequence(0, cast(n - 1 as int)))")
    # A stated number of partitions: by size, rows without their j would all be taken into one.
    rows = n.withColumn("i", up).repartition(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trial", "i")
    pairs = rows.withColumn("j", up).filter("i <> j").filter(_rule(name))
    return (pairs if wanted is None else pairs.filter(wanted)).select("trial", "i", "j")


def mask_counts(n: DataFrame) -> DataFrame:
    """(trial, mask, n): how many pairs i <> j each named mask has, by the sizes of a trial's halves; masks without a pair are left out. n: (trial, n)."""
    first = F.expr("cast(n div 2 as bigint)")
    second = F.col("n") - first
    found = {"full": F.col("n") * (F.col("n").cast("long") - 1), "intrah": first * (first - 1) + second * (second - 1), "interh": 2 * first * second}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), v.cast("long").alias("n")) for k, v in found.items()]))
    return n.select("trial", each.alias("e")).select("trial", "e.mask", "e.n").filter("n > 0")


def only_mask(matrix: DataFrame, n: DataFrame, name: str) -> DataFrame:
    """The entries that a named mask of the trial's regions has, without making the mask. n has one row a trial and is broadcast, so that no pair moves."""
    return matrix.join(F.broadcast(n), "trial").filter(_rule(name)).drop("n")


def masked(matrix: DataFrame, mask: DataFrame) -> DataFrame:
    """The entries that a mask (i, j) or (trial, i, j) has."""
    return matrix.join(mask, [c for c in ("trial", "i", "j") if c in mask.columns], "left_semi")


def in_mask(matrix: DataFrame, n: DataFrame, name: str) -> DataFrame:
    """The matrix with zeros where a named mask of the trial's regions has none, without making the mask; NaN stays NaN."""
    return matrix if name == "full" else matrix.join(F.broadcast(n), "trial").withColumn("w", F.when(_rule(name), F.col("w")).otherwise(F.col("w") * 0)).drop("n")


def fc_sum(matrix: DataFrame) -> DataFrame:
    """(trial, value): sum of absolute entries off the diagonal."""
    return matrix.groupBy("trial").agg(unless_nan("w", 2 * F.sum(F.abs("w"))).alias("value"))


def fc_homotopic(matrix: DataFrame, sizes: DataFrame, positive: bool = True, average: bool = True) -> DataFrame:
    """Entries (i, i + n / 2), or their mean. sizes: (trial, n)."""
    kept = matrix.join(sizes, "trial").filter("j = i + n div 2 and i < n div 2").withColumn("w", F.greatest("w", F.lit(0.0)) if positive else F.col("w"))
    return kept.groupBy("trial").agg(F.avg("w").alias("value")) if average else kept.select("trial", "i", F.col("w").alias("value"))


def sizes(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("trial").agg((F.max("region") + 1).alias("n"))


def full(matrix: DataFrame, n: DataFrame) -> DataFrame:
    """All n * n entries: both triangles and a zero diagonal."""
    lower = matrix.select("trial", F.col("j").alias("i"), F.col("i").alias("j"), "w")
    diagonal = n.select("trial", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("trial", "i", F.col("i").alias("j"), F.lit(0.0).alias("w"))
    return matrix.select("trial", "i", "j", "w").unionByName(lower).unionByName(diagonal)


def unless_nan(w: str, aggregate: Column) -> Column:
    """An aggregate that is NaN if a value is NaN or null, as Spark leaves nulls out and takes NaN for the largest number."""
    return F.when(F.max(F.isnan(w) | F.isnull(w)), F.lit(float("nan"))).otherwise(aggregate)


def _seven(w: str = "w") -> list:
    nan = F.lit(float("nan"))
    found = {"sum": F.sum(w), "max": F.max(w), "min": F.min(w), "mean": F.avg(w), "std": F.stddev_pop(w), "skewness": F.coalesce(F.skewness(w), nan), "kurtosis": F.coalesce(F.kurtosis(w), nan)}
    return [unless_nan(w, v).alias(k) for k, v in found.items()]


def stat_ut(matrix: DataFrame, k: int, n: DataFrame | None = None) -> DataFrame:
    """Seven statistics of entries with j >= i + k; k = 0 takes the zero diagonal in and needs n."""
    entries = full(matrix, n).filter("j >= i") if k == 0 else matrix.filter(F.col("j") >= F.col("i") + k)
    return entries.groupBy("trial").agg(*_seven())


def stat_quantile(matrix: DataFrame, n: DataFrame, quantiles: list[float]) -> DataFrame:
    """Quantiles of all n * n entries, the zero diagonal included."""
    return full(matrix, n).groupBy("trial").agg(*[unless_nan("w", F.percentile("w", q)).alias(f"q{q}") for q in quantiles])


def stat_sum(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("trial").agg(unless_nan("w", 2 * F.sum(F.abs("w"))).alias("value"))


def _prepare(kind: str) -> Callable[[np.ndarray], np.ndarray]:
    """What makes the inner products of series their correlations, or covariances."""
    return tiles.unit if kind == "corr" else lambda x: (x - x.mean()) / np.sqrt(len(x) - 1) if len(x) > 1 else np.full(len(x), np.nan)


def _entries(recordings: DataFrame, kind: str, positive: bool, mask: str, fn: Callable, schema: str, aside: DataFrame | None = None) -> DataFrame:
    """fn(values of a chunk of the upper triangle, their i, their j, aside) gives lists of columns: what a matrix of fc_matrix gives without leaving its tiles. aside: (trial, aside), the trial's number
    of regions and what else fn needs. Series are not cut: the longer they are, the fewer make a block."""
    regions, samples = tiles.shape(recordings)
    series = tiles.over_series(recordings, _prepare(kind))
    series = series.join(F.broadcast(sizes(recordings).select("trial", F.array(F.col("n").cast("long")).alias("aside")) if aside is None else aside), "trial")

    def rows(cut, chunks, beside):
        for i, j, a, b, names_a, names_b in chunks:
            w = tiles.of_pairs(a @ b.T, i, j)
            if positive:
                w = np.maximum(w, 0)
            at, to = names_a[i], names_b[j]
            if mask != "full":
                w = w * _pairs_of(mask, at, to, beside[0])
            yield from fn(w, at, to, beside)

    return tiles.chunked(series, regions, [(0, samples)], rows, schema)


def matrix_stats(recordings: DataFrame, k: int = 1, kind: str = "corr", positive: bool = False, mask: str = "full") -> DataFrame:
    """(trial, sum, max, min, mean, std, skewness, kurtosis, total): stat_ut of fc_matrix with zeros outside a mask, and the sum of absolute entries off the diagonal.

    Each chunk of a tile gives its moments about its own mean, which are moved to the trial's mean and added up.
    """

    def moments(w, i, j, _):
        total = np.abs(w).sum()
        w = w[j - i >= k] if k > 1 else w
        n, mean = len(w), w.mean() if len(w) else 0.0
        d = w - mean
        s = d * d
        found = [n, mean, s.sum(), (s * d).sum(), (s * s).sum(), w.max() if n else -np.inf, w.min() if n else np.inf, total]
        yield [np.array([float(f)]) for f in found]

    names = ["n", "m", "m2", "m3", "m4", "hi", "lo", "total"]
    parts = _entries(recordings, kind, positive, mask, moments, ", ".join(f"{c} double" for c in names))
    if k == 0:
        zero = lambda c: F.col("n").cast("double") if c == "n" else F.lit(0.0)
        parts = parts.unionByName(sizes(recordings).select("trial", *[zero(c).alias(c) for c in names]))
    own = Window.partitionBy("trial")
    d, n = F.col("m") - F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own), F.col("n")
    # A trial without entries at k or above has no row.
    moved = parts.withColumn("all", F.sum("n").over(own)).filter(F.col("all") > 0).withColumn("d", d)
    d, m2, m3 = F.col("d"), F.col("m2"), F.col("m3")
    second, third, fourth = F.sum(m2 + n * d * d), F.sum(m3 + 3 * d * m2 + n * d * d * d), F.sum(F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d)
    nan, whole = F.lit(float("nan")), F.sum("n")
    var = second / whole
    found = {"sum": F.sum(n * F.col("m")), "max": F.max("hi"), "min": F.min("lo"), "mean": F.sum(n * F.col("m")) / whole, "std": F.sqrt(F.greatest(var, F.lit(0.0))), "skewness": F.when(var > 0, third / whole / F.pow(var, 1.5)).otherwise(nan), "kurtosis": F.when(var > 0, fourth / whole / (var * var) - 3).otherwise(nan), "total": 2 * F.sum("total")}
    return moved.groupBy("trial").agg(*[F.when(F.max(F.isnan("total")), nan).otherwise(v).alias(name) for name, v in found.items()])


def _order(w: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; equal for values that agree in sign, exponent and nine further bits."""
    bits = (w + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits) >> 43


def matrix_quantiles(recordings: DataFrame, quantiles: list[float], kind: str = "corr", positive: bool = False, mask: str = "full") -> DataFrame:
    """(trial, q...): stat_quantile of fc_matrix with zeros outside a mask, exactly and without sorting or moving the entries.

    Entries are counted by their leading bits first; then only those that share these bits with a wanted entry are counted by value.
    """
    n = sizes(recordings)
    nan = float("nan")

    def counts(w, i, j, _):
        # Both triangles have the entry.
        keys, of_key = np.unique(_order(w[~np.isnan(w)]), return_counts=True)
        yield [np.append(keys, 0), np.append(2 * of_key, 0), np.append(np.zeros(len(keys), bool), np.isnan(w).any())]

    diagonal = n.select("trial", F.lit(0).cast("long").alias("key"), F.col("n").cast("long").alias("c"), F.lit(False).alias("bad"))
    found = _entries(recordings, kind, positive, mask, counts, "key bigint, c bigint, bad boolean").unionByName(diagonal)
    found = found.groupBy("trial", "key").agg(F.sum("c").alias("c"), F.bool_or("bad").alias("bad"))
    by_key = Window.partitionBy("trial").orderBy("key")
    running = found.select("trial", "key", "c", F.sum("c").over(by_key).alias("upto"), F.sum("c").over(Window.partitionBy("trial")).alias("all"), F.bool_or("bad").over(Window.partitionBy("trial")).alias("bad"))
    # The quantile lies between the entries at two places, counted from 0.
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("all") - 1)).alias("at")) for k, q in enumerate(quantiles)]))
    totals = running.groupBy("trial").agg(F.first("all").alias("all"), F.first("bad").alias("bad")).withColumn("q", wanted).select("trial", "bad", "q.k", "q.at")
    places = totals.select("trial", "k", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    hit = running.join(F.broadcast(places), "trial").filter("c > 0 and place < upto and place >= upto - c").select("trial", "k", "at", "place", "key", (F.col("upto") - F.col("c")).alias("before")).persist()  # a few rows a trial, read twice
    keys = n.join(hit.groupBy("trial").agg(F.collect_set("key").alias("keys")), "trial", "left").select("trial", F.concat(F.array(F.col("n").cast("long")), F.coalesce("keys", F.array())).alias("aside"))

    def values(w, i, j, beside):
        w = w[~np.isnan(w)] + 0.0
        w, of_value = np.unique(w[np.isin(_order(w), beside[1:])], return_counts=True)
        if len(w):
            yield [_order(w), w, 2 * of_value]

    zeros = n.select("trial", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("w"), F.col("n").cast("long").alias("c"))
    near = _entries(recordings, kind, positive, mask, values, "key bigint, w double, c bigint", keys).unionByName(zeros).groupBy("trial", "key", "w").agg(F.sum("c").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("trial", "key").orderBy("w")))
    placed = near.join(F.broadcast(hit), ["trial", "key"]).filter("place < before + upto and place >= before + upto - c")
    low, high = F.min_by("w", "place"), F.max_by("w", "place")
    exact = placed.groupBy("trial", "k").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("w"))
    joined = totals.join(exact, ["trial", "k"], "left").withColumn("w", F.when(F.col("bad"), nan).otherwise(F.col("w")))
    return joined.groupBy("trial").agg(*[F.max(F.when(F.col("k") == k, F.col("w"))).alias(f"q{q}") for k, q in enumerate(quantiles)])


def matrix_symmetric(recordings: DataFrame, tol: float = 1e-8) -> DataFrame:
    """(trial, ok): is_symmetric of the full correlation matrix. An entry and its mirror are products of their own, compared in the tile that has both blocks."""
    regions, samples = tiles.shape(recordings)

    def rows(cut, chunks, aside):
        for i, j, a, b, *_ in chunks:
            yield [np.array([bool((np.abs(tiles.of_pairs(a @ b.T, i, j) - (b @ a.T)[j, i]) <= tol).all())])]

    found = tiles.chunked(tiles.over_series(recordings, tiles.unit), regions, [(0, samples)], rows, "ok boolean")
    diagonal = recordings.select("trial", F.lit(True).alias("ok")).distinct()
    return found.unionByName(diagonal).groupBy("trial").agg(F.bool_and("ok").alias("ok"))


def homotopic(recordings: DataFrame, kind: str = "corr", positive: bool = True, average: bool = True) -> DataFrame:
    """fc_homotopic from recordings: each region meets only its counterpart in the other half."""
    n, half = sizes(recordings), F.expr("n div 2")
    series = tiles.over_series(recordings, _prepare(kind)).join(F.broadcast(n), "trial")
    left, right = series.filter(F.col("region") < half), series.filter((F.col("region") >= half) & (F.col("region") < 2 * half))
    right = right.select("trial", (F.col("region") - half).cast("int").alias("i"), F.col("x").alias("y"))
    both = left.select("trial", F.col("region").alias("i"), "x").join(right, ["trial", "i"])
    w = F.when(F.size("x") == F.size("y"), F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(float("nan")))
    kept = both.select("trial", "i", w.alias("w")).withColumn("w", F.greatest("w", F.lit(0.0)) if positive else F.col("w"))
    return kept.groupBy("trial").agg(F.avg("w").alias("value")) if average else kept.select("trial", "i", F.col("w").alias("value"))


def matrix_kernel(recordings: DataFrame, what: str, of: str = "fc", width: int | None = None, positive: bool = False, components: int = 3, mask: str = "full", kind: str = "corrcoef") -> DataFrame:
    """Seven statistics of the eigenvalues ("eig"), or of the PCA scores ("pca"), of each trial's correlation matrix, or that of its windows of ``width`` samples ("fcd"), with a zero diagonal; NaN where an entry is not finite.

    A correlation matrix of more regions than samples is decomposed by its factor, whose size is that of the recording. Others (a mask, positive parts, covariances) need the whole matrix of a trial in one task."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        if of == "fcd":
            i, j = np.triu_indices(len(x), 1)
            kept = _pairs_of(mask, i, j, len(x))
            i, j = i[kept], j[kept]
            x = tiles.sliding_pairs(x, x, width, np.arange(max(0, x.shape[1] - width + 1)), i, j).T
        values = np.full(len(kernels.SEVEN), np.nan)
        if mask == "full" and not positive and (kind == "corrcoef" or of == "fcd") and len(x) > 2 * x.shape[1]:
            found = kernels.thin_stats(x, what, components)
            if found is not None:
                return {k: [v] for k, v in zip(kernels.SEVEN, found)}
        if len(x) > 1 and x.shape[1]:
            a = kernels.correlation(x) if kind == "corrcoef" or of == "fcd" else np.cov(x)
            a = np.maximum(a, 0) if positive else a
            np.fill_diagonal(a, 0)
            if of == "fc":
                a = a * _pairs_of(mask, *np.indices(a.shape), len(a))
            # A matrix with an entry that is not finite has no decomposition.
            if np.isfinite(a).all():
                values = kernels.eigen_stats(a) if what == "eig" else kernels.pca_stats(a, components)
        return {k: [v] for k, v in zip(kernels.SEVEN, values)}

    return kernels.per_trial(recordings, run, ", ".join(f"{k} double" for k in kernels.SEVEN))


def edge_kernel(matrix: DataFrame, what: str, components: int = 3) -> DataFrame:
    """matrix_kernel of a matrix of edges i < j whose size does not grow with the regions, such as that of windows: a trial's edges meet in one task."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        i, j, w = (table.column(c).to_numpy() for c in ("i", "j", "w"))
        a = np.zeros((int(j.max()) + 1,) * 2)
        a[i, j] = a[j, i] = w
        values = (kernels.eigen_stats(a) if what == "eig" else kernels.pca_stats(a, components)) if np.isfinite(a).all() else np.full(len(kernels.SEVEN), np.nan)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), *(pa.array([float(v)]) for v in values)], ["trial", *kernels.SEVEN])

    return matrix.select("trial", "i", "j", "w").groupBy("trial").applyInArrow(run, "trial bigint, " + ", ".join(f"{k} double" for k in kernels.SEVEN))


def _pairs_of(mask: str, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The same rule as ``_rule`` for arrays."""
    same = (i < n // 2) == (j < n // 2)
    return {"full": np.ones(i.shape, bool), "intrah": same, "interh": ~same}[mask]


def fluidity(fcd: DataFrame, k: int) -> DataFrame:
    return fcd.filter(F.col("j") >= F.col("i") + k).groupBy("trial").agg(F.var_pop("w").alias("value"))


def set_k_diagonals(entries: DataFrame, k: int, value: float) -> DataFrame:
    return entries.withColumn("w", F.when(F.abs(F.col("i") - F.col("j")) <= k, F.lit(float(value))).otherwise(F.col("w")))


def is_symmetric(entries: DataFrame, tol: float = 1e-8) -> DataFrame:
    """(trial, ok): every entry equals the mirrored one within tol; a missing mirror counts as unequal."""
    mirror = entries.select("trial", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("m"))
    both = entries.join(mirror, ["trial", "i", "j"], "left")
    return both.groupBy("trial").agg(F.bool_and(F.coalesce(F.abs(F.col("w") - F.col("m")) <= tol, F.lit(False))).alias("ok"))


def csr_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, delay, row_start): edges that weigh, delays in steps plus 2, and where each source's edges start."""
    kept = edges.filter("weight <> 0").withColumn("delay", F.col("length").cast("int") + 2)
    counted = kept.groupBy("src").agg(F.count("*").alias("n"))
    starts = counted.select("src", (F.sum("n").over(Window.orderBy("src")) - F.col("n")).alias("row_start"))
    return kept.join(starts, "src").select("src", "dst", "weight", "delay", "row_start")


def coactivation_degree(signal: DataFrame) -> DataFrame:
    """(trial, region, t, value): z-scored series times the mean of the other regions' ones."""
    z = zscore(signal)
    total = z.groupBy("trial", "t").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return z.join(total, ["trial", "t"]).select("trial", "region", "t", (F.col("v") * F.try_divide(F.col("total") - F.col("v"), F.col("n") - 1)).alias("value"))


def coactivation_phase(recordings: DataFrame) -> DataFrame:
    """(trial, region, value): mean wrapped difference between the phase of the global signal and the region's.

    The global signal is a mean by trial and sample, combined before it moves; each series then meets its trial's one.
    """
    moments = to_signal(recordings).groupBy("trial", "t").agg(F.avg("v").alias("v")).withColumn("region", F.lit(-1))
    whole = to_recordings(moments).select("trial", F.col("v").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        angle = lambda x: np.angle(kernels.analytic(np.asarray(x.values.to_numpy(zero_copy_only=False), float)))
        for batch in batches:
            values = [_mean_wrapped(angle(g), angle(v)) if len(v) else float("nan") for g, v in zip(batch.column("whole"), batch.column("v"))]
            yield pa.RecordBatch.from_arrays([batch.column("trial"), batch.column("region"), pa.array(values, pa.float64())], ["trial", "region", "value"])

    return recordings.join(whole, "trial").select("trial", "region", "v", "whole").mapInArrow(run, "trial bigint, region int, value double")


def _mean_wrapped(one: np.ndarray, other: np.ndarray) -> float:
    n = min(len(one), len(other))
    return float(((one[:n] - other[:n] + np.pi) % (2 * np.pi) - np.pi).mean())
