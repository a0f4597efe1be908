"""Tiled connectivity against whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import connectivity as C
from spindrift.operators import kernels, tiles


def recordings(spark, trials):
    return spark.createDataFrame([(t, r, [float(v) for v in x[r]]) for t, x in trials.items() for r in range(len(x))], "trial long, region int, v array<double>")


def matrix_of(df, n, columns=("w",)):
    out = np.full((n, n), np.inf)
    for r in df.collect():
        out[r.i, r.j] = np.nan if r.w is None else r.w
    return out


def same(got, wanted, n, tol=1e-9):
    i, j = np.triu_indices(n, 1)
    np.testing.assert_allclose(got[i, j], wanted[i, j], atol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(3)
    one, two = rng.normal(size=(11, 60)).cumsum(axis=1), rng.normal(size=(7, 60))
    bad = rng.normal(size=(5, 60))
    bad[1], bad[3, 7] = 2.5, np.nan
    return {0: one, 1: two, 2: bad}


@pytest.mark.parametrize("block, cut", [(256, 1 << 14), (3, 1 << 14), (4, 16), (1, 7)])
def test_matrices_over_tiles_equal_whole_ones(spark, trials, block, cut):
    recs = recordings(spark, trials).repartition(5)
    for t, x in trials.items():
        own = recs.filter(F.col("trial") == t)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = kernels.correlation(x)
            z = kernels.analytic(x)
        same(matrix_of(tiles.products(own, tiles.unit, block, cut), len(x)), corr, len(x))
        if t < 2:
            same(matrix_of(C.fc_matrix(own, kind="cov", block=block), len(x)), np.cov(x), len(x))
            u = z / np.abs(z)
            same(matrix_of(C.plv_matrix(own, block), len(x)), np.abs(u @ u.conj().T) / x.shape[1], len(x))
    together = tiles.products(recs, tiles.unit, block, cut)
    assert together.count() == sum(len(x) * (len(x) - 1) // 2 for x in trials.values())
    assert tiles.products(recs.filter("false"), tiles.unit, block, cut).count() == 0


@pytest.mark.parametrize("block, cut", [(256, 1 << 14), (3, 30)])
@pytest.mark.parametrize("width, hop", [(20, 1), (20, 6), (13, 13), (59, 1)])
def test_windows_over_tiles_equal_whole_ones(spark, trials, block, cut, width, hop):
    x = trials[0]
    starts = np.arange(0, x.shape[1] - width + 1, hop)
    got = tiles.window_vectors(recordings(spark, {0: x}), width, starts, len(x), block, max(cut, width))
    wanted = kernels.sliding(x, width, starts)
    i, j = np.triu_indices(len(x), 1)
    place = {p: k for k, p in enumerate(zip(i.tolist(), j.tolist()))}
    found = np.full(wanted.shape, np.inf)
    for r in got.collect():
        found[r.first : r.first + len(r.f), place[r.i, r.j]] = r.f
    np.testing.assert_allclose(found, wanted, atol=1e-9)
    if len(starts) > 2:
        with np.errstate(invalid="ignore", divide="ignore"):
            same(matrix_of(tiles.window_products(got), len(starts)), kernels.correlation(wanted), len(starts), 1e-8)


def test_running_sums_stay_exact_where_windows_vary_little(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 3000)) * 1e3
    x[0, 400:900], x[1, 1000:1300], x[2, 2000:2400] = 5.0, 1e-3 * rng.normal(size=300), 1e6
    i, j = np.triu_indices(4, 1)
    starts = np.arange(3000 - 50 + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        plain = np.stack([np.where(np.ptp(x[:, s : s + 50], axis=1)[i] * np.ptp(x[:, s : s + 50], axis=1)[j] == 0, np.nan, kernels.correlation(x[:, s : s + 50])[i, j]) for s in starts]).T
    np.testing.assert_allclose(tiles.sliding_pairs(x, x, 50, starts, i, j), plain, atol=1e-9, equal_nan=True)
    assert np.isnan(plain).sum() > 1000


def test_one_trial_is_many_tasks_and_the_width_costs_nothing(spark):
    rng = np.random.default_rng(2)
    recs = recordings(spark, {0: rng.normal(size=(40, 50))})
    series = tiles.over_series(recs, tiles.unit)
    for block, groups in ((10, 10), (256, 3)):
        seen = tiles.tiles(series, 40, [(0, 50)], lambda cut, i, j, a, b: [np.full(len(i), len(a) * 100 + len(b), float)], "w double", block)
        size = tiles.block_size(40, block)
        assert seen.select((F.floor(F.col("i") / size) * 1000 + F.floor(F.col("j") / size)).alias("tile")).distinct().count() == groups
        assert seen.agg(F.max("w")).first()[0] == size * 101
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = C.fc_matrix(recs, block=10).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert per_task > 1


def test_masks_restrict_the_pairs_of_windows(spark, trials):
    x = trials[0]
    mask = spark.createDataFrame([(0, 3), (2, 9), (4, 5), (1, 10), (6, 7)], "i int, j int")
    got = C.fcd_matrix(recordings(spark, {0: x}), 20, mask)
    vectors = kernels.sliding(x, 20, np.arange(41))
    keep = [p in {(r.i, r.j) for r in mask.collect()} for p in zip(*(g.tolist() for g in np.triu_indices(len(x), 1)))]
    same(matrix_of(got, 41), kernels.correlation(vectors[:, keep]), 41, 1e-8)


def test_recordings_that_cannot_be_decomposed_are_nan(spark, trials):
    short = {5: np.ones((3, 2))}
    for of, width in (("fc", None), ("fcd", 20)):
        for what in ("eig", "pca"):
            rows = {r.trial: r.std for r in C.matrix_kernel(recordings(spark, trials | short), what, of, width).collect()}
            assert np.isnan(rows[2]) and np.isnan(rows[5]) and np.isfinite(rows[0]) and np.isfinite(rows[1])
    assert {r.trial for r in C.fcd_matrix(recordings(spark, trials | short), 20).select("trial").distinct().collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        C.fcd_matrix(recordings(spark, short), 20)
