"""What must not grow with the pairs of regions: plans and counts of rows, and results against plain ones."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import connectivity as C
from spindrift.operators import registry as G
from spindrift.operators import signal as S
from spindrift.operators import kernels, states, tiles


def recordings(spark, trials):
    return spark.createDataFrame([(t, r, [float(v) for v in x[r]]) for t, x in trials.items() for r in range(len(x))], "trial long, region int, v array<double>")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(5)
    bad = rng.normal(size=(41, 40))
    bad[3, :25], bad[7, 39] = 2.0, np.nan
    return {0: rng.normal(size=(45, 40)), 1: rng.normal(size=(30, 40)).cumsum(axis=1), 2: bad, 3: rng.normal(size=(1, 40)), 4: rng.normal(size=(2, 40))}


def test_masks_are_dealt_over_tasks_and_counted_without_being_made(spark, trials):
    n = C.sizes(recordings(spark, trials)).coalesce(1)
    pairs = C.mask_pairs(n, "intrah")
    # Half of one trial's mask in every task would still be a share that grows; rows are dealt one by one.
    assert pairs.filter("trial = 0").groupBy(F.spark_partition_id()).count().count() > 1
    wanted = {(r.trial, m): r["count"] for m in ("full", "intrah", "interh") for r in C.mask_pairs(n, m).groupBy("trial").count().collect()}
    counts = C.mask_counts(n)
    assert {(r.trial, r["mask"]): r.n for r in counts.collect()} == wanted and "sequence" not in plan(counts)


def test_a_named_mask_needs_no_join_of_pairs(spark, trials):
    recs = recordings(spark, trials)
    fc = C.fc_matrix(recs)
    got = C.only_mask(fc, C.sizes(recs), "interh")
    assert "SortMergeJoin" not in plan(got)
    rows = lambda df: {(r.trial, r.i, r.j) for r in df.collect()}
    assert rows(got) == rows(C.masked(fc, C.mask_pairs(C.sizes(recs), "interh")))


@pytest.mark.parametrize("width, hop", [(10, 1), (10, 7), (12, 4)])
def test_products_of_windows_without_pairs_equal_those_over_pairs(spark, trials, monkeypatch, width, hop):
    starts = np.arange(0, 40 - width + 1, hop)
    recs = recordings(spark, trials | {5: np.random.default_rng(1).normal(size=(9, 31))})
    quick = tiles.correlated(tiles.window_sums(recs, width, starts, rows=16), 1e-12)
    slow = tiles.window_products(tiles.window_vectors(recs, width, starts, 45, block=20))
    got, wanted = ({(r.trial, r.i, r.j): r.w for r in df.collect()} for df in (quick, slow))
    assert got.keys() == wanted.keys() and {k[0] for k in got} == {0, 1, 2, 4, 5}
    np.testing.assert_allclose([got[k] for k in wanted], list(wanted.values()), atol=1e-9, equal_nan=True)
    assert np.isnan(list(wanted.values())).any() and np.isfinite(list(wanted.values())).any()
    # The query takes this way where regions are many, and so makes no row a pair.
    monkeypatch.setattr(tiles, "window_vectors", None)
    assert C.fcd_matrix(recs, 10).count()


def test_a_tile_of_many_pairs_leaves_in_chunks(spark, trials, monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK", 100)
    x = recordings(spark, {0: trials[0]})
    out = tiles.tiles(tiles.over_series(x, tiles.unit), 45, [(0, 40)], lambda cut, i, j, a, b: [tiles.of_pairs(a @ b.T, i, j)], "w double", 23)
    found = {(r.i, r.j): r.w for r in out.collect()}
    corr = kernels.correlation(trials[0])
    assert found == pytest.approx({(i, j): corr[i, j] for i in range(45) for j in range(i + 1, 45)})


@pytest.mark.parametrize("mask, kind, positive", [("full", "corr", False), ("interh", "cov", False), ("intrah", "corr", True)])
def test_statistics_inside_tiles_equal_those_of_the_matrix(spark, trials, monkeypatch, mask, kind, positive):
    monkeypatch.setattr(tiles, "CHUNK", 200)
    recs = recordings(spark, trials)
    n = C.sizes(recs)
    matrix = C.in_mask(C.fc_matrix(recs, kind, positive), n, mask)
    same = lambda a, b: all(x == pytest.approx(y, abs=1e-9, nan_ok=True) for x, y in zip(a, b, strict=True))
    for k in (0, 1, 5):
        wanted = {r.trial: list(r)[1:] for r in C.stat_ut(matrix, k, n).collect()}
        got = {r.trial: list(r)[1:-1] for r in C.matrix_stats(recs, k, kind, positive, mask).collect()}
        assert got.keys() == wanted.keys() and all(same(got[t], wanted[t]) for t in wanted)
    quantiles = [0.0, 0.05, 0.5, 0.77, 1.0]
    wanted = {r.trial: list(r)[1:] for r in C.stat_quantile(matrix, n, quantiles).collect()}
    found = C.matrix_quantiles(recs, quantiles, kind, positive, mask)
    got = {r.trial: list(r)[1:] for r in found.collect()}
    # A trial of one region has its diagonal only.
    assert got.keys() == wanted.keys() and all(same(got[t], wanted[t]) for t in wanted)
    assert "percentile" not in plan(found)


def test_counterparts_mirrors_and_factors_need_no_pairs(spark, trials, monkeypatch):
    recs = recordings(spark, trials | {9: np.random.default_rng(8).normal(size=(90, 20))})
    n, fc = C.sizes(recs), C.fc_matrix(recs)
    cells = lambda df: {(r.trial, r.i): r.value for r in df.collect()}
    assert cells(C.homotopic(recs, average=False)) == pytest.approx(cells(C.fc_homotopic(fc, n, average=False)), nan_ok=True)
    ok = lambda df: {r.trial: r.ok for r in df.collect()}
    assert ok(C.matrix_symmetric(recs)) == ok(C.is_symmetric(C.full(fc, n)))
    x = np.random.default_rng(8).normal(size=(90, 20))
    a = kernels.correlation(x)
    np.fill_diagonal(a, 0)
    monkeypatch.setattr(kernels, "correlation", None)
    own = recs.filter("trial = 9")
    for what, plain in (("eig", kernels.eigen_stats), ("pca", kernels.pca_stats)):
        np.testing.assert_allclose(list(C.matrix_kernel(own, what).first())[1:], plain(a), atol=1e-8)


def test_pairs_of_long_signals_meet_in_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(0, r, t, None if r == 1 and t == 3 else 2.0 if r == 4 else float(rng.normal())) for r in range(6) for t in range(12) if (r + t) % 5]
    sig = spark.createDataFrame(rows, "trial long, region int, t int, v double")
    met = C.region_pairs(sig)
    plain = {(r.i, r.j): r.value for r in met.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value")).collect()}
    got = C.inner_products(sig)
    assert {(r.i, r.j): r.value for r in got.collect()} == pytest.approx(plain) and "Join" not in plan(got)
    z = C.region_pairs(C.zscore(sig))
    plain = {(r.i, r.j): r.w for r in z.groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("w")).collect()}
    got = {(r.i, r.j): r.w for r in C.fc_join(sig).collect()}
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k]) if plain[k] is not None else got[k] is None for k in plain)
    odd, even = sig.filter("region % 2 = 1"), sig.filter("region % 2 = 0")
    a, b = odd.selectExpr("t", "region i", "v x"), even.selectExpr("t", "region j", "v y")
    plain = {(r.i, r.j): r.w for r in a.join(b.filter("j <> 4"), "t").groupBy("i", "j").agg(F.corr("x", "y").alias("w")).collect()}
    got = {(r.i, r.j): r.w for r in C.corr_between(odd, even).collect()}
    # A constant side has no correlation.
    assert {k for k in got if k[1] != 4} == plain.keys() and all(got[k] == pytest.approx(plain[k]) for k in plain)


def test_state_paths_of_many_regions_keep_to_the_samples():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 4000))[np.repeat([0, 1, 2, 0, 1], 8)] * 2 + rng.normal(size=(40, 4000))
    # A covariance of 4,000 regions a state and start would take over a GB.
    path, likelihood = states.fit_path(x, 3, 20, 3, 0)
    assert np.isfinite(likelihood) and len(path) == 40
    turned, _ = states._thin(x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert turned.shape == (40, 40)
    np.testing.assert_allclose(turned @ turned.T, z @ z.T, atol=1e-6)
    several = rng.normal(size=(6, 30))
    model = np.full(2, 0.5), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([-1.0, 1.0]), np.ones(2)
    for k, (gamma, both, one) in enumerate(zip(*kernels.forward_backward(several, *model))):
        alone = kernels.forward_backward(several[k], *model)
        np.testing.assert_allclose(gamma, alone[0]), np.testing.assert_allclose(both, alone[1])
        assert one == pytest.approx(alone[2]) and (kernels.viterbi(several, *model)[k] == kernels.viterbi(several[k], *model)).all()


def test_cells_need_no_columns_and_rows_are_numbered_in_ranges(spark):
    features = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "b", None), (2, "c", 3.0)], "trial long, label string, value double")
    wide = G.wide(features).unpivot(["trial"], ["a", "b", "c"], "label", "value")
    assert sorted(map(str, G.cells(features).collect())) == sorted(map(str, wide.collect()))
    keys = np.random.default_rng(3).integers(0, 50, 400).tolist()
    df = spark.createDataFrame([("x" if k % 3 else None, None if i % 90 == 0 else k, i) for i, k in enumerate(keys)], "flag string, key long, line long")
    got, wanted = S.number_rows(df, "flag", ["key", "line"], rows=40), S.number_regions(df, "flag", F.struct("key", "line"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in wanted.collect()}
    assert "_range" in plan(got)


def test_features_of_many_regions_hold_no_matrix_of_them_in_a_task(spark, monkeypatch):
    plain, taken = kernels.per_trial, spark.sparkContext.accumulator(0)

    def watched(recs, fn, schema):
        def run(x):
            tracemalloc.start()
            found = fn(x)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            taken.add(1)
            # A matrix of 1,200 regions takes 11.5 MB, the recording 0.6.
            assert peak < 8e6, f"{peak / 1e6:.0f} MB"
            return found

        return plain(recs, run, schema)

    for module in (kernels, states):
        monkeypatch.setattr(module, "per_trial", watched)
    signal = S.to_signal(recordings(spark, {0: np.random.default_rng(2).normal(size=(1200, 64))}))
    config = G.by_domain(G.default_config(), ["connectivity", "hmm"])
    found = G.extract(signal, config).filter("not isnan(value)").select("feature").distinct().collect()
    assert {r.feature for r in found} == {"fc_sum", "fc_stat", "fc_homotopic", "fcd_stat", "hmm_stat"}
    assert taken.value >= 3  # states, eigenvalues and components
