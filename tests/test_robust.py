"""Bad series, parameters of the configuration, and estimators against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import infotheory, kernels, spectral, states
from spindrift.operators import registry as G
from spindrift.operators import signal as S


def recordings(spark, trials):
    return spark.createDataFrame([(t, r, [None if v is None else float(v) for v in x[r]]) for t, x in trials.items() for r in range(len(x))], "trial long, region int, v array<double>")


def test_bad_series_give_nan_and_leave_other_trials_alone(spark):
    """A NaN, an infinite and a null sample, a constant, a short and an empty series."""
    rng = np.random.default_rng(5)
    good = rng.normal(size=(4, 80))
    config = G.update(G.update(G.default_config(), "hmm_stat", {"n_iter": 3, "starts": 1}), "fcd_stat", {"width": 30})
    for features in config.values():
        for entry in features.values():
            entry["use"] = True
    alone = {(r.label): r.value for r in G.extract(S.to_signal(recordings(spark, {0: good})), config).collect()}
    trials = {0: good} | {t: rng.normal(size=(4, 80)) for t in (1, 2, 3, 4)} | {5: rng.normal(size=(4, 20)), 6: np.zeros((4, 0))}
    trials[1][2, 7], trials[2][0, 0], trials[4][1] = np.nan, -np.inf, 3.0
    trials[3] = trials[3].tolist()
    trials[3][1][5] = None
    got = {}
    for r in G.extract(S.to_signal(recordings(spark, trials)), config).collect():
        got.setdefault(r.trial, {})[r.label] = r.value
    same = lambda a, b: a == pytest.approx(b, abs=1e-9, nan_ok=True)
    assert set(got[0]) == set(alone) and all(same(got[0][k], v) for k, v in alone.items() if v is not None)
    for t in (1, 2, 3):
        # Which states follow each other depends on the path; every other label is there.
        assert {k for k in alone if "transition" not in k} <= set(got[t])
        assert all(v is not None and math.isnan(v) for v in got[t].values())
    for label in ("fc_sum", "fc_stat_mean", "fc_stat_max", "fc_stat_min", "fc_stat_eig_sum", "fc_stat_pca_std", "fc_stat_q50", "fcd_stat_std", "fcd_stat_eig_mean"):
        assert math.isnan(got[4][label]), label
    assert same(got[4]["calc_mean_1"], 3.0) and math.isfinite(got[4]["calc_mean_0"]) and math.isfinite(got[4]["spectral_centroid_0"])
    assert math.isnan(got[5]["fcd_stat_mean"]) and math.isfinite(got[5]["calc_mean_3"]) and 6 not in got


def test_kernels_take_short_and_empty_series(spark):
    rows = recordings(spark, {0: np.zeros((1, 0)), 1: np.ones((1, 3)), 2: np.ones((1, 1))})
    assert {r.trial for r in kernels.spectrum(rows).collect()} == {1, 2}
    assert {r.trial for r in kernels.spectrum(rows, method="welch").collect()} == {1, 2}
    assert all(np.isnan(kernels.lpc(np.array(x))).all() for x in ([], [1.0, 2.0, 4.0], [np.nan] * 40))
    assert kernels.nearest([np.arange(3.0)], 2).shape == (3, 2) and np.isnan(kernels.ksg_mi(np.arange(4.0), np.arange(4.0)))


def test_parameters_reach_the_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 70)).cumsum(axis=1)
    signal = S.to_signal(recordings(spark, {0: x}))

    def run(name, **parameters):
        config = G.update(G.by_names(G.default_config(), name), name, parameters)
        return {r.label: r.value for r in G.extract(signal, {d: {f: {**e, "use": True} for f, e in fs.items()} for d, fs in config.items()}, fs=2.0).collect()}

    assert run("calc_mean", indices=[1, 3]) == pytest.approx({f"calc_mean_{i}": x[i].mean() for i in (1, 3)})
    step = np.diff(x, axis=1).max()
    assert set(run("seizure_onset", threshold=float(step) + 1).values()) == {0.0} and any(run("seizure_onset", threshold=1e-9).values())
    at = np.sort(rng.uniform(size=70)).tolist()
    assert run("auc", x=at) == pytest.approx({f"auc_{i}": np.trapezoid(x[i], at) for i in range(5)})
    assert run("auc", dx=0.5) == pytest.approx({f"auc_{i}": np.trapezoid(x[i], dx=0.5) for i in range(5)})
    assert run("average_power", fs=10.0)["average_power_0"] == pytest.approx((x[0] ** 2).sum() / (69 / 10))
    assert run("max_frequency", indices=[2], fs=7.0)["max_frequency_2"] == pytest.approx(7.0 * np.abs(np.fft.rfft(x[2] - x[2].mean())).argmax() / 70)
    cov, i, j = np.cov(x), *np.triu_indices(5, 1)
    got = run("fc_stat", fc_function="cov", features=["sum", "max"], eigenvalues=False, pca_num_components=0, quantiles=None, k=1)
    assert got == pytest.approx({"fc_stat_sum": cov[i, j].sum(), "fc_stat_max": cov[i, j].max()})
    between = np.where((np.arange(5) < 2)[:, None] == (np.arange(5) < 2), 0, np.corrcoef(x))
    got = run("fc_stat", masks=["interh"], quantiles=[0.5])
    assert got["fc_stat_interh_eig_mean"] == pytest.approx(np.sort(np.linalg.eigvalsh(between))[1:].mean()) and got["fc_stat_interh_q50"] == pytest.approx(np.median(between))
    assert got["fc_stat_interh_mean"] == pytest.approx(between[i, j].mean()) and got["fc_stat_interh_std"] == pytest.approx(between[i, j].std())
    vectors = kernels.sliding(x, 20, np.arange(51))
    keep = (i < 2) == (j < 2)
    fcd = np.corrcoef(vectors[:, keep])
    a, b = np.triu_indices(51, 20)
    got = run("fcd_stat", TR=0.5, win_len=10, masks=["intrah"], quantiles=None)
    assert got["fcd_stat_intrah_mean"] == pytest.approx(fcd[a, b].mean()) and "fcd_stat_intrah_eig_std" in got
    assert run("entropy_bin", prob="gauss").keys() == {f"entropy_bin_{i}" for i in range(5)} and len(run("entropy_bin", prob="kde", average=True)) == 1
    with pytest.raises(ValueError):
        run("entropy_bin", prob="other")
    assert len(run("catch22", catch24=True, features=["DN_HistogramMode_5"], indices=[0])) == 3
    assert len(run("wavelet_energy", widths=[2, 5])) == 10 and len(run("coactivation_phase")) == 5 and len(run("spectral_spread", indices=[4])) == 1
    mi = run("calc_mi", source_indices=[0, 1], target_indices=[2, 3], num_surrogates=2, time_diff=1)
    null = np.mean([max(0, kernels.ksg_mi(np.random.default_rng([0, k]).permutation(x[0][:-1]), x[2][1:])) for k in (1, 2)])
    assert mi["calc_mi_0_2"] == pytest.approx(max(0, max(0, kernels.ksg_mi(x[0][:-1], x[2][1:])) - null) * 1.4427)
    assert set(run("calc_te", average=True)) == {"calc_te"}


def apart(x):
    d = np.abs(x[:, None] - x[None])
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("digits", [None, 1, 0])
@pytest.mark.parametrize("n", [6, 40, 600])
def test_nearest_neighbours_equal_all_pairs(n, digits):
    rng = np.random.default_rng(n)
    x, y, z = rng.normal(size=(3, n))
    y = y + x
    if digits is not None:
        x, y, z = (np.round(a, digits) for a in (x, y, z))
    d = np.max([apart(a) for a in (x, y, z)], axis=0)
    assert (np.sort(kernels.nearest([x, y, z], 3), axis=1) == np.sort(np.argsort(d, axis=1, kind="stable")[:, :3], axis=1)).all()
    psi = kernels._harmonic(n + 1)
    dx, dy = apart(x), apart(y)
    near = np.argsort(np.maximum(dx, dy), axis=1, kind="stable")[:, :4]
    ex, ey = np.take_along_axis(dx, near, 1).max(1), np.take_along_axis(dy, near, 1).max(1)
    assert kernels.ksg_mi(x, y) == pytest.approx(psi[4] - 0.25 - (psi[(dx <= ex[:, None]).sum(1)] + psi[(dy <= ey[:, None]).sum(1)]).mean() + psi[n])


def plain_likelihood(x, start, step, mean, cov):
    alpha, total = None, 0.0
    for row in x:
        b = np.array([math.exp(-0.5 * (row - m) @ np.linalg.solve(c, row - m)) / math.sqrt((2 * math.pi) ** len(row) * np.linalg.det(c)) for m, c in zip(mean, cov)])
        alpha = (start if alpha is None else alpha @ step) * b
        total += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
    return total


def test_hidden_states_of_several_regions(spark):
    rng = np.random.default_rng(9)
    states_of = {t: np.repeat(rng.permutation([0, 1, 2, 0, 2, 1, 0]), 25) for t in range(3)}
    centres = np.array([[-3, 0, 1, 0], [0, 3, 0, 1], [3, -3, 1, 1]], float)
    trials = {t: (centres[z] + 0.5 * rng.normal(size=(175, 4))).T for t, z in states_of.items()}
    trials[1][3, 4] = np.nan
    got = {}
    for r in states.fit_trials(recordings(spark, trials | {3: np.full((2, 5), np.nan)}), 3, 60).collect():
        got.setdefault(r.trial, {})[r.t] = r.state
    assert set(got) == {0, 1, 2}
    for t, z in states_of.items():
        assert [got[t][k] for k in range(175)] == z.tolist()
    # The sums of one round equal plain ones, for two models at once.
    x = trials[0].T[:40]
    mean, start = rng.normal(size=(2, 3, 4)), np.full((2, 3), 1 / 3)
    step = rng.dirichlet(np.ones(3), size=(2, 3))
    root = rng.normal(size=(2, 3, 4, 4))
    cov = np.einsum("skij,sklj->skil", root, root) + np.eye(4)
    log_b = states._log_normal(x, mean, cov)
    gamma, both, likelihood = states._posterior(log_b, start, step)
    assert likelihood == pytest.approx([plain_likelihood(x, start[s], step[s], mean[s], cov[s]) for s in (0, 1)])
    assert gamma.sum(axis=2) == pytest.approx(np.ones((2, 40))) and both.sum(axis=(1, 2)) == pytest.approx([39, 39]) and both.sum(axis=2) == pytest.approx(gamma[:, :-1].sum(axis=1))
    likely = [states.fit_path(x, 3, rounds, 4, 1)[1] for rounds in (1, 3, 10, 40)]
    assert all(a <= b + 1e-6 for a, b in zip(likely, likely[1:]))


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_pooled_entropies_are_those_of_all_samples(spark, buckets):
    rng = np.random.default_rng(2)
    trials = {0: rng.normal(size=(3, 50)), 1: np.round(rng.normal(size=(2, 30)), 1), 2: np.ones((1, 4))}
    signal = S.to_signal(recordings(spark, trials))
    got = {r.trial: r.value for r in infotheory.entropy_pooled(signal, buckets).collect()}
    for t, x in trials.items():
        one = S.to_signal(recordings(spark, {t: x.reshape(1, -1)}))
        assert got[t] == pytest.approx(infotheory.entropy_nearest(one).first().value)
    both = {(r.trial, r.region): r.value for r in infotheory.entropy_levels(signal, 1).collect()}
    for t, x in trials.items():
        assert both[t, None] == pytest.approx(infotheory.entropy_bin(S.to_signal(recordings(spark, {t: x.reshape(1, -1)})), 1).first().value)
    single = {(r.trial, r.region): r.value for r in infotheory.entropy_bin(signal, 1).collect()}
    assert {k: v for k, v in both.items() if k[1] is not None} == pytest.approx(single)


def test_levels_of_spectra_are_one_shuffle(spark):
    recs = recordings(spark, {0: np.random.default_rng(1).normal(size=(3, 16))})
    spec = kernels.spectrum(recs)
    got = spectral.levels(spec)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" in plan
    mean = {r.k: r.mag for r in spectral.average(spec).collect()}
    assert {r.k: r.mag for r in got.filter("region is null").collect()} == pytest.approx(mean)
    assert got.filter(F.col("region").isNotNull()).count() == spec.count()
