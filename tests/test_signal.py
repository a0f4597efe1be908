"""Golden rows and properties of the signal operators."""

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import connectivity as C
from spindrift.operators import costs, kernels, states
from spindrift.operators import infotheory as I
from spindrift.operators import posterior as B
from spindrift.operators import registry as G
from spindrift.operators import signal as S
from spindrift.operators import spectral as P
from spindrift.operators import stats as A
from spindrift.sources import files

ONE = [[1, 2, 3, 4, 5]]
TWO = [[1, 2, 3, 4], [5, 6, 7, 8]]
P3, M3 = [[1, 2, 3], [4, 5, 6]], [[-1, 2, -3], [4, -5, 6]]


def recordings(spark, *trials):
    return spark.createDataFrame([(n, r, [float(x) for x in v]) for n, x in enumerate(trials) for r, v in enumerate(x)], "trial long, region int, v array<double>")


def signal(spark, *trials):
    return S.to_signal(recordings(spark, *trials))


def values(df, column="value"):
    return [r[column] for r in df.orderBy("trial", "region").collect()]


GOLDEN = [
    ("abs_energy", ONE, [55]), ("abs_energy", TWO, [30, 174]), ("average_power", ONE, [13.75]), ("average_power", TWO, [10, 58]), ("auc", P3, [4, 10]), ("auc", [[1]], [0]),
    ("calc_var", ONE, [2]), ("calc_var", P3, [0.66666667] * 2), ("calc_std", P3, [0.81649658] * 2), ("calc_std", M3, [2.05480467, 4.78423336]), ("calc_mean", P3, [2, 5]), ("calc_mean", M3, [-0.66666667, 1.66666667]),
    ("calc_centroid", P3, [1.57142857, 1.25974026]), ("calc_centroid", M3, [1.57142857, 1.25974026]), ("calc_kurtosis", P3, [-1.5] * 2), ("calc_kurtosis", M3, [-1.5] * 2),
    ("calc_skewness", [[1, 2, 3, 1], [4, 5, 6, 0]], [0.4933822, -0.83315041]), ("calc_skewness", [[-1, 2, -3, 1], [4, -5, 6, 0]], [-0.27803056, -0.39699236]), ("calc_max", P3, [3, 6]), ("calc_max", M3, [2, 6]), ("calc_min", M3, [-3, -5]),
    ("calc_median", P3, [2, 5]), ("calc_median", M3, [-1, 4]), ("mean_abs_dev", P3, [0.66666667] * 2), ("mean_abs_dev", M3, [1.77777778, 4.44444444]), ("median_abs_dev", P3, [1, 1]), ("median_abs_dev", M3, [2, 2]),
    ("rms", P3, [2.1602469, 5.06622805]), ("rms", M3, [2.1602469, 5.06622805]), ("interq_range", [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]], [2, 2]), ("zero_crossing", [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]], [0, 0]), ("zero_crossing", [[1, 2, -3, 4, 5], [0, 7, -8, 9, 10]], [2, 3]),
]


def test_golden_statistics(spark):
    names = sorted({n for n, _, _ in GOLDEN})
    got = {(r.trial, r.region): r for r in A.region_stats(signal(spark, *[x for _, x, _ in GOLDEN]), names).collect()}
    for trial, (name, x, wanted) in enumerate(GOLDEN):
        assert [got[trial, r][name] for r in range(len(x))] == pytest.approx(wanted, abs=1e-7), name


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_a_trial_that_is_not_finite_is_nan_throughout(spark, bad):
    got = A.region_stats(signal(spark, [[1, 2, bad], [4, 5, 6]], P3), list(A.simple())).filter("trial = 0").collect()
    assert len(got) == 2 and all(math.isnan(r[n]) for r in got for n in A.simple())
    assert A.region_stats(signal(spark, P3).limit(0), ["calc_mean"]).count() == 0


def test_auc_limits(spark):
    got = {(r.interval, r.region): r.value for r in A.auc_limits(signal(spark, P3), [(0, 1), (1, 2), (7, 9)]).collect()}
    assert got == {(0, 0): 1.5, (0, 1): 4.5, (1, 0): 2.5, (1, 1): 5.5}


def test_kernels_equal_plain_formulas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 80))
    r = recordings(spark, x)
    fc = {(e.i, e.j): e.w for e in C.fc_matrix(r).collect()}
    wanted = np.corrcoef(x)
    assert all(fc[i, j] == pytest.approx(wanted[i, j], abs=1e-12) for i in range(5) for j in range(i + 1, 5)) and len(fc) == 10
    joined = {(e.i, e.j): e.w for e in C.fc_join(S.to_signal(r)).collect()}
    assert joined == pytest.approx(fc, abs=1e-9)
    phases = kernels.analytic_signal(r)
    plv = {(e.i, e.j): e.w for e in C.plv_matrix(r).collect()}
    assert {(e.i, e.j): e.w for e in C.plv_of_phases(phases.select("trial", "region", "t", "phase")).collect()} == pytest.approx(plv, abs=1e-9)
    t = np.arange(200) / 100
    wave = kernels.analytic(np.cos(2 * np.pi * 5 * t))
    assert np.abs(wave) == pytest.approx(np.ones(200), abs=1e-9)


def test_identical_recordings_cost_nothing_and_missing_ones_ten(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 100))
    nan = np.full((6, 100), np.nan)
    fc = C.fc_matrix(recordings(spark, x, x, x, x, nan, nan, nan))
    cost = {r.set_id: r.cost for r in costs.fc_cost(fc).collect()}
    assert cost[0] == pytest.approx(0, abs=1e-5) and cost[1] == 10
    ks = {r.set_id: r.cost for r in costs.fcd_ks_cost(C.fcd_matrix(recordings(spark, x, x, x, x, nan, nan, nan), 30), 100).collect()}
    assert ks[0] == pytest.approx(0, abs=1e-9) and ks[1] == 10


def test_filters_pass_their_band(spark):
    t = np.arange(1000) / 100
    slow, fast = np.sin(2 * np.pi * 1 * t), np.sin(2 * np.pi * 20 * t)
    mid = lambda x: np.array(x)[200:800]
    r = recordings(spark, [slow + fast])
    get = lambda **k: mid(kernels.iir_filter(r, 100.0, **k).first().v)
    assert np.abs(get(high_cut=5.0, order=4) - mid(slow)).max() < 0.02
    assert np.abs(get(low_cut=8.0, order=4) - mid(fast)).max() < 0.02
    assert np.abs(get(low_cut=10.0, high_cut=30.0, order=3) - mid(fast)).max() < 0.02
    assert np.abs(get(low_cut=30.0, high_cut=10.0, order=3) - mid(slow)).max() < 0.02
    band = mid(kernels.band_pass(r, 0.5, 2.0, 0.01).first().v)
    assert np.abs(band - mid(slow)).max() < 0.05
    with pytest.raises(ValueError):
        kernels.iir_filter(r, 100.0)


def test_spectrum_finds_a_tone(spark):
    t = np.arange(256) / 64
    spec = P.spectrum(recordings(spark, [np.sin(2 * np.pi * 8 * t) + 3]), 64.0)
    got = P.stats(spec, ["max_frequency", "fundamental_frequency", "spectral_centroid"]).first()
    assert got.max_frequency == 8 and got.fundamental_frequency == 8 and got.spectral_centroid == pytest.approx(8, abs=0.01)
    with pytest.raises(ValueError):
        P.psd_raw(spec, 0.5, [(0, 1)], normalize=True, at_freq=3.0)


def test_information_follows_the_coupling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1200)
    y = np.concatenate([[0], 0.9 * x[:-1] + 0.1 * rng.normal(size=1199)])
    r = recordings(spark, [x, y])
    mi = I.mutual_information(r, [(0, 1)], lag=1).first().value
    te = {(e.source, e.target): e.value for e in I.transfer_entropy(r, [(0, 1), (1, 0)]).collect()}
    assert mi > 0.1 and te[0, 1] > te[1, 0] + 0.1
    h = I.entropy_nearest(S.to_signal(r)).filter("region = 0").first().value
    assert h == pytest.approx(0.5 * math.log2(2 * math.pi * math.e), abs=0.15)


def test_hidden_states_are_found(spark):
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = np.where(truth, 3.0, -3.0) + 0.3 * rng.normal(size=240)
    got = [r.state for r in states.fit_hmm(recordings(spark, [x]), 2, rounds=10).orderBy("t").collect()]
    assert np.mean(np.array(got) == truth) > 0.99


def test_posterior_diagnostics(spark):
    rng = np.random.default_rng(5)
    prior = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(rng.normal(0, 2, 1000))], "sample long, param string, value double")
    post = spark.createDataFrame([(0, i, "a", float(v)) for i, v in enumerate(rng.normal(2.5, 0.5, 1000))], "cond long, sample long, param string, value double")
    assert B.shrinkage(prior, post).first().value == pytest.approx(0.9375, abs=0.03)
    flat = prior.withColumn("value", F.lit(1.0))
    assert B.shrinkage(flat, post).first().value == 0
    assert B.peaks(B.kde(post)).first().value == pytest.approx(2.5, abs=0.25)
    truth = spark.createDataFrame([("a", 2.5)], "param string, truth double")
    assert B.zscores(post, truth).first().value < 0.2
    assert B.zscores(post.withColumn("value", F.lit(1.0)), truth).first().value == math.inf
    with pytest.raises(ValueError):
        B.prior_sample(spark, [("a", 1.0, 1.0)], 5)
    assert B.prior_sample(spark, [("a", 0.0, 1.0)], 50, 3).collect() == B.prior_sample(spark, [("a", 0.0, 1.0)], 50, 3).collect()


def test_conditional_density_recovers_a_linear_model(spark):
    rng = np.random.default_rng(6)
    theta = rng.uniform(-2, 2, 1500)
    x = theta + 1 + 0.1 * rng.normal(size=1500)
    joint = spark.createDataFrame([(float(a), float(b)) for a, b in zip(theta, x)], "p0 double, f0 double")
    mixture = B.mixture_fit(joint, ["p0"], ["f0"], k=3)
    drawn = B.cond_sample(spark.createDataFrame([(0, 1.5)], "cond long, f0 double"), mixture, ["p0"], ["f0"], 2000)
    assert drawn.agg(F.avg("p0")).first()[0] == pytest.approx(0.5, abs=0.1)
    near, far = (r.log_prob for r in B.cond_log_prob(spark.createDataFrame([(0.5, 1.5), (1.5, 1.5)], "p0 double, f0 double"), mixture, ["p0"], ["f0"]).orderBy("p0").collect())
    assert near > far


def test_errors(spark):
    s = signal(spark, P3)
    with pytest.raises(ValueError):
        S.region_select(s, [5])
    with pytest.raises(ValueError):
        A.region_stats(s, ["nothing"])
    with pytest.raises(ValueError):
        C.mask_named(spark, 4, "nothing")
    with pytest.raises(ValueError):
        B.theta_features_join(spark.createDataFrame([(0,)], "trial long"), spark.createDataFrame([(1,)], "trial long"))
    with pytest.raises(ValueError):
        I.pairs_build(spark, [1], [1, 2], "pairwise")


def test_configuration(spark, tmp_path):
    config = G.default_config()
    with pytest.warns(UserWarning):
        assert list(G.by_names(config, ["CALC_mean", "nothing"])["statistical"]) == ["calc_mean"]
    with pytest.raises(ValueError):
        G.update(config, "calc_moments", {"nothing": 1})
    with pytest.raises(ValueError):
        G.by_domain(config, "nothing")
    (tmp_path / "user_features.py").write_text("def span(x, factor=1):\n    return factor * (x.max(axis=1) - x.min(axis=1)), [f'span_{i}' for i in range(len(x))]\n")
    (tmp_path / "user.json").write_text('{"user": {"span": {"parameters": {"factor": 2}, "description": "twice the range"}}}')
    mine = G.add_json({}, str(tmp_path / "user.json"), str(tmp_path / "user_features.py"))
    got = {r.label: r.value for r in G.extract(signal(spark, P3), mine).collect()}
    assert got == {"span_0": 4.0, "span_1": 4.0}
    every = G.extract(signal(spark, np.random.default_rng(7).normal(size=(4, 80)).tolist()), config)
    assert every.filter("value is null").count() == 0
    enabled = {f for features in config.values() for f, v in features.items() if v["use"]}
    assert {r.feature for r in every.select("feature").distinct().collect()} == enabled and len(enabled) >= 40
    assert G.spans(every).count() >= 30 and len(G.wide(every).columns) == every.select("label").distinct().count() + 1


def test_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# weights\n0 1.5\n2 0\n")
    assert sorted(map(tuple, files.matrix_text(spark, str(tmp_path / "w.txt")).collect())) == [(0, 0, 0.0), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 0.0)]
    (tmp_path / "w.csv").write_text("0, 1.5\n2,0\n")
    assert sorted(map(tuple, files.matrix_csv(spark, str(tmp_path / "w.csv")).collect())) == [(0, 0, 0.0), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 0.0)]
    np.savez(tmp_path / "b.npz", bold=np.arange(6.0).reshape(3, 2))
    assert sorted(r.v for r in files.bold_npz(spark, str(tmp_path / "b.npz")).filter("region = 1").collect()) == [1, 3, 5]


def test_entry_module_works_without_the_corpus_operators(spark):
    import importlib

    import __spark_entry__ as entry

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("spindrift.llm")}
    try:
        for missing in ("corpus_pipeline", "spindrift.llm"):
            sys.modules[missing] = None
            assert not [q for q in importlib.reload(entry).queries() if q.startswith("op")]
            del sys.modules[missing]
        if held:
            # A library that is missing is no reason to leave the corpus queries out silently.
            held_library = sys.modules.pop("public_tokenizers")
            sys.modules["public_tokenizers"] = None
            with pytest.raises(ModuleNotFoundError):
                importlib.reload(entry)
            sys.modules["public_tokenizers"] = held_library
    finally:
        for k in [k for k in sys.modules if k == "corpus_pipeline" or k.startswith("spindrift.llm")]:
            del sys.modules[k]
        sys.modules.update(held)
        importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10 if os.path.isdir("/root/testdata/sf0.001") else True
