"""Queries without SQL against plain versions: loops over samples, direct transforms and small linear systems."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import catch22, connectivity, infotheory, kernels, posterior, spectral, states, stats
from spindrift.operators import registry as G
from spindrift.operators import signal as S

RNG = np.random.default_rng(5)
SERIES = [RNG.normal(size=60), np.cumsum(RNG.normal(size=90)), np.sin(np.arange(200) / 31.0) + 0.01 * RNG.normal(size=200), np.arange(80.0), RNG.exponential(size=128)]


def table(spark, rows):
    """A trial of equally long rows as recordings."""
    return spark.createDataFrame([(0, i, [float(x) for x in r]) for i, r in enumerate(rows)], "trial long, region int, v array<double>")


def z(x):
    m = sum(x) / len(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / len(x))
    return [(v - m) / s for v in x]


def plain_acf(x):
    m = sum(x) / len(x)
    d = [v - m for v in x]
    power = sum(v * v for v in d)
    return [sum(d[i] * d[i + k] for i in range(len(d) - k)) / power for k in range(len(d))]


def plain_first_zero(x):
    return next((k for k, a in enumerate(plain_acf(x)) if a <= 0), len(x))


def plain_rectangular(x):
    """Angular frequencies and one-sided power of the demeaned series, by a direct transform."""
    n, m = len(x), sum(x) / len(x)
    power = []
    for k in range(n // 2 + 1):
        c = sum((v - m) * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x))
        power.append(abs(c) ** 2 / n * (1 if k == 0 or 2 * k == n else 2) / (2 * math.pi))
    return [2 * math.pi * k / n for k in range(n // 2 + 1)], power


def plain_e_crossing(x):
    a = plain_acf(x)
    for k in range(len(a) - 1):
        if a[k + 1] < math.exp(-1):
            return k + (math.exp(-1) - a[k]) / (a[k + 1] - a[k])
    return len(x)


def plain_first_minimum(x):
    a = plain_acf(x)
    return next((k for k in range(1, len(a) - 1) if a[k] < a[k - 1] and a[k] < a[k + 1]), len(x))


def plain_residual_ratio(x):
    return plain_first_zero([b - a for a, b in zip(x, x[1:])]) / plain_first_zero(x)


def plain_transitions(x):
    y = x[:: max(1, plain_first_zero(x))]
    order = sorted(range(len(y)), key=lambda i: (y[i], i))
    letter = {at: rank * 3 // len(y) for rank, at in enumerate(order)}
    share = [[sum(letter[i] == a and letter[i + 1] == b for i in range(len(y) - 1)) / max(1, len(y) - 1) for b in range(3)] for a in range(3)]
    columns = [[row[b] for row in share] for b in range(3)]
    return sum(sum((v - sum(c) / 3) ** 2 for v in c) / 2 for c in columns)


def plain_outliers(x):
    n, found, level = len(x), [], 0.0
    for step in range(10_000):
        level = step * 0.01
        at = [i + 1 for i, v in enumerate(x) if v >= level]
        if len(at) < max(2, 0.02 * n):
            break
        found.append(float(np.median(at)) / (n / 2) - 1)
    return float(np.median(found)) if found else 0.0


def plain_low_power(x):
    w, p = plain_rectangular(x)
    return sum(p[: len(p) // 5]) * (w[1] - w[0])


def plain_power_centre(x):
    w, p = plain_rectangular(x)
    running = 0.0
    for f, v in zip(w, p):
        running += v
        if running > sum(p) / 2:
            return f


def plain_embedding(x):
    tau = min(plain_first_zero(x), max(1, len(x) // 10))
    d = [math.hypot(x[i + 1] - x[i], x[i + 1 + tau] - x[i + tau]) for i in range(len(x) - tau - 1)]
    mean = sum(d) / len(d)
    std = math.sqrt(sum((v - mean) ** 2 for v in d) / len(d))
    n = max(1, math.ceil((max(d) - min(d)) / (3.5 * std / len(d) ** (1 / 3))))
    width = (max(d) - min(d)) / n
    count = [0] * n
    for v in d:
        count[min(n - 1, int((v - min(d)) / width))] += 1
    return sum(abs(c / len(d) - math.exp(-(min(d) + (k + 0.5) * width) / mean) / mean) for k, c in enumerate(count)) / n


def plain_line(xs, ys):
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / sum((a - mx) ** 2 for a in xs)
    return [b - my - slope * (a - mx) for a, b in zip(xs, ys)]


def plain_fluctuation(x, how):
    m, y, total = sum(x) / len(x), [], 0.0
    for v in x:
        total += v - m
        y.append(total)
    sizes = sorted({round(5 * (max(5, len(x) // 2) / 5) ** (i / 49)) for i in range(50)})
    if len(sizes) < 12:
        return 0.0
    logs = []
    for s in sizes:
        flat = [plain_line(list(range(s)), y[b * s : (b + 1) * s]) for b in range(len(y) // s)]
        logs.append(math.log(sum(max(f) - min(f) for f in flat) / len(flat)) if how == "range" else 0.5 * math.log(sum(v * v for f in flat for v in f) / (len(flat) * s)))
    lx, n = [math.log(s) for s in sizes], len(sizes)
    miss = lambda a, b: math.sqrt(sum(v * v for v in plain_line(lx[a:b], logs[a:b])))
    errors = [miss(0, i) + miss(i - 1, n) for i in range(6, n - 5)]
    return (min(range(len(errors)), key=errors.__getitem__) + 6) / n


def plain_periodicity(x):
    t = [-1 + 2 * i / (len(x) - 1) for i in range(len(x))]
    basis = np.array([[1, v, v * v, v**3, *(max(v - k, 0) ** 3 for k in (-1 / 3, 1 / 3))] for v in t])
    weights = np.linalg.solve(basis.T @ basis, basis.T @ np.array(x))
    a = plain_acf(list(np.array(x) - basis @ weights))[: max(2, len(x) // 3 + 1)]
    trough = None
    for i in range(1, len(a) - 1):
        if a[i] < a[i - 1] and a[i] < a[i + 1]:
            trough = i
        if a[i] > a[i - 1] and a[i] > a[i + 1] and a[i] > 0 and trough is not None and a[i] - a[trough] > 0.01:
            return i
    return 0


PLAIN = {
    "CO_f1ecac": plain_e_crossing,
    "CO_FirstMin_ac": plain_first_minimum,
    "FC_LocalSimple_mean1_tauresrat": plain_residual_ratio,
    "SB_TransitionMatrix_3ac_sumdiagcov": plain_transitions,
    "DN_OutlierInclude_p_001_mdrmd": plain_outliers,
    "DN_OutlierInclude_n_001_mdrmd": lambda x: plain_outliers([-v for v in x]),
    "SP_Summaries_welch_rect_area_5_1": plain_low_power,
    "SP_Summaries_welch_rect_centroid": plain_power_centre,
    "PD_PeriodicityWang_th0_01": plain_periodicity,
    "CO_Embed2_Dist_tau_d_expfit_meandiff": plain_embedding,
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": lambda x: plain_fluctuation(x, "range"),
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": lambda x: plain_fluctuation(x, "dfa"),
}


@pytest.mark.parametrize("name", list(PLAIN))
def test_characteristics_equal_plain_loops(spark, name):
    assert set(PLAIN) == set(catch22.SERIES_KERNELS)
    recordings = spark.createDataFrame([(i, 0, [float(v) for v in x]) for i, x in enumerate(SERIES)], "trial long, region int, v array<double>")
    got = {r.trial: r.value for r in catch22.feature(name, S.to_signal(recordings), recordings).collect()}
    assert [got[i] for i in range(len(SERIES))] == pytest.approx([PLAIN[name](z(list(map(float, x)))) for x in SERIES], rel=1e-6, abs=1e-9)


def test_lags_beyond_forty_count(spark):
    slow = np.cos(np.arange(400) * 2 * math.pi / 260)
    recordings = table(spark, [slow])
    for name in ("CO_f1ecac", "CO_FirstMin_ac"):
        value = catch22.feature(name, S.to_signal(recordings), recordings).first().value
        assert value > 40 and value == pytest.approx(PLAIN[name](z(list(slow))))


def test_linear_prediction_solves_the_normal_equations():
    x = SERIES[0] - SERIES[0].mean()
    r = [sum(x[i] * x[i + k] for i in range(len(x) - k)) for k in range(12)]
    a = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(11)] for i in range(11)]), -np.array(r[1:]))
    assert kernels.lpc(SERIES[0], 12) == pytest.approx([1, *a])
    assert kernels.lpc(np.full(20, 3.0), 4).tolist() == [0] * 4


def plain_analytic(x):
    """Values whose negative frequencies are taken out, by direct transforms."""
    n = len(x)
    c = [sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x)) for k in range(n)]
    gain = [1 if k == 0 or 2 * k == n else 2 if 2 * k < n else 0 for k in range(n)]
    return [sum(g * v * cmath.exp(2j * math.pi * k * t / n) for k, (g, v) in enumerate(zip(gain, c))) / n for t in range(n)]


def test_envelopes_and_phases_equal_direct_transforms(spark):
    rows = [SERIES[0][:30], SERIES[1][:30], SERIES[4][:30]]
    got = {(r.region, r.label): r.value for r in spectral.envelope(kernels.analytic_signal(table(spark, rows))).collect()}
    phases = {}
    for i, x in enumerate(rows):
        a = plain_analytic([float(v) for v in x])
        phase = [cmath.phase(a[0])]
        for v in a[1:]:
            step = (cmath.phase(v) - phase[-1] + math.pi) % (2 * math.pi) - math.pi
            phase.append(phase[-1] + step)
        phases[i] = [cmath.phase(v) for v in a]
        for short, values in (("amp", [abs(v) for v in a]), ("ph", phase)):
            five = {"mean": np.mean(values), "std": np.std(values), "median": np.median(values), "max": max(values), "min": min(values)}
            for k, v in five.items():
                assert got[i, f"env_{short}_{k}"] == pytest.approx(v, abs=1e-8)
    lock = {(r.i, r.j): r.w for r in connectivity.plv_matrix(table(spark, rows)).collect()}
    for i, j in lock:
        assert lock[i, j] == pytest.approx(abs(sum(cmath.exp(1j * (a - b)) for a, b in zip(phases[i], phases[j]))) / 30, abs=1e-8)


def test_matrix_statistics_equal_those_of_plain_decompositions(spark):
    rows = RNG.normal(size=(5, 40))
    a = np.corrcoef(rows)
    np.fill_diagonal(a, 0)
    got = connectivity.matrix_kernel(table(spark, rows), "eig").first()
    values = np.linalg.eigvalsh(a)[1:]
    assert (got["mean"], got["max"], got["std"]) == pytest.approx((values.mean(), values.max(), values.std()))
    got = connectivity.matrix_kernel(table(spark, rows), "pca").first()
    centred = a - a.mean(axis=0)
    _, s, _ = np.linalg.svd(centred)
    # Scores have mean zero, and their squares sum to those of the singular values.
    assert got["std"] == pytest.approx(math.sqrt((s[:3] ** 2).sum() / (5 * 3))) and got["mean"] == pytest.approx(0, abs=1e-9)


def plain_mi(x, y, k=4):
    psi, n, total = (lambda m: sum(1 / i for i in range(1, m))), len(x), 0.0
    for i in range(n):
        d = sorted((max(abs(x[i] - x[j]), abs(y[i] - y[j])), j) for j in range(n) if j != i)[:k]
        ex, ey = max(abs(x[i] - x[j]) for _, j in d), max(abs(y[i] - y[j]) for _, j in d)
        total += sum(psi(sum(abs(v[i] - v[j]) <= e for j in range(n) if j != i)) for v, e in ((x, ex), (y, ey)))
    return psi(k) - 1 / k - total / n + psi(n)


def plain_te(s, t, k=4):
    psi, n, total = (lambda m: sum(1 / i for i in range(1, m))), len(s) - 1, 0.0
    for i in range(n):
        near = [(abs(t[i + 1] - t[j + 1]), abs(t[i] - t[j]), abs(s[i] - s[j])) for j in range(n) if j != i]
        e = sorted(max(d) for d in near)[k - 1]
        total += psi(1 + sum(b < e for _, b, _ in near)) - psi(1 + sum(max(a, b) < e for a, b, _ in near)) - psi(1 + sum(max(c, b) < e for _, b, c in near))
    return psi(k) + total / n


def test_information_of_pairs_equals_plain_loops(spark):
    rows = RNG.normal(size=(4, 50))
    rows[1] = 0.8 * rows[0] + 0.2 * rows[1]
    r = table(spark, rows)
    for pairs in ([(0, 1), (2, 3), (3, 0)], infotheory.neighbours(r)):
        wanted = pairs if isinstance(pairs, list) else [(0, 1), (1, 2), (2, 3)]
        got = {(x.source, x.target): x.value for x in infotheory.mutual_information(r, pairs).collect()}
        assert got == pytest.approx({(s, t): max(0, plain_mi(rows[s], rows[t])) * 1.4427 for s, t in wanted})
        got = {(x.source, x.target): x.value for x in infotheory.transfer_entropy(r, pairs).collect()}
        assert got == pytest.approx({(s, t): plain_te(rows[s], rows[t]) for s, t in wanted})
    got = {(x.source, x.target): x.value for x in infotheory.surrogate_null(r, [(0, 1), (2, 3)], surrogates=3).collect()}
    for (s, t), value in got.items():
        null = sum(max(0, plain_mi(np.random.default_rng([0, k]).permutation(rows[s]), rows[t])) for k in (1, 2, 3)) / 3
        assert value == pytest.approx(max(0, max(0, plain_mi(rows[s], rows[t])) - null) * 1.4427)


def test_prior_draws_splits_and_components(spark):
    draws = posterior.prior_sample(spark, [("a", 0.0, 1.0), ("b", -2.0, 2.0)], 4000, seed=3).toPandas()
    assert len(draws) == 4000 and draws.a.between(0, 1).all() and draws.b.between(-2, 2).all()
    assert draws.a.mean() == pytest.approx(0.5, abs=0.03) and draws.b.var() == pytest.approx(16 / 12, rel=0.1) and abs(np.corrcoef(draws.a, draws.b)[0, 1]) < 0.06
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    held = posterior.split(rows, "key")
    share = held.filter("held_out").count() / 5000
    assert 0 < share < 0.5 and held.count() == 5000
    assert {r.key for r in held.filter("held_out").collect()} == {r.key for r in posterior.split(rows.orderBy(F.desc("key")), "key").filter("held_out").collect()}
    x = RNG.normal(size=(60, 3)) @ np.array([[2.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 0.3]])
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "trial long, a double, b double, c double")
    got = {r.trial: list(r.pc) for r in posterior.pca_embed(frame, ["a", "b", "c"], 2).collect()}
    _, _, axes = np.linalg.svd((x - x.mean(axis=0)) / 1.0, full_matrices=False)
    plain = (x - x.mean(axis=0)) @ axes[:2].T
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=0)
    _, _, scaled_axes = np.linalg.svd(scaled, full_matrices=False)
    found = np.array([got[i] for i in range(60)])
    found = found - found.mean(axis=0)
    fits = lambda wanted: np.allclose(np.abs(np.corrcoef(found.T, wanted.T)[:2, 2:]).diagonal(), 1, atol=1e-6)
    assert fits(plain) or fits(scaled @ scaled_axes[:2].T)


def test_every_feature_of_a_configuration_equals_its_operator(spark):
    rows = np.random.default_rng(7).normal(size=(4, 80))
    recordings = table(spark, rows)
    signal = S.to_signal(recordings)
    config = {"x": {"calc_envelope": {"parameters": {"features": ["mean", "max"]}}, "auc_lim": {"parameters": {"xlim": [[0, 5], [10, 70]]}}, "fc_homotopic": {"parameters": {}}, "fc_sum": {"parameters": {"masks": ["intrah", "interh"]}},
                    "fc_stat": {"parameters": {"k": 1, "masks": ["interh"], "positive": True, "quantiles": [0.5]}}, "calc_mi": {"parameters": {"mode": "all", "time_diff": 0}}, "calc_te": {"parameters": {"source_indices": [0, 2], "target_indices": [3, 1]}},
                    "spectrum_stats": {"parameters": {"features": ["max_psd", "max_frequency"], "average": True}}, "spectrum_moments": {"parameters": {"moments": [2]}}, "psd_raw": {"parameters": {"bands": [[0, 0.2]], "df": 0.05}}, "hmm_stat": {"parameters": {"n_states": 2, "n_iter": 5, "of": "series"}}}}
    got = {}
    for r in G.extract(signal, config).collect():
        got.setdefault(r.feature, {})[r.label] = r.value
    assert set(got) == set(config["x"])
    fc = np.corrcoef(rows)
    inside = [fc[0, 1], fc[2, 3]]
    between = [fc[i, j] for i in (0, 1) for j in (2, 3)]
    assert got["fc_sum"] == pytest.approx({"fc_sum_intrah_sum": 2 * sum(map(abs, inside)), "fc_sum_interh_sum": 2 * sum(map(abs, between))})
    assert got["fc_stat"]["fc_stat_interh_mean"] == pytest.approx(np.mean(np.maximum(between, 0)))
    assert {"fc_stat_eig_mean", "fc_stat_pca_std", "fc_stat_q50"} <= set(got["fc_stat"])
    assert got["fc_homotopic"] == pytest.approx({f"fc_homotopic_{i}": max(fc[i, i + 2], 0) for i in (0, 1)})
    assert got["calc_mi"] == pytest.approx({f"calc_mi_{i}_{j}": max(0, plain_mi(rows[i], rows[j])) * 1.4427 for i in range(4) for j in range(4) if i != j})
    assert got["calc_te"] == pytest.approx({"calc_te_0_3": plain_te(rows[0], rows[3]), "calc_te_2_1": plain_te(rows[2], rows[1])})
    assert len(got["calc_envelope"]) == 16 and got["calc_envelope"]["calc_envelope_env_amp_max_1"] == pytest.approx(max(abs(v) for v in plain_analytic(list(rows[1]))))
    areas = {f"auc_lim_{k}_{i}": sum((rows[i][t] + rows[i][t + 1]) / 2 for t in range(a, b)) for k, (a, b) in enumerate([(0, 5), (10, 70)]) for i in range(4)}
    assert got["auc_lim"] == pytest.approx(areas)
    mean = np.mean([np.abs(np.fft.rfft(r - r.mean())) for r in rows], axis=0)
    assert got["spectrum_stats"] == pytest.approx({"spectrum_stats_max_psd_0": mean.max(), "spectrum_stats_max_frequency_0": mean.argmax() / 80})
    for i, r in enumerate(rows):
        power = np.abs(np.fft.rfft(r - r.mean()))
        assert got["spectrum_moments"][f"spectrum_moments_2_{i}"] == pytest.approx(power.var())
        assert got["psd_raw"][f"psd_raw_0_1_{i}"] == pytest.approx(np.interp(0.05, np.fft.rfftfreq(80), power))
    path = states.fit_hmm(recordings, 2, 5)
    wanted = {f"hmm_stat_{r.label}_{r.region}": r.value for r in states.summary(path, 2).collect()}
    assert got["hmm_stat"] == pytest.approx(wanted) and len(wanted) > 40
    assert stats.kuramoto(kernels.analytic_signal(recordings).select("trial", "region", "t", F.col("phase").alias("v"))).first().value <= 1
