"""Feature configuration and extraction.

A configuration is a dict domain -> feature -> {"parameters": {...}, "use": bool, "tag": [...], "description": str}; it
can also be seen as a table. extract() runs every enabled feature on all trials in one plan: features that are plain
statistics of a series share one pass, spectral ones one spectrum, connectivity ones one matrix.
"""

from __future__ import annotations

import copy
import importlib.util
import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import catch22, connectivity, infotheory, kernels, spectral, states, stats
from spindrift.operators import signal as signal_model
from spindrift.operators.signal import preprocess, to_recordings

STATISTICS = ("calc_var", "calc_std", "calc_mean", "calc_max", "calc_min", "calc_median", "calc_skewness", "calc_kurtosis", "mean_abs_dev", "median_abs_dev", "rms", "interq_range", "burstiness")
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
BANDS = [[0, 4], [4, 8], [8, 12], [12, 30], [30, 70]]
MOMENTS = [2, 3, 4, 5, 6]
ENVELOPE = ["mean", "std", "median", "max", "min"]
TEMPORAL = ("abs_energy", "average_power", "calc_centroid", "zero_crossing", "seizure_onset", "auc")
WAVELETS = ("wavelet_abs_mean", "wavelet_std", "wavelet_energy")
SPECTRAL = ("fundamental_frequency", "max_frequency", "max_psd", "median_frequency", "spectral_centroid", "spectral_kurtosis", "spectral_variation", "spectral_distance")


def _entry(tag: list[str], **parameters) -> dict:
    return {"parameters": parameters, "use": True, "tag": tag, "description": ""}


def default_config() -> dict:
    """All built-in features with their usual parameters."""
    matrix = {"positive": False, "masks": None, "eigenvalues": True, "pca_num_components": 3, "quantiles": QUANTILES, "features": list(kernels.SEVEN)}
    pairs = {"k": 4, "source_indices": None, "target_indices": None, "mode": "pairwise"}
    own = {"seizure_onset": {"threshold": 0.02}, "auc": {"dx": None, "x": None}, "average_power": {"fs": None}, "calc_centroid": {"fs": None}}
    spectrum = {"fs": None, "method": "fft", "nperseg": None, "average": False, "indices": None}
    off = lambda entry: {**entry, "use": False}
    return {
        "statistical": {n: _entry(["all"], indices=None) for n in STATISTICS} | {"calc_moments": _entry(["all"], orders=MOMENTS, indices=None), "calc_envelope": _entry(["all"], features=ENVELOPE, indices=None)},
        "temporal": {n: _entry(["all", "eeg"], indices=None, **own.get(n, {})) for n in TEMPORAL}
        | {"kop": _entry(["all", "eeg"], indices=None, extract_phase=False), "auc_lim": _entry(["all", "eeg"], xlim=[[0, 10]], indices=None)}
        | {n: off(_entry(["eeg"], indices=None, widths=list(range(1, 10)))) for n in WAVELETS},
        "spectral": {n: _entry(["eeg"], **spectrum) for n in SPECTRAL}
        | {
            "spectral_spread": off(_entry(["eeg"], **spectrum)),
            "spectrum_stats": _entry(["eeg"], **spectrum, features=list(SPECTRAL)),
            "spectrum_moments": _entry(["eeg"], **spectrum, moments=MOMENTS, normalize=False),
            "spectrum_auc": _entry(["eeg"], **spectrum, bands=BANDS),
            "psd_raw": _entry(["eeg"], **spectrum, bands=BANDS, df=1.0, normalize=False, normalize_to=None),
        },
        "connectivity": {
            "fc_sum": _entry(["fmri"], positive=False, masks=None),
            "fc_stat": _entry(["fmri"], k=1, fc_function="corrcoef", **matrix),
            "fc_homotopic": _entry(["fmri"], positive=True, average=False, fc_function="corrcoef"),
            "fcd_stat": _entry(["fmri"], width=32, TR=1.0, win_len=None, k=None, **matrix),
            "coactivation_degree": off(_entry(["fmri"], indices=None)),
            "coactivation_phase": off(_entry(["fmri"], indices=None)),
        },
        "hmm": {"hmm_stat": _entry(["fmri"], n_states=4, n_iter=20, tcut=100, bins=10, node_indices=None, starts=3, seed=0, of="trial")},
        "information": {
            "calc_entropy": _entry(["all"], average=False),
            "entropy_bin": _entry(["all"], digits=1, prob="standard", average=False, indices=None),
            "calc_mi": _entry(["all"], time_diff=1, num_surrogates=0, seed=0, average=False, **pairs),
            "calc_te": _entry(["all"], delay=1, average=False, **pairs),
        },
        "catch22": {n: off(_entry(["catch22"], indices=None)) for n in catch22.NAMES} | {"catch22": off(_entry(["catch22"], indices=None, catch24=False, features=None))},
    }


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def by_domain(config: dict, domains: list[str] | str | None = None) -> dict:
    """The given domains, all for None; an unknown one is an error."""
    wanted = list(config) if domains is None else [domains] if isinstance(domains, str) else list(domains)
    unknown = [d for d in wanted if d not in config]
    if unknown:
        raise ValueError(f"unknown domains: {unknown}")
    return {d: copy.deepcopy(config[d]) for d in wanted}


def by_names(config: dict, names: list[str] | str | None) -> dict:
    """The named features, whatever their case; unknown names warn. Domains without features stay out."""
    if names is None:
        return copy.deepcopy(config)
    wanted = {n.lower() for n in ([names] if isinstance(names, str) else names)}
    known = {f.lower() for d in config.values() for f in d}
    for n in sorted(wanted - known):
        warnings.warn(f"unknown feature {n}", stacklevel=2)
    kept = {d: {f: copy.deepcopy(v) for f, v in fs.items() if f.lower() in wanted} for d, fs in config.items()}
    return {d: fs for d, fs in kept.items() if fs}


def by_tag(config: dict, tags: list[str] | str) -> dict:
    """Features with at least one of the tags; "all" keeps everything."""
    wanted = {tags} if isinstance(tags, str) else set(tags)
    known = {t for d in config.values() for f in d.values() for t in f["tag"]} | {"all"}
    if wanted - known:
        raise ValueError(f"unknown tags: {sorted(wanted - known)}")
    if "all" in wanted:
        return copy.deepcopy(config)
    kept = {d: {f: copy.deepcopy(v) for f, v in fs.items() if wanted & set(v["tag"])} for d, fs in config.items()}
    return {d: fs for d, fs in kept.items() if fs}


def update(config: dict, name: str, parameters: dict) -> dict:
    """A copy with parameters of a feature set; unknown features and parameters are errors."""
    out = copy.deepcopy(config)
    for features in out.values():
        if name in features:
            unknown = set(parameters) - set(features[name]["parameters"])
            if unknown:
                raise ValueError(f"{name} has no parameters {sorted(unknown)}")
            features[name]["parameters"].update(parameters)
            return out
    raise ValueError(f"unknown feature {name}")


def as_table(spark, config: dict) -> DataFrame:
    """(domain, feature, params MAP, use, tag): what report and SQL see."""
    rows = [(d, f, {k: json.dumps(p) for k, p in v["parameters"].items()}, v["use"], v["tag"]) for d, fs in config.items() for f, v in fs.items()]
    return spark.createDataFrame(rows, "domain string, feature string, params map<string,string>, use boolean, tag array<string>")


def report(spark, config: dict) -> None:
    as_table(spark, config).orderBy("domain", "feature").show(200, truncate=60)


#: User features: name -> function of (recordings, **parameters) giving (trial, label, value).
CUSTOM: dict[str, Callable[..., DataFrame]] = {}


def add(config: dict, domain: str, name: str, fn: Callable[..., DataFrame], parameters: dict | None = None, tag: list[str] | None = None) -> dict:
    """A copy with a user feature. fn(recordings, **parameters) returns (trial, label, value)."""
    out = copy.deepcopy(config)
    out.setdefault(domain, {})[name] = {"parameters": parameters or {}, "use": True, "tag": tag or ["all"], "description": fn.__doc__ or ""}
    CUSTOM[name] = fn
    return out


def matrix_feature(fn: Callable) -> Callable[..., DataFrame]:
    """Wrap fn(x [regions x samples], **parameters) -> (values, labels) as a user feature, run per trial in Arrow batches."""

    def run(recordings: DataFrame, **parameters) -> DataFrame:
        def one(x):
            values, labels = fn(x, **parameters)
            return {"label": list(labels), "value": [float(v) for v in values]}

        return kernels.per_trial(recordings, one, "label string, value double")

    return run


def add_json(config: dict, json_path: str, module_path: str) -> dict:
    """User features from a JSON configuration and the Python file that defines functions (x, **parameters) -> (values, labels)."""
    spec = importlib.util.spec_from_file_location("user_features", module_path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    out = copy.deepcopy(config)
    for domain, features in load_config(json_path).items():
        for name, entry in features.items():
            if not hasattr(module, name):
                raise ValueError(f"{module_path} has no function {name}")
            out = add(out, domain, name, matrix_feature(getattr(module, name)), entry.get("parameters"), entry.get("tag"))
            out[domain][name].update({k: entry[k] for k in ("use", "description") if k in entry})
    return out


def _labelled(df: DataFrame, feature: str, *parts: str) -> DataFrame:
    return df.select("trial", F.lit(feature).alias("feature"), F.concat_ws("_", F.lit(feature), *[F.col(p).cast("string") for p in parts]).alias("label"), F.col("value").cast("double").alias("value"))


def _wide(df: DataFrame, feature: str, columns: list[str]) -> DataFrame:
    return _labelled(df.unpivot(["trial"], columns, "what", "value"), feature, "what")


class _Shared:
    """What features of one call have in common: each spectrum, matrix and path of states is planned once."""

    def __init__(self, signal: DataFrame, fs: float):
        self.signal, self.recordings, self.fs = signal, to_recordings(signal), fs
        self.found: dict[tuple, DataFrame] = {}
        self.parts: dict[tuple, _Shared] = {}

    def at(self, p: dict, name: str = "indices") -> _Shared:
        """What belongs to the regions that the parameters name, all for none."""
        wanted = p.get(name)
        if wanted is None:
            return self
        key = tuple(sorted(wanted))
        if key not in self.parts:
            self.parts[key] = _Shared(self.signal.filter(F.col("region").isin(list(key))), self.fs)
        return self.parts[key]

    def every_trial(self, found: DataFrame, columns: list[str]) -> DataFrame:
        """found with a row of NaN for trials without one."""
        trials = self.get(("trials",), lambda: self.signal.select("trial").distinct())
        return trials.join(found, "trial", "left").select("trial", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.found:
            self.found[key] = make()
        return self.found[key]

    def spectrum(self, p: dict) -> DataFrame:
        method, nperseg, average = p.get("method", "fft"), p.get("nperseg"), bool(p.get("average", False))
        fs = p.get("fs") or self.fs
        each = self.get(("spectrum", fs, method, nperseg), lambda: kernels.spectrum(self.recordings, fs, method, nperseg))
        return self.get(("spectrum", fs, method, nperseg, "mean"), lambda: spectral.average(each)) if average else each

    def sizes(self) -> DataFrame:
        return self.get(("sizes",), lambda: connectivity.sizes(self.recordings))

    def kind(self, p: dict) -> str:
        function = p.get("fc_function", "corrcoef")
        if function not in ("corrcoef", "cov"):
            raise ValueError(f"unknown fc_function {function}")
        return "corr" if function == "corrcoef" else "cov"

    def matrix(self, p: dict, mask: str, k: int = 1) -> DataFrame:
        """Statistics of the entries of a matrix, which is not made for them."""
        positive, kind = bool(p.get("positive", False)), self.kind(p)
        return self.get(("matrix", positive, kind, mask, k), lambda: connectivity.matrix_stats(self.recordings, k, kind, positive, mask))

    def fcd(self, width: int, mask: str = "full") -> DataFrame:
        pairs = None if mask == "full" else connectivity.mask_pairs(self.sizes(), mask)
        return self.get(("fcd", width, mask), lambda: connectivity.fcd_matrix(self.recordings, width, pairs))


def _names(p: dict) -> list[str]:
    """The mask names of the parameters, "full" for none."""
    masks = p.get("masks") or ["full"]
    return [masks] if isinstance(masks, str) else masks


def _masked(name: str, p: dict, statistic: Callable[[str], DataFrame], columns: list[str]) -> list[DataFrame]:
    """A statistic in each mask named by the parameters; labels carry the mask."""
    return [_wide(statistic(m), name, columns).withColumn("label", F.expr(f"replace(label, '{name}', '{name if m == 'full' else f'{name}_{m}'}')")) for m in _names(p)]


def _fc_stat(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    """Statistics of the matrix with zeros outside each mask: of its entries, eigenvalues, components and quantiles."""
    wanted = [f for f in kernels.SEVEN if f in p["features"]]
    kind, positive = shared.kind(p), bool(p["positive"])
    out = _masked(name, p, lambda m: shared.matrix(p, m, p["k"]), wanted) if wanted else []
    quantiles = lambda m: connectivity.matrix_quantiles(shared.recordings, p["quantiles"], kind, positive, m)
    for m in _names(p):
        out += _matrix_parts(shared, name if m == "full" else f"{name}_{m}", p, lambda m=m: quantiles(m), lambda what, m=m: connectivity.matrix_kernel(shared.recordings, what, positive=p["positive"], components=p["pca_num_components"], mask=m, kind=p["fc_function"]), name)
    return out


def _fcd_stat(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    """The same of the windows' matrix over the pairs of each mask. Trials of under two windows get NaN."""
    width = p["width"] if p.get("win_len") is None else int(p["win_len"] / p["TR"])
    k = width if p.get("k") is None else p["k"]
    above = lambda w: F.when(F.isnan(w), w).otherwise(F.greatest(w, F.lit(0.0))) if p["positive"] else w
    of = lambda m: shared.fcd(width, m).withColumn("w", above(F.col("w")))
    wanted = [f for f in kernels.SEVEN if f in p["features"]]
    out = _masked(name, p, lambda m: shared.every_trial(connectivity.stat_ut(of(m), k), wanted), wanted) if wanted else []
    for m in _names(p):
        sizes = of(m).groupBy("trial").agg((F.max("j") + 1).alias("n"))
        quantiles = lambda m=m, sizes=sizes: connectivity.stat_quantile(of(m), sizes, p["quantiles"])
        decomposed = lambda what, m=m: shared.every_trial(connectivity.edge_kernel(of(m), what, p["pca_num_components"]), list(kernels.SEVEN))
        out += _matrix_parts(shared, name if m == "full" else f"{name}_{m}", p, quantiles, decomposed, name)
    return out


def _spread(name: str, prefix: str, df: DataFrame) -> DataFrame:
    """Seven statistics of values that come from a matrix, labelled name_prefix_statistic."""
    return _wide(df.withColumnsRenamed({k: f"{prefix}_{k}" for k in kernels.SEVEN}), name, [f"{prefix}_{k}" for k in kernels.SEVEN])


def _matrix_parts(shared: _Shared, label: str, p: dict, quantiles: Callable[[], DataFrame], decomposed: Callable[[str], DataFrame], name: str) -> list[DataFrame]:
    """Eigenvalues, principal components and quantiles of a matrix, as the parameters ask."""
    out = []
    if p.get("eigenvalues"):
        out.append(_spread(label, "eig", decomposed("eig")))
    if p.get("pca_num_components"):
        out.append(_spread(label, "pca", decomposed("pca")))
    if p.get("quantiles"):
        columns = [f"q{100 * q:g}".replace(".", "p") for q in p["quantiles"]]
        out.append(_wide(shared.every_trial(quantiles().toDF("trial", *columns), columns), label, columns))
    return [df.withColumn("feature", F.lit(name)) for df in out]


def _pairs(shared: _Shared, p: dict) -> DataFrame:
    """(trial, source, target) as the parameters say; without indices, each region with the next one, or in mode "all" every two regions."""
    source, target = p.get("source_indices"), p.get("target_indices")
    if source is not None and target is not None:
        wanted = infotheory.pairs_build(shared.signal.sparkSession, source, target, p["mode"])
        return shared.recordings.select("trial", F.col("region").alias("source")).join(F.broadcast(wanted), "source")
    if p["mode"] == "all":
        return connectivity.mask_pairs(shared.sizes()).select("trial", F.col("i").alias("source"), F.col("j").alias("target"))
    return infotheory.neighbours(shared.recordings)


def _statistics(shared: _Shared, names: list[str], on: dict) -> list[DataFrame]:
    """Plain statistics of series; those of the same regions and options in one pass."""
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(json.dumps([on[n].get(k) for k in ("indices", "fs", "threshold", "dx", "x")]), []).append(n)
    # Options that no member of the common group has do not split it.
    plain = [n for n in names if not any(on[n].get(k) is not None for k in ("indices", "fs", "dx", "x")) and on[n].get("threshold", 0.02) == 0.02]
    members = [plain, *([n for n in g if n not in plain] for g in groups.values())]
    out = []
    for group in (g for g in members if g):
        p = on[group[0]]
        options = {k: p[k] for k in ("threshold", "dx", "x") if p.get(k) is not None}
        found = stats.region_stats(shared.at(p).signal, group, p.get("fs") or shared.fs, gated=False, **options)
        out.append(stats.long(found, group).select("trial", "feature", "label", "value"))
    return out


def _spectral(shared: _Shared, names: list[str], on: dict) -> list[DataFrame]:
    """Statistics of spectra; those of one spectrum in one pass."""
    groups: dict[tuple, list[str]] = {}
    for n in names:
        groups.setdefault(json.dumps([on[n].get(k) for k in ("fs", "method", "nperseg", "average", "indices")]), []).append(n)
    out = []
    for members in groups.values():
        found = spectral.stats(shared.at(on[members[0]]).spectrum(on[members[0]]), members).unpivot(["trial", "region"], members, "feature", "value")
        out.append(found.select("trial", "feature", F.concat_ws("_", "feature", "region").alias("label"), "value"))
    return out


def _hmm(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    """Durations and transitions of one path a trial (of="trial"), or of a path a series under one model for all (of="series")."""
    s = shared.at(p, "node_indices")
    if p["of"] == "series":
        path = s.get(("hmm", p["n_states"], p["n_iter"]), lambda: states.fit_hmm(s.recordings, p["n_states"], p["n_iter"]))
    else:
        path = s.get(("hmm", p["n_states"], p["n_iter"], p["starts"], p["seed"]), lambda: states.fit_trials(s.recordings, p["n_states"], p["n_iter"], p["starts"], p["seed"]).withColumn("region", F.lit(0)))
    return [_labelled(states.summary(path, p["n_states"], p["bins"], p["tcut"]).withColumnRenamed("label", "what"), name, "what", "region")]


def _entropy(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    s = shared.at(p)
    kinds = {"standard": lambda: infotheory.entropy_bin(s.signal, p["digits"]), "gauss": lambda: infotheory.entropy_gauss(s.signal), "kde": lambda: infotheory.entropy_kde(s.signal)}
    if p["prob"] not in kinds:
        raise ValueError(f"unknown prob {p['prob']}; there are {sorted(kinds)}")
    found = kinds[p["prob"]]()
    return [_labelled(found.groupBy("trial").agg(F.avg("value").alias("value")), name) if p["average"] else _labelled(found, name, "region")]


def _of_pairs(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    """An estimate for each pair, less that of shuffled sources where surrogates are asked for, or the mean over the pairs."""
    pairs = _pairs(shared, p)
    if name == "calc_te":
        found = infotheory.transfer_entropy(shared.recordings, pairs, p["k"], p["delay"])
    elif p["num_surrogates"]:
        found = infotheory.surrogate_null(shared.recordings, pairs, p["num_surrogates"], p["k"], p["seed"], p["time_diff"])
    else:
        found = infotheory.mutual_information(shared.recordings, pairs, p["k"], p["time_diff"])
    return [_labelled(infotheory.pooled(found), name) if p["average"] else _labelled(found, name, "source", "target")]


def _characteristics(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    """One canonical characteristic, or for "catch22" all that the parameters name; catch24 adds mean and deviation."""
    s = shared.at(p)
    if name != "catch22":
        return [_labelled(catch22.feature(name, s.signal, s.recordings), name, "region")]
    extra = ("DN_Mean", "DN_Spread_Std")
    names = p["features"] or [n for n in catch22.NAMES if n not in extra]
    names = [*names, *(n for n in extra if p["catch24"] and n not in names)]
    return [_labelled(catch22.feature(n, s.signal, s.recordings), n, "region").withColumn("feature", F.lit(name)) for n in names]


def _wavelet(shared: _Shared, name: str, p: dict) -> list[DataFrame]:
    s = shared.at(p)
    key = ("cwt", tuple(p["widths"]))
    found = s.get(key, lambda: spectral.wavelet_stats(spectral.cwt(s.recordings, p["widths"])))
    return [_labelled(found.select("trial", "region", "width", F.col(name.removeprefix("wavelet_")).alias("value")), name, "width", "region")]


#: Other features: name -> function of (what features share, name, parameters) giving tables (trial, feature, label, value).
FEATURES: dict[str, Callable[[_Shared, str, dict], list[DataFrame]]] = {
    "calc_moments": lambda s, n, p: [_labelled(stats.moments(s.at(p).signal, p["orders"]), n, "k", "region")],
    "calc_envelope": lambda s, n, p: [
        _labelled(spectral.envelope(kernels.analytic_signal(s.at(p).recordings)).filter(F.regexp_extract("label", "([a-z]+)$", 1).isin(p["features"])).withColumnRenamed("label", "what"), n, "what", "region")
    ],
    "kop": lambda s, n, p: [_labelled(stats.kuramoto(kernels.analytic_signal(s.at(p).recordings).select("trial", "region", "t", F.col("phase").alias("v")) if p.get("extract_phase") else s.at(p).signal), n)],
    "auc_lim": lambda s, n, p: [_labelled(stats.auc_limits(s.at(p).signal, p["xlim"]), n, "interval", "region")],
    "spectrum_stats": lambda s, n, p: [_labelled(spectral.stats(s.at(p).spectrum(p), p["features"]).unpivot(["trial", "region"], p["features"], "what", "value"), n, "what", "region")],
    "spectrum_moments": lambda s, n, p: [_labelled(spectral.moments(s.at(p).spectrum(p), p["moments"], p["normalize"]), n, "order", "region")],
    "spectrum_auc": lambda s, n, p: [_labelled(spectral.band_auc(s.at(p).spectrum(p), p["bands"]), n, "band", "region")],
    "psd_raw": lambda s, n, p: [_labelled(spectral.psd_raw(s.at(p).spectrum(p), p["df"], p["bands"], p["normalize"], p["normalize_to"]), n, "band", "g", "region")],
    "fc_sum": lambda s, n, p: _masked(n, p, lambda m: s.matrix(p, m).withColumnRenamed("sum", "signed").withColumnRenamed("total", "sum"), ["sum"]) if p.get("masks") else [_labelled(s.matrix(p, "full").withColumnRenamed("total", "value"), n)],
    "fc_stat": _fc_stat,
    "fc_homotopic": lambda s, n, p: [_labelled(connectivity.homotopic(s.recordings, s.kind(p), p["positive"], p["average"]), n, *([] if p["average"] else ["i"]))],
    "fcd_stat": _fcd_stat,
    "coactivation_degree": lambda s, n, p: [_labelled(connectivity.coactivation_degree(s.at(p).signal), n, "t", "region")],
    "coactivation_phase": lambda s, n, p: [_labelled(connectivity.coactivation_phase(s.at(p).recordings), n, "region")],
    "hmm_stat": _hmm,
    "calc_entropy": lambda s, n, p: [_labelled(infotheory.entropy_pooled(s.signal), n) if p.get("average") else _labelled(infotheory.entropy_nearest(s.signal), n, "region")],
    "entropy_bin": _entropy,
    "calc_mi": _of_pairs,
    "calc_te": _of_pairs,
} | {n: _wavelet for n in WAVELETS} | {n: _characteristics for n in (*catch22.NAMES, "catch22")}


def extract(signal: DataFrame, config: dict, fs: float = 1.0, steps: dict | None = None) -> DataFrame:
    """(trial, feature, label, value) of every enabled feature. ``fs`` is that of the call, unless a feature has its own.

    A trial with a sample that is null or not finite is NaN on every label, as is what a constant or short series leaves undefined;
    other trials are not touched by it. Its samples are replaced before features run, so that none fails or leaves a label out. Statistics of series are one pass over the signal, those of one spectrum one pass over it; matrices, spectra and
    state paths are planned once for all features that read them.
    """
    if steps:
        signal = preprocess(signal, steps, fs)
    # Bad trials are few; they are looked up, not sorted out.
    bad = signal_model.finite_trials(signal).filter("not ok").select("trial", F.lit(True).alias("bad"))
    stand_in = F.pmod(F.xxhash64("trial", "region", "t"), F.lit(1_000_003)) / 1_000_003
    shared = _Shared(signal.join(bad, "trial", "left").withColumn("v", F.when(F.col("bad"), stand_in).otherwise(F.col("v"))).drop("bad"), fs)
    on = {f: v["parameters"] for fs_ in config.values() for f, v in fs_.items() if v.get("use", True)}
    out: list[DataFrame] = []
    spectral_names = (*SPECTRAL, "spectral_spread")
    for family, run in ((STATISTICS + TEMPORAL, _statistics), (spectral_names, _spectral)):
        names = [f for f in on if f in family]
        out += run(shared, names, on) if names else []
    for name, p in on.items():
        if name in CUSTOM:
            out.append(CUSTOM[name](shared.recordings, **p).select("trial", F.lit(name).alias("feature"), "label", "value"))
        elif name in FEATURES:
            defaults = next(v[name]["parameters"] for v in default_config().values() if name in v)
            out += FEATURES[name](shared, name, defaults | p)
        elif name not in (*STATISTICS, *TEMPORAL, *spectral_names):
            raise ValueError(f"unknown feature {name}")
    found = stats.union(out).join(bad, "trial", "left")
    return found.select("trial", "feature", "label", F.when(F.col("bad"), F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


def wide(features: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One column a label, in the given or sorted order; the labels come from the table when not given."""
    labels = labels or sorted(r[0] for r in features.select("label").distinct().collect())
    return features.groupBy("trial").pivot("label", labels).agg(F.first("value"))


def cells(features: DataFrame) -> DataFrame:
    """(trial, label, value): the cells of ``wide``, empty ones as null, without its columns, whose number grows with the regions."""
    grid = features.select("trial").distinct().crossJoin(F.broadcast(features.select("label").distinct()))
    kept = features.groupBy("trial", "label").agg(F.first("value").alias("value"))
    return grid.join(kept, ["trial", "label"], "left").select("trial", "label", "value")


def as_lists(features: DataFrame) -> DataFrame:
    """(trial, labels, values) in the order of the labels."""
    both = F.array_sort(F.collect_list(F.struct("label", "value")))
    return features.groupBy("trial").agg(both.alias("b")).select("trial", F.col("b.label").alias("labels"), F.col("b.value").alias("values"))


def spans(features: DataFrame) -> DataFrame:
    """(feature, first, last): where each feature's labels stand in the sorted list of labels."""
    from pyspark.sql import Window

    position = features.select("feature", "label").distinct().withColumn("p", F.row_number().over(Window.orderBy("label")) - 1)
    return position.groupBy("feature").agg(F.min("p").alias("first"), F.max("p").alias("last"))
