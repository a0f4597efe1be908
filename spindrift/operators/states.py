"""Hidden-state paths: run lengths, durations, transitions, and a Gaussian hidden Markov model fitted by distributed EM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.kernels import by_length, forward_backward, per_trial, viterbi
from spindrift.operators.signal import in_time


def runs(path: DataFrame) -> DataFrame:
    """(trial, region, run, state, length): stretches of one state, numbered from 1."""
    change = (~F.col("state").eqNullSafe(F.lag("state").over(in_time()))).cast("int")
    marked = path.withColumn("c", change).withColumn("run", F.sum("c").over(in_time()).cast("int"))
    return marked.groupBy("trial", "region", "run", "state").agg(F.count("*").alias("length"))


def durations(path: DataFrame, n_states: int, bins: int = 10, longest: int = 100, mean: bool = True) -> DataFrame:
    """(trial, region[, state], bin, value): histogram of run lengths in (0, longest), averaged over states if mean; empty cells are 0."""
    place = F.least(F.floor(F.col("length") / float(longest) * bins), F.lit(bins - 1)).cast("int")
    counted = runs(path).filter(F.col("length") <= longest).groupBy("trial", "region", "state", place.alias("bin")).agg(F.count("*").alias("n"))
    grid = path.select("trial", "region").distinct().select("trial", "region", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counted, ["trial", "region", "state", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not mean:
        return full.select("trial", "region", "state", "bin", F.col("n").cast("double").alias("value"))
    return full.groupBy("trial", "region", "bin").agg((F.sum("n") / n_states).alias("value"))


def transitions(path: DataFrame) -> DataFrame:
    """(trial, region, source, target, p): how often a state follows another, by row share."""
    pairs = path.withColumn("target", F.lead("state").over(in_time())).filter("target is not null")
    counted = pairs.groupBy("trial", "region", F.col("state").alias("source"), "target").agg(F.count("*").alias("n"))
    return counted.select("trial", "region", "source", "target", (F.col("n") / F.sum("n").over(Window.partitionBy("trial", "region", "source"))).alias("p"))


def summary(path: DataFrame, n_states: int, bins: int = 10, longest: int = 100) -> DataFrame:
    """(trial, region, label, value): durations and transitions as features."""
    first = durations(path, n_states, bins, longest).select("trial", "region", F.concat(F.lit("duration_"), F.col("bin")).alias("label"), "value")
    second = transitions(path).select("trial", "region", F.concat(F.lit("transition_"), F.col("source"), F.lit("_"), F.col("target")).alias("label"), F.col("p").alias("value"))
    return first.unionByName(second)


def _log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """[starts x samples x states]: log densities of normal distributions with full covariances."""
    root = np.linalg.cholesky(cov)
    scaled = np.linalg.solve(root[:, :, None], (x[None, None] - mean[:, :, None])[..., None])[..., 0] if x.shape[1] < 2 else np.moveaxis(np.linalg.solve(root, np.moveaxis(x[None, None] - mean[:, :, None], 2, 3)), 3, 2)
    half = np.log(np.diagonal(root, axis1=2, axis2=3)).sum(axis=2)
    return np.moveaxis(-0.5 * (scaled**2).sum(axis=3) - half[..., None] - 0.5 * x.shape[1] * np.log(2 * np.pi), 1, 2)


def _posterior(log_b: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities, expected transitions and log-likelihood for several models at once; each sample is scaled by its largest density."""
    top = log_b.max(axis=2, keepdims=True)
    b = np.exp(log_b - top)
    s, n, k = b.shape
    alpha, scale, beta = np.empty((s, n, k)), np.empty((s, n)), np.ones((s, n, k))
    for t in range(n):
        now = (start if t == 0 else np.einsum("si,sij->sj", alpha[:, t - 1], step)) * b[:, t]
        scale[:, t] = now.sum(axis=1)
        alpha[:, t] = now / scale[:, t, None]
    for t in range(n - 2, -1, -1):
        beta[:, t] = np.einsum("sij,sj->si", step, b[:, t + 1] * beta[:, t + 1]) / scale[:, t + 1, None]
    ahead = b[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
    both = np.einsum("sti,stj->sij", alpha[:, :-1], ahead) * step
    return alpha * beta, both, np.log(scale).sum(axis=1) + top[..., 0].sum(axis=1)


def _thin(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Coordinates of fewer samples than regions in the space that the samples span, and what this leaves out of the log-likelihood.

    Regions are scaled by their deviation, so that the floor of the covariances is a thousandth in every direction; outside the samples' space a
    covariance is that floor for every state, and the mean is the samples'.
    """
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    z = (x - x.mean(axis=0)) / scale
    turned = np.linalg.qr(z.T, mode="r").T
    out = z.shape[1] - turned.shape[1]
    return turned, -len(x) * (np.log(scale).sum() + 0.5 * out * np.log(2 * np.pi * 1e-3))


def fit_path(x: np.ndarray, n_states: int, rounds: int, starts: int, seed: int, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """The most likely states of a [samples x regions] recording under a hidden Markov model with normal emissions, and the model's log-likelihood.

    Several models start from random samples as means and are fitted side by side, until none gains; the likeliest one decides. States are
    numbered by the mean of the first region. Covariances keep a thousandth of the regions' variances, so they stay regular.
    """
    n, d = x.shape
    first, beside, whole = x[:, 0], 0.0, d
    if d > n:
        x, beside = _thin(x)
        d = x.shape[1]
    rng, k = np.random.default_rng(seed), min(n_states, n)
    ridge = np.eye(d) * 1e-3 if len(first) < whole else np.diag(np.maximum(x.var(axis=0), 1e-12)) * 1e-3
    mean = np.stack([x[np.sort(rng.choice(n, k, replace=False))] for _ in range(starts)])
    cov = np.broadcast_to(np.atleast_2d(np.cov(x.T, bias=True)) + ridge, (starts, k, d, d)).copy()
    level = np.stack([first[np.abs(x[None] - m[:, None]).sum(axis=2).argmin(axis=1)] for m in mean])
    start, step = np.full((starts, k), 1 / k), np.broadcast_to(np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), (starts, k, k)).copy()
    last = np.full(starts, -np.inf)
    for _ in range(rounds):
        gamma, both, likelihood = _posterior(_log_normal(x, mean, cov), start, step)
        likelihood = likelihood + beside
        if (likelihood - last <= tolerance * np.abs(likelihood)).all():
            break
        last = likelihood
        weight = np.maximum(gamma.sum(axis=1), 1e-10)
        start, step = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True), (both + 1e-12) / (both + 1e-12).sum(axis=2, keepdims=True)
        mean = np.einsum("stk,td->skd", gamma, x) / weight[..., None]
        level = np.einsum("stk,t->sk", gamma, first) / weight
        apart = x[None, :, None] - mean[:, None]
        cov = np.einsum("stk,stkd,stke->skde", gamma, apart, apart, optimize=True) / weight[..., None, None] + ridge
    log_b = _log_normal(x, mean, cov)
    likelihood = _posterior(log_b, start, step)[2]
    best = int(likelihood.argmax())
    with np.errstate(divide="ignore"):
        log_step, score = np.log(step[best]), np.log(start[best]) + log_b[best, 0]
    back, path = np.zeros((n, k), int), np.empty(n, np.int32)
    for t in range(1, n):
        through = score[:, None] + log_step
        back[t], score = through.argmax(axis=0), through.max(axis=0) + log_b[best, t]
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(level[best], kind="stable"))[path].astype(np.int32), float(likelihood[best] + beside)


def fit_trials(recordings: DataFrame, n_states: int = 4, rounds: int = 20, starts: int = 3, seed: int = 0) -> DataFrame:
    """(trial, t, state): the most likely path of each trial under a model of its own over all its regions together.

    Regions with a value that is not finite, or shorter than the longest one, are left out; a trial without any region left has no rows. A trial is one task's
    work: the recursion over its samples holds states, not regions.
    """

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        x = x[np.isfinite(x).all(axis=1)]
        path = fit_path(x.T, n_states, rounds, starts, seed)[0] if x.size else np.zeros(0, np.int32)
        return {"t": np.arange(len(path), dtype=np.int32), "state": path}

    return per_trial(recordings, run, "t int, state int")


def fit_hmm(recordings: DataFrame, n_states: int = 4, rounds: int = 20) -> DataFrame:
    """(trial, region, t, state): most likely path of every series under one model fitted to all of them.

    Each round, tasks turn series into sufficient statistics of bounded size, which Spark sums; only the sums and the
    parameters (n_states squared numbers) reach the driver. Starts from equal steps through mean +- 1.5 deviations.
    """
    total = recordings.select(F.explode("v").alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    mean = total[0] + total[1] * np.linspace(-1.5, 1.5, n_states)
    var, start = np.full(n_states, total[1] ** 2), np.full(n_states, 1 / n_states)
    step = np.full((n_states, n_states), 0.1 / max(1, n_states - 1)) + np.eye(n_states) * (0.9 - 0.1 / max(1, n_states - 1))
    series = recordings.select("trial", "region", "v").persist()
    for _ in range(rounds):
        model = start, step, mean, var

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n_states, 4 + n_states))
            for batch in batches:
                for x, _ in by_length(batch.column("v")):
                    gamma, both, _ = forward_backward(x, *model)
                    flat, v = gamma.reshape(-1, n_states), x.ravel()
                    sums += np.column_stack([gamma[:, 0].sum(0), flat.sum(0), flat.T @ v, flat.T @ v**2, both.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_states)), pa.array(list(sums), pa.list_(pa.float64()))], ["k", "s"])

        parts = series.mapInArrow(expect, "k bigint, s array<double>")
        rows = parts.groupBy("k").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(4 + n_states)]).orderBy("k").collect()
        s = np.array([r[1:] for r in rows])
        start = s[:, 0] / s[:, 0].sum()
        mean = s[:, 2] / s[:, 1]
        var = np.maximum(s[:, 3] / s[:, 1] - mean**2, 1e-8)
        step = s[:, 4:] / s[:, 4:].sum(axis=1, keepdims=True)
    model = start, step, mean, var

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [np.zeros(0, np.int32)] * batch.num_rows
            for x, at in by_length(batch.column("v")):
                for k, found in zip(at, viterbi(x, *model)):
                    paths[k] = found
            yield pa.RecordBatch.from_arrays([batch.column("trial"), batch.column("region"), pa.array(paths, pa.list_(pa.int32()))], ["trial", "region", "path"])

    # The path is lazy and reads the series again; the parts kept for the rounds are let go.
    series.unpersist()
    return recordings.select("trial", "region", "v").mapInArrow(decode, "trial bigint, region int, path array<int>").select("trial", "region", F.posexplode("path").alias("t", "state"))
