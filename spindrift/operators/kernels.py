"""Array kernels: one recording, or one series, at a time inside Arrow batches.

Spark deals recordings over tasks; these functions see one trial's [regions x samples] matrix (``per_trial``) or one
series (``per_series``, no shuffle at all).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def per_trial(recordings: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """fn maps the matrix of a trial, rows by region, to columns; the trial is put in front. NaN stays NaN."""
    fields = [f.split() for f in schema.split(",")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("region").to_numpy(), kind="stable")
        v = table.column("v").combine_chunks()
        series = [np.asarray(v[int(k)].values.to_numpy(zero_copy_only=False), float) for k in order]
        longest = max(map(len, series))
        # A series that is shorter than the others is not a valid one.
        x = np.stack([s if len(s) == longest else np.full(longest, np.nan) for s in series])
        found = fn(x)
        columns = [pa.array(found[n], KINDS[k]) for n, k in fields]
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.int64()), *columns], names=["trial", *(n for n, _ in fields)])

    return recordings.select("trial", "region", "v").groupBy("trial").applyInArrow(run, f"trial bigint, {schema}")


def per_series(recordings: DataFrame, fn: Callable[[np.ndarray], np.ndarray], name: str = "v") -> DataFrame:
    """fn maps a series to an array; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(np.asarray(x.values.to_numpy(zero_copy_only=False), float)) for x in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("trial"), batch.column("region"), pa.array(out, pa.list_(pa.float64()))], ["trial", "region", name])

    return recordings.select("trial", "region", "v").mapInArrow(run, f"trial bigint, region int, {name} array<double>")


def edges(matrix: np.ndarray, value: str = "w") -> dict[str, np.ndarray]:
    """The upper triangle of a symmetric matrix, without its diagonal."""
    i, j = np.triu_indices(len(matrix), 1)
    return {"i": i.astype(np.int32), "j": j.astype(np.int32), value: matrix[i, j]}


def correlation(x: np.ndarray) -> np.ndarray:
    """Pearson correlation of rows; NaN where a row is constant."""
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x @ x.T) / np.outer(norm, norm)


def sliding(x: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """[windows x pairs]: correlations of row pairs (i < j) in each window."""
    i, j = np.triu_indices(len(x), 1)
    return np.stack([correlation(x[:, s : s + width])[i, j] for s in starts]) if len(starts) else np.zeros((0, len(i)))


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the one-sided spectrum."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def analytic_signal(recordings: DataFrame) -> DataFrame:
    """(trial, region, t, amp, phase): Hilbert amplitude and unwrapped phase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [analytic(np.asarray(x.values.to_numpy(zero_copy_only=False), float)) for x in batch.column("v")]
            sizes = [len(s) for s in z]
            flat = np.concatenate([*z, np.zeros(0, complex)])
            phases = np.concatenate([*[np.unwrap(np.angle(s)) for s in z], np.zeros(0)])
            rows = pa.array(np.repeat(np.arange(len(z)), sizes))
            t = pa.array(np.concatenate([*[np.arange(n) for n in sizes], np.zeros(0, int)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("trial").take(rows), batch.column("region").take(rows), t, pa.array(np.abs(flat)), pa.array(phases)], ["trial", "region", "t", "amp", "phase"])

    return recordings.select("trial", "region", "v").mapInArrow(run, "trial bigint, region int, t int, amp double, phase double")


def spectrum(recordings: DataFrame, fs: float = 1.0, method: str = "fft", nperseg: int | None = None) -> DataFrame:
    """(trial, region, k, freq, mag): |rfft| of the demeaned series, or its Welch power density."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("v"):
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), float)
                if not len(x):
                    found.append((np.zeros(0), np.zeros(0)))
                    continue
                found.append((np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft(x - x.mean()))) if method == "fft" else welch(x, fs, nperseg or len(x) // 2))
            sizes = [len(f) for f, _ in found]
            rows = pa.array(np.repeat(np.arange(len(found)), sizes))
            k = np.concatenate([*[np.arange(n) for n in sizes], np.zeros(0, int)]).astype(np.int32)
            flat = [np.concatenate([*[f[i] for f in found], np.zeros(0)]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("trial").take(rows), batch.column("region").take(rows), pa.array(k), *map(pa.array, flat)], ["trial", "region", "k", "freq", "mag"])

    return recordings.select("trial", "region", "v").mapInArrow(run, "trial bigint, region int, k int, freq double, mag double")


def welch(x: np.ndarray, fs: float, nperseg: int, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: periodic Hann or rectangular segments, half overlapping, each less its mean."""
    nperseg = max(1, min(nperseg, len(x)))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg) if window == "hann" else np.ones(nperseg)
    step = nperseg - nperseg // 2
    segments = np.stack([x[s : s + nperseg] for s in range(0, len(x) - nperseg + 1, step)])
    segments = (segments - segments.mean(axis=1, keepdims=True)) * taper
    power = np.abs(np.fft.rfft(segments)) ** 2 / (fs * (taper**2).sum())
    power[:, 1 : (nperseg + 1) // 2] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), power.mean(axis=0)


def butterworth(order: int, cutoffs: list[float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Digital filter coefficients by the bilinear transform; cutoffs as fractions of the Nyquist frequency."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    zeros, gain = np.zeros(0, complex), 1.0
    warped = 4 * np.tan(np.pi * np.asarray(cutoffs, float) / 2)
    if kind in ("low", "high"):
        w = warped[0]
        if kind == "low":
            poles, gain = poles * w, w**order
        else:
            gain, poles, zeros = float(np.real(1 / np.prod(-poles))), w / poles, np.zeros(order, complex)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2 if kind == "band" else (width / 2) / poles
        if kind == "stop":
            gain = float(np.real(1 / np.prod(-poles)))
        poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
        if kind == "band":
            zeros, gain = np.zeros(order, complex), gain * width**order
        else:
            zeros = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
    extra = len(poles) - len(zeros)
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(extra)])
    return np.real(gain * np.poly(zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the transposed filter after a long run of ones."""
    n = len(a) - 1
    companion = np.eye(n, k=1)
    companion[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    state, out = [*state, 0.0], np.empty(len(x))
    taps = list(zip(b[1:], a[1:]))
    for n, value in enumerate(x):
        y = b[0] * value + state[0]
        for k, (bk, ak) in enumerate(taps):
            state[k] = bk * value + state[k + 1] - ak * y
        out[n] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of the series, padded by odd reflection at both ends."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    padded = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    steady = _steady(b, a)
    once = _filtered(b, a, padded, steady * padded[0])[::-1]
    twice = _filtered(b, a, once, steady * once[0])[::-1]
    return twice[pad : len(twice) - pad] if pad else twice


def band_pass(recordings: DataFrame, low: float = 0.02, high: float = 0.1, tr: float = 2.0, order: int = 2) -> DataFrame:
    """Zero-phase Butterworth band pass of every series."""
    b, a = butterworth(order, [2 * low * tr, 2 * high * tr], "band")
    return per_series(recordings, lambda x: zero_phase(b, a, x))


def iir_filter(recordings: DataFrame, fs: float, low_cut: float | None = None, high_cut: float | None = None, order: int = 8) -> DataFrame:
    """High pass (low_cut alone), low pass (high_cut alone), band pass (low < high) or band stop; zero phase, in second-order steps.

    The order is reached by a cascade, each step a filter of order two, which keeps long recursions stable.
    """
    if low_cut is None and high_cut is None:
        raise ValueError("give low_cut, high_cut or both")
    if low_cut is None:
        kind, cut = "low", [2 * high_cut / fs]
    elif high_cut is None:
        kind, cut = "high", [2 * low_cut / fs]
    else:
        kind, cut = ("band" if low_cut < high_cut else "stop"), sorted([2 * low_cut / fs, 2 * high_cut / fs])
    b, a = butterworth(order, cut, kind)
    sections = second_order(b, a)

    def run(x: np.ndarray) -> np.ndarray:
        for sb, sa in sections:
            x = zero_phase(sb, sa, x)
        return x

    return per_series(recordings, run)


def second_order(b: np.ndarray, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections with conjugate pairs of zeros and poles; their product is the filter."""

    def paired(roots: np.ndarray) -> list[np.ndarray]:
        pairs = [np.array([r, r.conjugate()]) for r in roots if r.imag > 1e-9]
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-9)
        return pairs + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]

    zeros, poles = paired(np.roots(b)), paired(np.roots(a))
    out = []
    for n, p in enumerate(poles):
        z = zeros[n] if n < len(zeros) else np.zeros(0)
        out.append((np.real(np.poly(z)) * (b[np.flatnonzero(b)[0]] if n == 0 else 1), np.real(np.poly(p))))
    size = [max(len(sb), len(sa)) for sb, sa in out]
    return [(np.pad(sb, (0, s - len(sb))), np.pad(sa, (0, s - len(sa)))) for (sb, sa), s in zip(out, size)]


SEVEN = ("sum", "max", "min", "mean", "std", "skewness", "kurtosis")


def seven(x: np.ndarray) -> np.ndarray:
    """sum, max, min, mean, std, skewness, excess kurtosis (moments over n)."""
    m, s = x.mean(), x.std()
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.array([x.sum(), x.max(), x.min(), m, s, ((x - m) ** 3).mean() / s**3, ((x - m) ** 4).mean() / s**4 - 3])


def eigen_stats(a: np.ndarray) -> np.ndarray:
    """The seven statistics of the real parts of all eigenvalues but the smallest."""
    return seven(np.sort(np.linalg.eigvals(a).real)[::-1][:-1])


def pca_stats(a: np.ndarray, components: int = 3) -> np.ndarray:
    """The seven statistics of the scores on the first components; each component's largest loading is positive."""
    centred = a - a.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    vt = vt[:components]
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    return seven((centred @ vt.T).ravel())


def thin_stats(x: np.ndarray, what: str, components: int) -> np.ndarray | None:
    """eigen_stats or pca_stats of the correlation matrix of many short rows with a zero diagonal, without making it; None where the factor does not settle them.

    With unit rows u the matrix is u u' - 1. Its eigenvalues are those of u'u less one, and -1 for all other dimensions. The centred matrix times its
    transpose is h u (u'u - 2) u' h + h, h taking off the mean, so that its leading eigenvectors are combinations of the columns of h u.
    """
    if not np.isfinite(x).all() or (x == x[:, :1]).all(axis=1).any():
        return np.full(len(SEVEN), np.nan)
    u = x - x.mean(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    n, gram = len(u), u.T @ u
    if what == "eig":
        return seven(np.sort(np.concatenate([np.linalg.eigvalsh(gram) - 1, np.full(n - len(gram), -1.0)]))[::-1][:-1])
    # The columns of h u in an orthonormal basis q; there the product is r (u'u - 2) r', of which 1 is left out on all dimensions but the mean.
    q, r = np.linalg.qr(u - u.mean(axis=0))
    values, vectors = np.linalg.eigh(r @ (gram - 2 * np.eye(len(gram))) @ r.T)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    if len(values) < components or values[-1] <= 1e-9 * values[0]:
        return None
    left = q @ vectors
    scale = np.sqrt(values + 1)
    # Loadings: the matrix times the left vectors, over the singular values.
    loadings = (u @ (u.T @ left) - left) / scale
    return seven((left * scale * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(components)])).ravel())


def lpc(x: np.ndarray, order: int = 12) -> np.ndarray:
    """1 and the negative prediction coefficients by the Yule-Walker equations; zeros for a constant series, NaN for one that is not finite or not longer than the order."""
    if len(x) <= order or not np.isfinite(x).all():
        return np.full(order, np.nan)
    x = x - x.mean()
    acf = np.array([(x[: len(x) - k] * x[k:]).sum() for k in range(order)])
    if acf[0] == 0:
        return np.zeros(order)
    acf = acf / acf[0]
    lags = np.abs(np.subtract.outer(np.arange(order - 1), np.arange(order - 1)))
    return np.concatenate([[1.0], -np.linalg.solve(acf[lags], acf[1:])])


def by_length(column: pa.Array, most: int = 2048) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Series of one length as a matrix, at most so many at once, with their places in the column; empty ones are left out."""
    groups: dict[int, list[int]] = {}
    series = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in column]
    for k, x in enumerate(series):
        groups.setdefault(len(x), []).append(k)
    for length, at in groups.items():
        for lo in range(0, len(at), most):
            if length:
                yield np.stack([series[k] for k in at[lo : lo + most]]), at[lo : lo + most]


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (((x[..., None] - mean) ** 2 / var) + np.log(2 * np.pi * var))


def forward_backward(x: np.ndarray, start: np.ndarray, step: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities, expected transitions, log-likelihood of each row of x, all rows side by side; of one series without the first axis."""
    if x.ndim == 1:
        gamma, both, likelihood = forward_backward(x[None], start, step, mean, var)
        return gamma[0], both[0], float(likelihood[0])
    log_b = _log_density(x, mean, var)
    top = log_b.max(axis=2, keepdims=True)
    b = np.exp(log_b - top)
    s, n, k = b.shape
    alpha, scale = np.empty((s, n, k)), np.empty((s, n))
    now = start * b[:, 0]
    for t in range(n):
        if t:
            now = (alpha[:, t - 1] @ step) * b[:, t]
        scale[:, t] = now.sum(axis=1)
        alpha[:, t] = now / scale[:, t, None]
    beta = np.ones((s, n, k))
    both = np.zeros((s, k, k))
    for t in range(n - 2, -1, -1):
        ahead = b[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        both += alpha[:, t, :, None] * ahead[:, None, :] * step
        beta[:, t] = ahead @ step.T
    return alpha * beta, both, np.log(scale).sum(axis=1) + top.sum(axis=(1, 2))


def viterbi(x: np.ndarray, start: np.ndarray, step: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """The likeliest states of each row of x, or of one series."""
    if x.ndim == 1:
        return viterbi(x[None], start, step, mean, var)[0]
    log_b = _log_density(x, mean, var)
    with np.errstate(divide="ignore"):
        log_step, score = np.log(step), np.log(start) + log_b[:, 0]
    rows, (s, n, k) = np.arange(len(x)), log_b.shape
    back, path = np.zeros((s, n, k), np.int32), np.empty((s, n), np.int32)
    for t in range(1, n):
        through = score[:, :, None] + log_step
        back[:, t] = through.argmax(axis=1)
        score = through.max(axis=1) + log_b[:, t]
    path[:, -1] = score.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[rows, t, path[:, t]]
    return path


def strided(n: int, width: int, overlap: float, most: int) -> tuple[int, np.ndarray]:
    """Width and starts of overlapping windows. If there would be more than ``most``, the shift grows and the width with it."""
    shift = max(1, int(round(width * (1 - overlap))))
    count = (n - width) // shift + 1 if n >= width else 0
    if count > most:
        shift = max(1, (n - width) // max(1, most - 1))
        width = min(n, int(shift // (1 - overlap)))
        count = min(most, (n - width) // shift + 1)
    return width, np.arange(max(0, count)) * shift


def ricker(points: int, a: float) -> np.ndarray:
    x = np.arange(points) - (points - 1) / 2
    return 2 / (np.sqrt(3 * a) * np.pi**0.25) * (1 - (x / a) ** 2) * np.exp(-((x / a) ** 2) / 2)


def _harmonic(n: int) -> np.ndarray:
    """digamma(m) for m = 0..n, less Euler's constant; entry 0 is unused."""
    return np.concatenate([[0.0, 0.0], np.cumsum(1.0 / np.arange(1, max(2, n)))])[: n + 1]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ...: places of many stretches, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _parts(size: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of stretches with about ``most`` places in all, at least one stretch each."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield slice(lo, hi)
        lo = hi


def _within(values: np.ndarray, of: np.ndarray, reach: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one place in sorted values of those at most (strict: less than) reach apart from of, by the difference as computed, not by a rounded bound."""
    near = (lambda d: d < reach) if strict else (lambda d: d <= reach)
    n = len(values)
    lo, hi = np.searchsorted(values, of - reach, "left"), np.searchsorted(values, of + reach, "right")
    while True:  # by whole groups of equal values, to where the difference decides
        wider = (lo > 0) & near(np.abs(values[np.maximum(lo - 1, 0)] - of))
        closer = ~wider & (lo < n) & (values[np.minimum(lo, n - 1)] < of) & ~near(np.abs(values[np.minimum(lo, n - 1)] - of))
        if not (wider.any() or closer.any()):
            break
        lo = np.where(wider, np.searchsorted(values, values[np.maximum(lo - 1, 0)], "left"), np.where(closer, np.searchsorted(values, values[np.minimum(lo, n - 1)], "right"), lo))
    while True:
        wider = (hi < n) & near(np.abs(values[np.minimum(hi, n - 1)] - of))
        closer = ~wider & (hi > 0) & (values[np.maximum(hi - 1, 0)] > of) & ~near(np.abs(values[np.maximum(hi - 1, 0)] - of))
        if not (wider.any() or closer.any()):
            break
        hi = np.where(wider, np.searchsorted(values, values[np.minimum(hi, n - 1)], "right"), np.where(closer, np.searchsorted(values, values[np.maximum(hi - 1, 0)], "left"), hi))
    return lo, hi


def nearest(axes: list[np.ndarray], k: int) -> np.ndarray:
    """[samples x k]: the k nearest other samples in the maximum norm, of equally far ones those that come first.

    Samples stand in the order of the first axis, and each looks at a stretch around it that doubles until all that lies
    outside is farther away than its k-th neighbour: with few dimensions far fewer than all samples.
    """
    n = len(axes[0])
    order = np.argsort(axes[0], kind="stable")
    sorted_axes = [a[order] for a in axes]
    first, found, open_, reach = sorted_axes[0], np.empty((n, k), np.int64), np.arange(n), 4 * k
    while len(open_):
        undone = []
        lo, hi = np.maximum(open_ - reach, 0), np.minimum(open_ + reach + 1, n)
        width = min(n, 2 * reach + 1)
        start = np.minimum(lo, n - width)
        for part in (slice(p, p + max(1, (1 << 21) // width)) for p in range(0, len(open_), max(1, (1 << 21) // width))):
            me, s = open_[part], start[part]
            places = s[:, None] + np.arange(width)
            d = np.zeros(places.shape)
            for a in sorted_axes:
                np.maximum(d, np.abs(a[places] - a[me][:, None]), out=d)
            d[places == me[:, None]] = np.inf
            e = np.partition(d, k - 1, axis=1)[:, k - 1]
            # Beyond the stretch's ends the first axis alone is farther away.
            safe = ((s == 0) | (first[me] - first[np.maximum(s - 1, 0)] > e)) & ((s + width == n) | (first[np.minimum(s + width, n - 1)] - first[me] > e))
            undone.append(me[~safe])
            d, places, me, e = d[safe], places[safe], me[safe], e[safe]
            # The k of least distance, then of least original place.
            kept = d <= e[:, None]
            rows = np.repeat(np.arange(len(me)), kept.sum(axis=1))
            who, far = order[places[kept]], d[kept]
            by = np.lexsort((who, far, rows))
            begin = np.concatenate([[0], np.cumsum(kept.sum(axis=1))[:-1]]).astype(int)
            found[order[me]] = who[by][begin[:, None] + np.arange(k)] if len(me) else found[:0]
        open_, reach = np.concatenate(undone), 2 * reach
    return found


def ksg_mi(x: np.ndarray, y: np.ndarray, k: int = 4) -> float:
    """Mutual information in nats by the second nearest-neighbour form."""
    n = min(len(x), len(y))
    if n <= k:
        return float("nan")
    x, y, psi = x[:n], y[:n], _harmonic(n + 1)
    near = nearest([x, y], k)
    total = 0.0
    for a in (x, y):
        lo, hi = _within(np.sort(a), a, np.abs(a[near] - a[:, None]).max(axis=1), False)
        total += psi[hi - lo - 1].sum()
    return float(psi[k] - 1 / k - total / n + psi[n])


def ksg_te(source: np.ndarray, target: np.ndarray, k: int = 4, delay: int = 1) -> float:
    """Transfer entropy in nats: information of the delayed source on the next target value, given the target's last one."""
    first = max(1, delay)
    nxt, past, src = target[first:], target[first - 1 : -1], source[first - delay : len(source) - delay]
    n = min(map(len, (nxt, past, src)))
    if n <= k:
        return float("nan")
    nxt, past, src, psi = nxt[:n], past[:n], src[:n], _harmonic(n + 2)
    last = nearest([past, nxt, src], k)[:, -1]
    e = np.max([np.abs(a[last] - a) for a in (nxt, past, src)], axis=0)
    order = np.argsort(past, kind="stable")
    lo, hi = _within(past[order], past, e, True)
    # A sample itself is never less than 0 apart: with e = 0 the stretch is empty.
    size = np.where(e > 0, hi - lo, 0)
    nz, both = size - (e > 0), np.zeros((2, n), np.int64)
    for part in _parts(size):
        places = order[_runs(lo[part], size[part])]
        me = np.repeat(np.arange(n)[part], size[part])
        for row, a in enumerate((nxt, src)):
            both[row] += np.bincount(me[np.abs(a[places] - a[me]) < e[me]], minlength=n)
    return float(psi[k] + (psi[nz + 1] - psi[both[0] - (e > 0) + 1] - psi[both[1] - (e > 0) + 1]).mean())


def standard(x: np.ndarray) -> np.ndarray:
    s = x.std()
    return (x - x.mean()) / s if s > 0 else np.zeros(len(x))


def acf(x: np.ndarray) -> np.ndarray:
    """Biased autocorrelation at all lags, through a padded transform; zeros for a constant series."""
    x = x - x.mean()
    f = np.fft.rfft(x, 2 * len(x))
    a = np.fft.irfft(f * f.conj())[: len(x)]
    return a / a[0] if a[0] > 0 else np.zeros(len(x))


def first_zero(x: np.ndarray) -> int:
    below = np.flatnonzero(acf(x) <= 0)
    return int(below[0]) if len(below) else len(x)


def first_1e_crossing(x: np.ndarray) -> float:
    """Lag at which the autocorrelation first falls below 1 / e, interpolated; the number of samples if it never does."""
    a, level = acf(x), np.exp(-1)
    below = np.flatnonzero(a[1:] < level)
    if not len(below):
        return float(len(x))
    k = int(below[0])
    return float(k + (level - a[k]) / (a[k + 1] - a[k])) if a[k] >= level else 0.0


def first_minimum(x: np.ndarray) -> float:
    """First lag whose autocorrelation is below both its neighbours'; the number of samples if there is none."""
    a = acf(x)
    low = np.flatnonzero((a[1:-1] < a[:-2]) & (a[1:-1] < a[2:]))
    return float(low[0] + 1) if len(low) else float(len(x))


def residual_ratio(x: np.ndarray) -> float:
    """First zero of the autocorrelation of the series' steps over that of the series."""
    return first_zero(np.diff(x)) / first_zero(x) if len(x) > 1 and first_zero(x) else float("nan")


def transition_spread(x: np.ndarray) -> float:
    """Summed variances of the columns of the transition matrix of three letters, sampled at the first zero of the autocorrelation."""
    y = x[:: max(1, first_zero(x))]
    letter = np.empty(len(y), int)
    letter[np.lexsort((np.arange(len(y)), y))] = np.arange(len(y)) * 3 // max(1, len(y))
    table = np.zeros((3, 3))
    np.add.at(table, (letter[:-1], letter[1:]), 1)
    return float((table / max(1, len(y) - 1)).var(axis=0, ddof=1).sum())


def outlier_timing(x: np.ndarray, step: float = 0.01) -> float:
    """Median over rising thresholds of where, relative to the middle, the points beyond them lie; thresholds end when 2 % of points are left."""
    n, found = len(x), []
    for level in np.arange(0, max(x.max(), 0) + step, step):
        at = np.flatnonzero(x >= level)
        if len(at) < max(2, 0.02 * n):
            break
        found.append(np.median(at + 1) / (n / 2) - 1)
    return float(np.median(found)) if found else 0.0


def _rectangular(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, p = welch(x, 1.0, len(x), "rect")
    return 2 * np.pi * f, p / (2 * np.pi)


def low_power(x: np.ndarray) -> float:
    """Power in the lowest fifth of the frequencies."""
    w, p = _rectangular(x)
    return float(p[: len(p) // 5].sum() * (w[1] - w[0]))


def power_centre(x: np.ndarray) -> float:
    """Frequency at which the cumulative power passes one half."""
    w, p = _rectangular(x)
    return float(w[np.flatnonzero(np.cumsum(p) > p.sum() / 2)[0]]) if p.sum() > 0 else 0.0


def periodicity(x: np.ndarray, threshold: float = 0.01) -> float:
    """First autocorrelation peak that lies over the threshold above a trough before it, of the series less a smooth cubic trend; 0 if none."""
    t = np.linspace(-1, 1, len(x))
    knots = np.linspace(-1, 1, 4)[1:-1]
    basis = np.column_stack([t**k for k in range(4)] + [np.maximum(t - k, 0) ** 3 for k in knots])
    x = x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]
    a = acf(x)[: max(2, len(x) // 3 + 1)]
    slope = np.diff(a)
    troughs = [i for i in range(1, len(slope)) if slope[i - 1] < 0 < slope[i]]
    for i in range(1, len(slope)):
        if slope[i - 1] > 0 > slope[i] and a[i] > 0:
            before = [k for k in troughs if k < i]
            if before and a[i] - a[before[-1]] > threshold:
                return float(i)
    return 0.0


def embedding_fit(x: np.ndarray) -> float:
    """Mean distance between the histogram of successive steps in a two-dimensional embedding and an exponential of their mean; 0 for a constant series."""
    tau = max(1, min(first_zero(x), len(x) // 10))
    d = np.hypot(np.diff(x[:-tau]), np.diff(x[tau:]))
    if len(d) < 2 or d.std() == 0:
        return 0.0
    bins = max(1, int(np.ceil((d.max() - d.min()) / (3.5 * d.std() / len(d) ** (1 / 3)))))
    count, edge = np.histogram(d, bins)
    centre = (edge[:-1] + edge[1:]) / 2
    fit = np.exp(-centre / d.mean()) / d.mean()
    return float(np.abs(count / len(d) - np.maximum(fit, 0)).mean())


def fluctuation(x: np.ndarray, how: str) -> float:
    """Share of the scales in the first of two lines that best fit log fluctuation over log window size; 0 for short series."""
    y = np.cumsum(x - x.mean())
    sizes = np.unique(np.exp(np.linspace(np.log(5), np.log(max(5, len(x) // 2)), 50)).round().astype(int))
    if len(sizes) < 12:
        return 0.0
    logs = []
    for s in sizes:
        boxes = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        flat = boxes - boxes.mean(axis=1, keepdims=True) - np.outer(boxes @ t / (t @ t), t)
        logs.append(np.log(max(np.mean(np.ptp(flat, axis=1)) if how == "range" else np.sqrt((flat**2).mean()), 1e-300)))
    lx, ly = np.log(sizes), np.array(logs)

    def miss(i: np.ndarray) -> float:
        return float(np.linalg.norm(ly[i] - np.polyval(np.polyfit(lx[i], ly[i], 1), lx[i])))

    n = np.arange(len(sizes))
    errors = [miss(n[:i]) + miss(n[i - 1 :]) for i in range(6, len(n) - 5)]
    return float((int(np.argmin(errors)) + 6) / len(n))
