"""Spectral queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import kernels
from spindrift.operators import spectral as P
from spindrift.plans.base import hilbert, q, query, recs, rounded, SIG, sig

FS = 100.0
# The transform as sums over samples: 64 samples, bins 0 to 32.
SPEC = f"""{SIG}, c as (select trial, region, t, v - avg(v) over (partition by trial, region) as x from sig),
sp as (select trial, region, cast(k as int) as k, k * {FS} / 64 as freq, sqrt(pow(sum(x * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * ((k * t) % 64) / 64)), 2)) as mag from c cross join (select unnest(range(0, 33)) as k) group by all)"""
HELPED = f"""{SPEC}, n1 as (select *, lag(mag) over w as before, lead(mag) over w as after, sum(mag) over w as running from sp window w as (partition by trial, region order by k)),
h as (select *, sum(mag) over p as total, max(mag) over p as highest, count(*) over p as bins, sum(freq * mag) over p / sum(mag) over p as centre from n1 window p as (partition by trial, region))"""


def spec(s, d, **k):
    return P.spectrum(recs(s, d), FS, **k)


query("spectrum_fft", f"{SPEC} select trial, region, k, {q('freq')} as freq, {q('mag')} as mag from sp where k > 0")(lambda s, d: rounded(spec(s, d).filter("k > 0"), "freq", "mag"))
query("periodogram_onesided", f"{SPEC} select trial, region, k, {q(f'2 * 0.01 * 0.01 / 0.64 * mag * mag')} as mag from sp where k > 0")(lambda s, d: rounded(P.periodogram(spec(s, d).filter("k > 0"), 64, 0.01).drop("freq"), "mag"))
WELCH = f"""{SIG}, seg as (select trial, region, s, t - s as i, v - avg(v) over (partition by trial, region, s) as x from sig join (select unnest([0, 16, 32]) as s) g on t >= s and t < s + 32),
tap as (select *, x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) as y from seg),
ft as (select trial, region, s, cast(k as int) as k, pow(sum(y * cos(2 * pi() * ((k * i) % 32) / 32)), 2) + pow(sum(y * sin(2 * pi() * ((k * i) % 32) / 32)), 2) as p from tap cross join (select unnest(range(0, 17)) as k) group by all)
select trial, region, k, {q(f'k * {FS} / 32')} as freq, {q(f'avg(p) * (case when k = 0 or k = 16 then 1 else 2 end) / ({FS} * 12.0)', 8)} as mag from ft group by trial, region, k"""
query("spectrum_welch", WELCH)(lambda s, d: rounded(rounded(spec(s, d, method="welch", nperseg=32), "freq"), "mag", digits=8))
query("spectrum_average", f"{SPEC} select trial, 0 as region, k, {q('any_value(freq)')} as freq, {q('avg(mag)')} as mag from sp where k > 0 group by trial, k")(lambda s, d: rounded(P.average(spec(s, d).filter("k > 0")), "freq", "mag"))

STATS = {
    "spectral_distance": "sum(total * k / 32 - running) / any_value(bins)",
    "fundamental_frequency": "coalesce(min(case when k > 0 and mag >= 0.3 * highest and mag > before and after is not null and mag >= after then freq end), 0)",
    "max_frequency": "arg_max(freq, mag)",
    "max_psd": "max(mag)",
    "median_frequency": "min(case when running > total / 2 then freq end)",
    "spectral_centroid": "any_value(centre)",
    "spectral_kurtosis": "sum(pow(freq - centre, 4) * mag) / sum(mag) / pow(sum(pow(freq - centre, 2) * mag) / sum(mag), 2)",
    "spectral_variation": "1 - sum(mag * after) / sqrt(sum(after * after) * sum(case when after is not null then mag * mag end))",
    "spectral_spread": "sqrt(sum(pow(freq - centre, 2) * mag) / sum(mag))",
}
for name, sql in STATS.items():
    query(name, f"{HELPED} select trial, region, {q(sql)} as value from h group by trial, region")(lambda s, d, name=name: rounded(P.stats(spec(s, d), [name]).withColumnRenamed(name, "value"), "value"))
EIGHT = list(STATS)[:8]
query("spectrum_stats", f"{HELPED} select trial, region, {', '.join(f'{q(STATS[n])} as {n}' for n in EIGHT)} from h group by trial, region")(lambda s, d: rounded(P.stats(spec(s, d), EIGHT), *EIGHT))
BANDS = [(0.0, 4.0), (4.0, 8.0), (8.0, 12.0), (12.0, 30.0), (30.0, 70.0), (200.0, 300.0)]
VALUES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(BANDS))
query("spectrum_auc", f"{SPEC}, b as (select * from (values {VALUES}) x(band, lo, hi)), j as (select *, lead(mag) over (partition by trial, region, band order by k) as nx from sp join b on freq >= lo and freq < hi) select trial, region, band, {q('coalesce(sum((mag + nx) / 2), 0)')} as value from j group by all")(
    lambda s, d: rounded(P.band_auc(spec(s, d), BANDS), "value")
)
query("spectrum_moments", f'{SPEC}, m as (select *, mag - avg(mag) over (partition by trial, region) as x from sp) select trial, region, o as "order", {q("avg(pow(x, o))", 4)} as value from m cross join (select unnest([2, 3, 4, 5, 6]) as o) group by trial, region, o')(
    lambda s, d: rounded(P.moments(spec(s, d)), "value", digits=4)
)
query("freq_nearest", f"{SPEC} select trial, region, k, {q('freq')} as freq from (select *, row_number() over (partition by trial, region order by abs(freq - 10.0), k) as rn from sp) where rn = 1")(lambda s, d: rounded(P.nearest_bin(spec(s, d), 10.0).drop("mag"), "freq"))
INTERP = f"{SPEC}, nx as (select *, lead(freq) over (partition by trial, region order by k) as f2, lead(mag) over (partition by trial, region order by k) as m2 from sp), ip as (select trial, region, cast(g as int) as g, g * 0.5 as freq, case when f2 is null then mag else mag + (m2 - mag) * (g * 0.5 - freq) / (f2 - freq) end as mag from nx join (select unnest(range(0, 101)) as g) on g * 0.5 >= freq and (g * 0.5 < f2 or (f2 is null and g * 0.5 <= freq)))"
query("interp_join", f"{INTERP} select trial, region, g, {q('freq')} as freq, {q('mag')} as mag from ip where g > 0")(lambda s, d: rounded(P.interpolate(spec(s, d), 0.5).filter("g > 0"), "freq", "mag"))
query("psd_raw", f"{INTERP}, b as (select * from (values (0, 2.0, 8.0), (1, 20.0, 30.0)) x(band, lo, hi)) select trial, region, band, g, {q('mag / top')} as value from (select *, max(mag) over (partition by trial, region) as top from ip) join b on freq >= lo and freq < hi")(
    lambda s, d: rounded(P.psd_raw(spec(s, d), 0.5, [(2.0, 8.0), (20.0, 30.0)], normalize=True), "value")
)
query("spectrum_peak", f"{SPEC}, a as (select trial, k, any_value(freq) as freq, avg(mag) as mag from sp group by trial, k) select trial, {q('arg_max(freq, mag)')} as value from a group by trial")(lambda s, d: rounded(P.stats(P.average(spec(s, d)), ["max_frequency"]).select("trial", F.col("max_frequency").alias("value")), "value"))
MEL = ", ".join(f"({m}, {k}, {w!r})" for m, k, w in P.mel_weights(FS, 64, 10))
query(
    "mel_filterbank",
    f"""{SIG}, pe as (select trial, region, t, v - 0.97 * coalesce(lag(v) over (partition by trial, region order by t), 0) as x from sig),
pw as (select trial, region, k, (pow(sum(x * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * ((k * t) % 64) / 64)), 2)) / 64 as p from pe cross join (select unnest(range(0, 33)) as k) group by all),
w as (select * from (values {MEL}) x(m, k, weight)) select trial, region, m, {q('20 * log10(greatest(sum(weight * p), 2.220446049250313e-16))', 4)} as db from pw join w using (k) group by trial, region, m""",
)(lambda s, d: rounded(P.filterbank(sig(s, d), FS), "db", digits=4))
query("lpc")(lambda s, d: kernels.per_series(recs(s, d), kernels.lpc).select("trial", "region", F.posexplode("v").alias("k", "value")))
ENVELOPE = " union all ".join(f"select trial, region, 'env_{short}_{k}' as label, {q(f'{f}({c})')} as value from an group by trial, region" for short, c in (("amp", "amp"), ("ph", "phase")) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("median", "median"), ("max", "max"), ("min", "min")))
query("calc_envelope", f"{SIG}, {hilbert('sig')} {ENVELOPE}")(lambda s, d: rounded(P.envelope(kernels.analytic_signal(recs(s, d))), "value"))
query("band_pass")(lambda s, d: rounded(kernels.band_pass(recs(s, d)).select("trial", "region", F.posexplode("v").alias("t", "v")), "v"))
query("iir_filter")(lambda s, d: rounded(kernels.iir_filter(recs(s, d), FS, 5.0, 20.0, order=4).select("trial", "region", F.posexplode("v").alias("t", "v")), "v"))


def _taps(widths, n):
    """(width, o, weight): what sample t + o adds to the coefficient at t."""
    rows = []
    for w in widths:
        taps = kernels.ricker(min(10 * w, n), w)
        first = (len(taps) - 1) // 2
        rows += [(w, i - (len(taps) - 1 - first), float(x)) for i, x in enumerate(taps)]
    return ", ".join(f"({w}, {o}, {x!r})" for w, o, x in rows)


CWT = f"{SIG}, tp as (select * from (values {_taps(range(1, 10), 64)}) x(width, o, weight)), cw as (select a.trial, a.region, tp.width, a.t, sum(b.v * tp.weight) as c from sig a cross join tp join sig b on b.trial = a.trial and b.region = a.region and b.t = a.t + tp.o group by all)"
query("cwt", f"{CWT} select trial, region, width, t, {q('c')} as c from cw")(lambda s, d: rounded(P.cwt(recs(s, d)), "c"))
for name, column, sql in (("wavelet_abs_mean", "abs_mean", "abs(avg(c))"), ("wavelet_std", "std", "stddev_pop(c)"), ("wavelet_energy", "energy", "sqrt(avg(c * c))")):
    query(name, f"{CWT} select trial, region, width, {q(sql)} as value from cw group by trial, region, width")(lambda s, d, column=column: rounded(P.wavelet_stats(P.cwt(recs(s, d))).select("trial", "region", "width", F.col(column).alias("value")), "value"))
