"""Canonical characteristics as queries, each on the z-scored signal."""

from __future__ import annotations

from spindrift.operators import catch22 as K
from spindrift.plans.base import SIG, q, query, recs, rounded, sig

PER = "over (partition by trial, region)"
ZS = f"{SIG}, z as (select trial, region, t, (v - avg(v) {PER}) / stddev_pop(v) {PER} as v from sig)"
W = "over (partition by trial, region order by t)"
LAGS = "over (partition by trial, region order by lag)"


def acf(source: str) -> str:
    """Autocorrelation at all lags of a table."""
    return f"""c{source} as (select trial, region, t, v - avg(v) {PER} as x from {source}), a{source} as (select a.trial, a.region, l.lag, sum(a.x * b.x) / any_value(p.p) as value, any_value(p.n) as size from c{source} a cross join (select unnest(range(0, (select max(t) + 1 from sig))) as lag) l
join c{source} b on b.trial = a.trial and b.region = a.region and b.t = a.t + l.lag join (select trial, region, sum(x * x) as p, count(*) as n from c{source} group by all) p on p.trial = a.trial and p.region = a.region group by all)"""


ACF = f"{ZS}, {acf('z')}, n as (select *, lag(value) {LAGS} as before, lead(value) {LAGS} as after from az)"
OUT = "group by trial, region"


def mode(bins: int) -> str:
    return f"""{ZS}, p as (select *, min(v) {PER} as lo, (max(v) {PER} - min(v) {PER}) / {bins} as w from z), c as (select trial, region, least(floor((v - lo) / w), {bins - 1}) as b, count(*) as c, any_value(lo) as lo, any_value(w) as w from p group by 1, 2, 3),
f as (select *, max(c) {PER} as top from c) select trial, region, {q('avg(lo + w * (b + 0.5))')} as value from f where c = top {OUT}"""


def stretch(state: str, wanted: int) -> str:
    return f"{ZS}, s as ({state}), ch as (select *, case when s = lag(s) {W} then 0 else 1 end as c from s), ru as (select trial, region, s, sum(c) {W} as run from ch), l as (select trial, region, s, run, count(*) as n from ru group by all) select trial, region, cast(coalesce(max(n) filter (s = {wanted}), 0) as double) as value from l {OUT}"


LETTERS = f"{ZS}, lt as (select trial, region, t, floor((row_number() over (partition by trial, region order by v, t) - 1) * 3 / count(*) {PER}) as letter from z), pr as (select trial, region, letter, lead(letter) {W} as next from lt), n as (select trial, region, letter, next, count(*) as n from pr where next is not null group by all), p as (select *, n / sum(n) {PER} as p from n)"
RESIDUAL = f"{ZS}, r as (select trial, region, t, v - avg(v) over (partition by trial, region order by t rows between {{n}} preceding and 1 preceding) as v from z where true qualify count(v) over (partition by trial, region order by t rows between {{n}} preceding and 1 preceding) = {{n}})"
ZERO = "select trial, region, coalesce(min(lag) filter (value <= 0), any_value(size)) as f from {t} group by trial, region"
#: First zero of the autocorrelation of each series.
ZEROS = f"{ZS}, {acf('z')}, fz as (select trial, region, any_value(size) as size, coalesce(min(lag) filter (value <= 0), any_value(size)) as tau from az group by trial, region)"
TRANSITIONS = f"""{ZEROS}, y as (select trial, region, t // greatest(tau, 1) as s, v from z join fz using (trial, region) where t % greatest(tau, 1) = 0), lt as (select trial, region, s, floor((row_number() over (partition by trial, region order by v, s) - 1) * 3 / count(*) {PER}) as letter from y),
pr as (select trial, region, letter as a, lead(letter) over (partition by trial, region order by s) as b from lt), tb as (select s.trial, s.region, a.a, b.b, count(pr.a) as n from (select distinct trial, region from sig) s cross join (select unnest([0, 1, 2]) as a) a cross join (select unnest([0, 1, 2]) as b) b left join pr on pr.trial = s.trial and pr.region = s.region and pr.a = a.a and pr.b = b.b group by all),
sh as (select trial, region, b, n / greatest(sum(n) {PER}, 1) as p from tb), cl as (select trial, region, b, var_samp(p) as s from sh group by all) select trial, region, {q('sum(s)')} as value from cl {OUT}"""


def outliers(sign: str) -> str:
    """Over all levels k / 100, the median of the median places of the points beyond."""
    return f"""{ZS}, lv as (select unnest(range(0, (select cast(ceil(max(abs(v)) * 100) as int) + 2 from z))) as k), sz as (select trial, region, count(*) as n from z group by all), md as (select trial, region, k, median(t + 1) as m, count(*) as c from z join lv on {sign}v >= k * 0.01::double group by all)
select trial, region, {q('coalesce(median(m / (n / 2.0) - 1), 0)')} as value from sz left join md on md.trial = sz.trial and md.region = sz.region and c >= greatest(2, 0.02 * n) group by sz.trial, sz.region""".replace("select trial, region, (round(coalesce", "select sz.trial, sz.region, (round(coalesce")


EMBEDDED = f"""{ZEROS}, d as (select a.trial, a.region, a.t, sqrt(pow(b.v - a.v, 2) + pow(d.v - c.v, 2)) as d from z a join fz using (trial, region) join z b on b.trial = a.trial and b.region = a.region and b.t = a.t + 1
join z c on c.trial = a.trial and c.region = a.region and c.t = a.t + least(tau, greatest(1, size // 10)) join z d on d.trial = a.trial and d.region = a.region and d.t = c.t + 1),
st as (select trial, region, count(*) as n, avg(d) as m, min(d) as lo, max(d) as hi, greatest(1, ceil((max(d) - min(d)) / (3.5 * stddev_pop(d) / pow(count(*), 1.0 / 3)))) as bins from d group by all),
ct as (select trial, region, least(floor((d - lo) / ((hi - lo) / bins)), bins - 1) as k, count(*) as c from d join st using (trial, region) group by all),
gr as (select st.*, unnest(range(0, cast(bins as int))) as k from st)
select trial, region, {q('avg(abs(coalesce(c, 0) / n - exp(-(lo + (k + 0.5) * (hi - lo) / bins) / m) / m))')} as value from gr left join ct using (trial, region, k) {OUT}"""
#: One-sided power at angular frequencies 2 pi k / n, whole series as one segment.
POWER = f"""{ZS}, sz as (select trial, region, count(*) as n from z group by all), ft as (select trial, region, k, n, n // 2 + 1 as bins, pow(sum(v * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * t) % n) / n)), 2) as m from z join sz using (trial, region) cross join (select unnest(range(0, (select max(t) // 2 + 2 from sig))) as k) group by all),
p as (select trial, region, k, n, bins, m / n * case when k = 0 or 2 * k = n then 1 else 2 end / (2 * pi()) as p from ft where k < bins)"""
SQL = {
    "DN_HistogramMode_5": mode(5),
    "DN_HistogramMode_10": mode(10),
    "CO_f1ecac": f"{ACF} select trial, region, {q('coalesce(min(case when value < exp(-1) and before >= exp(-1) then lag - 1 + (exp(-1) - before) / (value - before) end), any_value(size))')} as value from n {OUT}",
    "CO_FirstMin_ac": f"{ACF} select trial, region, cast(coalesce(min(lag) filter (lag > 0 and value < before and value < after), any_value(size)) as double) as value from n {OUT}",
    "CO_HistogramAMI_even_2_5": f"{ZS}, b as (select trial, region, t, least(floor((v - (min(v) {PER} - 0.1)) / (max(v) {PER} - min(v) {PER} + 0.2) * 5), 4) as b from z), j as (select trial, region, b, lead(b, 2) {W} as c from b), n as (select trial, region, b, c, count(*) as n from j where c is not null group by all), m as (select *, sum(n) {PER} as total, sum(n) over (partition by trial, region, b) as nb, sum(n) over (partition by trial, region, c) as nc from n) select trial, region, {q('sum(n / total * ln(n * total / (nb * nc)))')} as value from m {OUT}",
    "CO_trev_1_num": f"{ZS}, d as (select trial, region, lead(v) {W} - v as d from z) select trial, region, {q('avg(pow(d, 3))')} as value from d {OUT}",
    "MD_hrv_classic_pnn40": f"{ZS}, d as (select trial, region, abs(lead(v) {W} - v) * 1000 as d from z) select trial, region, {q('avg(case when d > 40 then 1.0::double else 0 end)')} as value from d where d is not null {OUT}",
    "SB_BinaryStats_mean_longstretch1": stretch(f"select trial, region, t, case when v > avg(v) {PER} then 1 else 0 end as s from z", 1),
    "SB_BinaryStats_diff_longstretch0": stretch(f"select trial, region, t, case when d >= 0 then 1 else 0 end as s from (select trial, region, t, lead(v) {W} - v as d from z) where d is not null", 0),
    "SB_MotifThree_quantile_hh": f"{LETTERS} select trial, region, {q('-sum(p * ln(p))')} as value from p {OUT}",
    "IN_AutoMutualInfoStats_40_gaussian_fmmi": f"{ZS}, {acf('z')}, m as (select trial, region, lag, -0.5 * ln(greatest(1 - value * value, 1e-300)) as m from az where lag between 1 and 40), n as (select *, lag(m) {LAGS} as before, lead(m) {LAGS} as after from m) select trial, region, cast(coalesce(min(lag) filter (m < before and m < after), 40) as double) as value from n {OUT}",
    "FC_LocalSimple_mean1_tauresrat": f"{RESIDUAL.format(n=1)}, {acf('z')}, {acf('r')}, f1 as ({ZERO.format(t='ar')}), f2 as ({ZERO.format(t='az')}) select f1.trial, f1.region, {q('f1.f / f2.f')} as value from f1 join f2 using (trial, region)",
    "FC_LocalSimple_mean3_stderr": f"{RESIDUAL.format(n=3)} select trial, region, {q('stddev_samp(v)')} as value from r {OUT}",
    "SP_Summaries_welch_rect_area_5_1": f"{POWER} select trial, region, {q('sum(p) filter (k < bins // 5) * 2 * pi() / any_value(n)')} as value from p {OUT}",
    "SP_Summaries_welch_rect_centroid": f"{POWER} select trial, region, {q('min(2 * pi() * k / n) filter (running > total / 2)')} as value from (select *, sum(p) over (partition by trial, region order by k) as running, sum(p) {PER} as total from p) {OUT}",
    "SB_TransitionMatrix_3ac_sumdiagcov": TRANSITIONS,
    "DN_OutlierInclude_p_001_mdrmd": outliers(""),
    "DN_OutlierInclude_n_001_mdrmd": outliers("-"),
    "CO_Embed2_Dist_tau_d_expfit_meandiff": EMBEDDED,
    "DN_Mean": f"{SIG} select trial, region, {q('avg(v)')} as value from sig {OUT}",
    "DN_Spread_Std": f"{SIG} select trial, region, {q('stddev_samp(v)')} as value from sig {OUT}",
}
for name in K.NAMES:
    query(name, SQL.get(name))(lambda s, d, name=name: rounded(K.feature(name, sig(s, d), recs(s, d)), "value"))
