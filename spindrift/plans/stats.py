"""Sources, filters, statistics and window operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import signal as S
from spindrift.operators import stats as A
from spindrift.operators import states
from spindrift.plans.base import DAILY, R, SIG, daily, q, query, recs, rounded, sig, table

OUT = "trial, region, t, v"
query("src_array", f"{SIG} select {OUT} from sig")(sig)
query("from_events", f"{DAILY} select trial, region, t, {q('v')} as v from sig")(lambda s, d: rounded(daily(s, d), "v"))

WIDE = """with w as (select l_returnflag as trial, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as t, l_quantity, l_extendedprice, l_discount, l_tax from lineitem)
select trial, region, cast(t as int) as t, v from (select trial, t, 0 as region, cast(l_quantity as double) as v from w union all select trial, t, 1, cast(l_extendedprice as double) from w
union all select trial, t, 2, cast(l_discount as double) from w union all select trial, t, 3, cast(l_tax as double) from w)"""


@query("src_wide", WIDE)
def src_wide(spark, d):
    items = S.number_rows(table(spark, d, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumnRenamed("region", "t")
    return S.from_wide(items, "l_returnflag", "t", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


# Filters and projections
GATED = f"{SIG}, bad as (select trial, region, t, case when trial = 3 and region = 1 and t = 5 then 'nan'::double when trial = 4 and t = 0 and region = 0 then 'inf'::double else v end as v from sig), ok as (select trial, bool_and(isfinite(v)) as ok from bad group by trial)"


def _spoilt(spark, d):
    """The signal with a NaN in one trial and an infinity in another."""
    at = lambda trial, region, t: (F.col("trial") == trial) & (F.col("region") == region) & (F.col("t") == t)
    return sig(spark, d).withColumn("v", F.when(at(3, 1, 5), float("nan")).when(at(4, 0, 0), float("inf")).otherwise(F.col("v")))


query("finite_gate", f"{GATED} select trial, ok from ok")(lambda s, d: S.finite_trials(_spoilt(s, d)))
query("finite_gate_values", f"{GATED} select trial, region, case when ok then {q('avg(v)')} end as value from bad join ok using (trial) where ok group by trial, region, ok")(
    lambda s, d: rounded(A.region_stats(_spoilt(s, d), ["calc_mean"]).filter(~F.isnan("calc_mean")).select("trial", "region", F.col("calc_mean").alias("value")), "value")
)
query("region_select", f"{SIG} select {OUT} from sig where region in (0, 2, 5)")(lambda s, d: S.region_select(sig(s, d), [0, 2, 5]))
query("transient_cut", f"{SIG} select trial, region, cast(row_number() over (partition by trial, region order by t) - 1 as int) as t, v from sig where t * 0.5 > 10")(lambda s, d: S.transient_cut(sig(s, d), 0.5, 10.0))
query("decimate", f"{SIG} select trial, region, cast(t // 4 as int) as t, v from sig where t % 4 = 0")(lambda s, d: S.decimate(sig(s, d), 4))
query("offset_trim", f"{SIG} select {OUT} from sig where t >= 7")(lambda s, d: S.offset_trim(sig(s, d), 7))

# Normalisation
PER = "over (partition by trial, region)"
FORMS = {
    "zscore": (S.zscore, f"(v - avg(v) {PER}) / stddev_pop(v) {PER}"),
    "minmax": (S.minmax, f"(v - min(v) {PER}) / (max(v) {PER} - min(v) {PER})"),
    "maxnorm": (S.maxnorm, f"v / max(v) {PER}"),
    "demean": (S.demean, f"v - avg(v) {PER}"),
    "detrend": (S.detrend, f"v - regr_slope(v, t) {PER} * t - regr_intercept(v, t) {PER}"),
    "clip_artefacts": (lambda x: S.clip_artefacts(x, 1.0), f"least(greatest(v, -stddev_pop(v) {PER}), stddev_pop(v) {PER})"),
}
for name, (form, sql) in FORMS.items():
    query(name, f"{SIG} select trial, region, t, {q(sql)} as v from sig")(lambda s, d, form=form: rounded(form(sig(s, d)), "v"))

CHAIN = {"zscores": {}, "offset": {"value": 4}, "demean": {}, "detrend": {}, "remove_strong_artefacts": {"threshold": 1.5}}
query(
    "preprocess_chain",
    f"""{SIG}, a as (select trial, region, t, (v - avg(v) {PER}) / stddev_pop(v) {PER} as v from sig), b as (select * from a where t >= 4),
c as (select trial, region, t, v - avg(v) {PER} as v from b), e as (select trial, region, t, v - regr_slope(v, t) {PER} * t - regr_intercept(v, t) {PER} as v from c)
select trial, region, t, {q(f'least(greatest(v, -1.5 * stddev_pop(v) {PER}), 1.5 * stddev_pop(v) {PER})')} as v from e""",
)(lambda s, d: rounded(S.preprocess(sig(s, d), CHAIN), "v"))

# Statistics of each series
M2, M3, M4 = (f"avg(pow(v - m, {k}))" for k in (2, 3, 4))
HELPED = f"""{SIG}, h as (select *, avg(v) {PER} as m, median(v) {PER} as med, avg(v) over (partition by trial) as tm,
lead(v) over (partition by trial, region order by t) - v as d, sign(v) <> lag(sign(v)) over (partition by trial, region order by t) as s from sig)"""
STATS = {
    "abs_energy": "sum(v * v)",
    "average_power": "sum(v * v) / (max(t) - min(t))",
    "calc_mean": "avg(v)",
    "calc_var": "var_pop(v)",
    "calc_std": "stddev_pop(v)",
    "calc_skewness": f"{M3} / pow({M2}, 1.5)",
    "calc_kurtosis": f"{M4} / pow({M2}, 2) - 3",
    "calc_max": "max(v)",
    "calc_min": "min(v)",
    "calc_median": "median(v)",
    "mean_abs_dev": "avg(abs(v - m))",
    "median_abs_dev": "median(abs(v - med))",
    "rms": "sqrt(avg(v * v))",
    "interq_range": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)",
    "burstiness": "case when any_value(tm) = 0 then 0 else (stddev_pop(v) / avg(v) - 1) / (stddev_pop(v) / avg(v) + 1) end",
    "calc_centroid": "sum(t * v * v) / sum(v * v)",
    "zero_crossing": "cast(sum(case when s then 1 else 0 end) as double)",
    "seizure_onset": "cast(case when max(d) < 0.02 then 0 else arg_min(t, struct_pack(a := -coalesce(d, -1e300), b := t)) end as double)",
    "auc": "sum(v + d / 2)",
}
for name, sql in STATS.items():
    digits = 3 if name == "burstiness" else 6
    query(name, f"{HELPED} select trial, region, {q(sql, digits)} as value from h group by trial, region")(
        lambda s, d, name=name, digits=digits: A.region_stats(sig(s, d), [name]).select("trial", "region", R(F.col(name), digits).alias("value"))
    )

query("calc_moments", f"{HELPED} select trial, region, k, {q('avg(pow(v - m, k))')} as value from h cross join (select unnest([2, 3, 4, 5, 6]) as k) group by trial, region, k")(lambda s, d: rounded(A.moments(sig(s, d)), "value"))
query("calc_ecdf", f"{SIG} select trial, region, cast(row_number() over (partition by trial, region order by v, t) as int) as rank, v, row_number() over (partition by trial, region order by v, t) / count(*) {PER} as p from sig")(lambda s, d: A.ecdf(sig(s, d)))
LIMITS = [(0, 10), (10, 20.5), (60, 80), (100, 200)]
query(
    "auc_lim",
    f"""{SIG}, lim as (select * from (values (0, 0.0, 10.0), (1, 10.0, 20.5), (2, 60.0, 80.0), (3, 100.0, 200.0)) x(interval, lo, hi)),
st as (select *, lead(v) over (partition by trial, region order by t) as nv, lead(t) over (partition by trial, region order by t) as nt from sig)
select trial, region, interval, {q('sum(case when nt <= hi then (v + nv) / 2 * (nt - t) else 0 end)')} as value from st join lim on t >= lo and t <= hi group by all""",
)(lambda s, d: rounded(A.auc_limits(sig(s, d), LIMITS), "value"))
query("kop", f"{SIG}, o as (select trial, t, sqrt(pow(avg(cos(v)), 2) + pow(avg(sin(v)), 2)) as r from sig group by all having count(*) >= 2) select trial, {q('avg(r)')} as value from o group by trial")(lambda s, d: rounded(A.kuramoto(sig(s, d)), "value"))
query("kop_series", f"{SIG} select trial, t, {q('sqrt(pow(avg(cos(v)), 2) + pow(avg(sin(v)), 2))')} as value from sig group by trial, t having count(*) >= 2")(lambda s, d: rounded(A.kuramoto(sig(s, d), mean=False), "value"))
ACF = f"{SIG}, c as (select trial, region, t, v - avg(v) {PER} as x from sig), acf as (select a.trial, a.region, l.lag, sum(a.x * b.x) / any_value(p.p) as value from c a cross join (select unnest(range(0, 41)) as lag) l join c b on b.trial = a.trial and b.region = a.region and b.t = a.t + l.lag join (select trial, region, sum(x * x) as p from c group by all) p on p.trial = a.trial and p.region = a.region group by all)"
query("autocorr_norm", f"{ACF} select trial, region, cast(lag as int) as lag, {q('value')} as value from acf")(lambda s, d: rounded(A.autocorrelation(sig(s, d), 40), "value"))

# State paths: quarters of the value range
PATH = f"{SIG}, st as (select trial, region, t, cast(least(floor((v - lo) / (hi - lo) * 4), 3) as int) as state from (select *, min(v) {PER} as lo, max(v) {PER} as hi from sig))"
RUNS = f"{PATH}, ch as (select *, case when state = lag(state) over (partition by trial, region order by t) then 0 else 1 end as c from st), ru as (select trial, region, cast(sum(c) over (partition by trial, region order by t) as int) as run, state from ch), runs as (select trial, region, run, state, count(*) as length from ru group by all)"


def path(spark, d):
    low, high = F.min("v").over(S.series()), F.max("v").over(S.series())
    return sig(spark, d).select("trial", "region", "t", F.least(F.floor((F.col("v") - low) / (high - low) * 4), F.lit(3)).cast("int").alias("state"))


query("state_runs", f"{RUNS} select trial, region, run, state, length from runs")(lambda s, d: states.runs(path(s, d)))
query("state_transition", f"{PATH}, p as (select trial, region, state as source, lead(state) over (partition by trial, region order by t) as target from st), n as (select trial, region, source, target, count(*) as n from p where target is not null group by all) select trial, region, source, target, {q('n / sum(n) over (partition by trial, region, source)')} as p from n")(lambda s, d: rounded(states.transitions(path(s, d)), "p"))
DURATION = f"""{RUNS}, grid as (select trial, region, state, bin from (select distinct trial, region from sig) cross join (select unnest(range(0, 4)) as state) cross join (select unnest(range(0, 5)) as bin)),
n as (select trial, region, state, cast(least(floor(length / 20.0 * 5), 4) as int) as bin, count(*) as n from runs where length <= 20 group by all)"""
query("state_duration", f"{DURATION} select trial, region, cast(g.bin as int) as bin, {q('sum(coalesce(n, 0)) / 4.0')} as value from grid g left join n using (trial, region, state, bin) group by all")(lambda s, d: rounded(states.durations(path(s, d), 4, bins=5, longest=20), "value"))
query("hmm_stat", f"{DURATION}, p as (select trial, region, state as source, lead(state) over (partition by trial, region order by t) as target from st), tr as (select trial, region, source, target, count(*) as n from p where target is not null group by all) select trial, region, 'duration_' || cast(g.bin as int) as label, {q('sum(coalesce(n, 0)) / 4.0')} as value from grid g left join n using (trial, region, state, bin) group by trial, region, g.bin union all select trial, region, 'transition_' || source || '_' || target, {q('n / sum(n) over (partition by trial, region, source)')} from tr")(
    lambda s, d: rounded(states.summary(path(s, d), 4, bins=5, longest=20), "value")
)
query("hmm_fit")(lambda s, d: states.fit_hmm(recs(s, d), 4, rounds=8))
