"""Connectivity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import connectivity as C
from spindrift.operators import costs
from spindrift.operators import kernels
from spindrift.plans.base import hilbert, q, query, recs, rounded, SIG, sig, table

Z = f"{SIG}, z as (select trial, region, t, (v - avg(v) over (partition by trial, region)) / stddev_pop(v) over (partition by trial, region) as v from sig)"
FC = f"{Z}, fc as (select a.trial, a.region as i, b.region as j, avg(a.v * b.v) as w from z a join z b on a.trial = b.trial and a.t = b.t and a.region < b.region group by all), n as (select trial, max(region) + 1 as n from sig group by trial)"
FULL = f"{FC}, f as (select trial, i, j, w from fc union all select trial, j, i, w from fc union all select trial, region, region, 0.0 from (select distinct trial, region from sig))"


def seven(source: str, where: str = "true", digits: int = 4) -> str:
    m = ", ".join(f"avg(pow(w - m, {k})) as m{k}" for k in (2, 3, 4))
    return f"""select trial, {q('s', digits)} as sum, {q('hi')} as max, {q('lo')} as min, {q('mean')} as mean, {q('sqrt(m2)')} as std, {q('m3 / pow(m2, 1.5)', digits)} as skewness, {q('m4 / pow(m2, 2) - 3', digits)} as kurtosis
from (select trial, sum(w) as s, max(w) as hi, min(w) as lo, avg(w) as mean, {m} from (select *, avg(w) over (partition by trial) as m from {source} where {where}) group by trial)"""


def even(df, digits=4):
    """Rounded as in seven."""
    return rounded(rounded(df, "max", "min", "mean", "std"), "sum", "skewness", "kurtosis", digits=digits)


def fc(s, d, **k):
    return C.fc_matrix(recs(s, d), **k)


query("region_pair_join", f"{SIG} select a.trial, a.region as i, b.region as j, {q('sum(a.v * b.v)')} as value from sig a join sig b on a.trial = b.trial and a.t = b.t and a.region < b.region group by all")(
    lambda s, d: C.inner_products(sig(s, d), digits=6)
)
query("fc_matrix", f"{FC} select trial, i, j, {q('w')} as w from fc")(lambda s, d: fc(s, d, digits=6))
query("fc_cov", f"{SIG} select a.trial, a.region as i, b.region as j, {q('covar_samp(a.v, b.v)')} as w from sig a join sig b on a.trial = b.trial and a.t = b.t and a.region < b.region group by all")(lambda s, d: fc(s, d, kind="cov", digits=6))
query("torch_corr", f"{FC} select trial, i, j, {q('w')} as w from fc")(lambda s, d: C.fc_join(sig(s, d), digits=6))
query("torch_corr2", f"{SIG} select a.trial, a.region as i, b.region as j, {q('corr(a.v, b.v)')} as w from sig a join sig b on a.trial = b.trial and a.t = b.t where a.region % 2 = 0 and b.region % 2 = 1 group by all")(
    lambda s, d: rounded(C.corr_between(sig(s, d).filter("region % 2 = 0"), sig(s, d).filter("region % 2 = 1")), "w")
)
query("fc_sum", f"{FC} select trial, {q('2 * sum(abs(w))', 4)} as value from fc group by trial")(lambda s, d: rounded(C.matrix_stats(recs(s, d)).select("trial", F.col("total").alias("value")), "value", digits=4))
query("fc_homotopic", f"{FC} select trial, {q('avg(greatest(w, 0))')} as value from fc join n using (trial) where j = i + n // 2 and i < n // 2 group by trial")(lambda s, d: rounded(C.homotopic(recs(s, d)), "value"))
query("matrix_stat_ut", f"{FC} {seven('fc', 'j >= i + 1')}")(lambda s, d: even(C.matrix_stats(recs(s, d)).drop("total")))
query("fc_stat", f"{FULL} {seven('f', 'j >= i')}")(lambda s, d: even(C.matrix_stats(recs(s, d), 0).drop("total")))
query("matrix_stat_quantile", f"{FULL} select trial, {q('quantile_cont(w, 0.05)')} as q05, {q('quantile_cont(w, 0.5)')} as q50, {q('quantile_cont(w, 0.95)')} as q95 from f group by trial")(
    lambda s, d: rounded(C.matrix_quantiles(recs(s, d), [0.05, 0.5, 0.95]).toDF("trial", "q05", "q50", "q95"), "q05", "q50", "q95")
)
query("matrix_stat_sum", f"{FC} select trial, {q('2 * sum(abs(w))', 4)} as value from fc group by trial")(lambda s, d: rounded(C.matrix_stats(recs(s, d)).select("trial", F.col("total").alias("value")), "value", digits=4))
query("matrix_stat_eig")(lambda s, d: rounded(C.matrix_kernel(recs(s, d), "eig"), *kernels.SEVEN, digits=4))
query("matrix_stat_pca")(lambda s, d: rounded(C.matrix_kernel(recs(s, d), "pca"), *kernels.SEVEN, digits=4))

HALF = "case when (i < n // 2) = (j < n // 2) then 'intrah' else 'interh' end"
GRID = f"{SIG}, n as (select trial, max(region) + 1 as n from sig group by trial), g as (select a.trial, a.region as i, b.region as j, n from (select distinct trial, region from sig) a join (select distinct trial, region from sig) b on a.trial = b.trial and a.region <> b.region join n on n.trial = a.trial)"


def own(s, d):
    return C.sizes(recs(s, d))


query("mask_custom", f"{GRID} select trial, i, j from g where i % 3 = 0 and j % 3 = 0")(lambda s, d: C.mask_pairs(own(s, d), wanted=F.expr("i % 3 = 0 and j % 3 = 0")))
for name in ("intrah", "interh"):
    query(f"mask_{name}", f"{GRID} select trial, i, j from g where {HALF} = '{name}'")(lambda s, d, name=name: C.mask_pairs(own(s, d), name))
query("masks_named", f"{GRID} select trial, 'full' as mask, count(*) as n from g group by 1 union all select trial, {HALF}, count(*) from g group by 1, 2")(
    lambda s, d: C.mask_counts(own(s, d))
)
query("mask_join", f"{FC} select trial, i, j, {q('w')} as w from fc join n using (trial) where {HALF} = 'interh'")(lambda s, d: fc(s, d, digits=6, mask="interh"))
query("set_k_diagonals", f"{FC} select trial, i, j, {q('case when abs(i - j) <= 2 then -1.0 else w end')} as w from fc")(lambda s, d: C.set_k_diagonals(fc(s, d, digits=6), 2, -1.0))
query("is_symmetric", f"{FULL} select trial, true as ok from f group by trial")(lambda s, d: C.matrix_symmetric(recs(s, d)))

NATIONS = "e as (select a.n_nationkey as src, b.n_nationkey as dst, cast(case when (a.n_nationkey * 7 + b.n_nationkey * 3) % 4 = 0 then 0 else ((a.n_nationkey + 1) * (b.n_nationkey + 2)) % 11 end as double) as weight, cast(abs(a.n_nationkey - b.n_nationkey) as double) * 1.5 as length from nation a, nation b where a.n_nationkey <> b.n_nationkey)"


def nation_edges(s, d):
    """A connectome among nations: weights and lengths derived from their keys."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("src"))
    a, b = F.col("src"), F.col("dst")
    pairs = n.crossJoin(F.broadcast(n.withColumnRenamed("src", "dst"))).filter("src <> dst")
    weight = F.when((a * 7 + b * 3) % 4 == 0, 0).otherwise((a + 1) * (b + 2) % 11).cast("double")
    return pairs.select("src", "dst", weight.alias("weight"), (F.abs(a - b).cast("double") * 1.5).alias("length"))


query("csr_edges", f"with {NATIONS}, k as (select * from e where weight <> 0), c as (select src, count(*) as n from k group by src), st as (select src, sum(n) over (order by src) - n as row_start from c) select cast(src as int) as src, cast(dst as int) as dst, weight, cast(floor(length) as int) + 2 as delay, cast(row_start as bigint) as row_start from k join st using (src)")(
    lambda s, d: C.csr_edges(nation_edges(s, d))
)
query("connectome_norm", f"with {NATIONS}, x as (select src, dst, case when src = dst then 0 else weight - 3 end as w from e) select cast(src as int) as src, cast(dst as int) as dst, {q('greatest(w / (select max(w) from x), 0)')} as weight from x")(
    lambda s, d: rounded(costs.connectome_norm(nation_edges(s, d).withColumn("weight", F.col("weight") - 3)), "weight")
)

WINDOW = 40
SLIDE = f"{SIG}, pr as (select a.trial, a.t, a.region as i, b.region as j, a.v as x, b.v as y from sig a join sig b on a.trial = b.trial and a.t = b.t and a.region < b.region), sl as (select p.trial, w.w0, p.i, p.j, corr(p.x, p.y) as w from pr p join (select unnest(range(0, {64 - WINDOW + 1})) as w0) w on p.t >= w.w0 and p.t < w.w0 + {WINDOW} group by all)"
query("sliding_fc", f"{SLIDE} select trial, cast(w0 as int) as w0, i, j, {q('w', 5)} as w from sl")(lambda s, d: C.sliding_fc(recs(s, d), WINDOW, digits=5))
STRIDED = SLIDE.replace(f"range(0, {64 - WINDOW + 1})", "range(0, 33, 8)").replace(f"+ {WINDOW}", "+ 32")
query("sliding_fc_strided", f"{STRIDED} select trial, cast(w0 as int) as w0, i, j, {q('w', 5)} as w from sl")(lambda s, d: C.sliding_fc_strided(recs(s, d), 32, 0.75, digits=5))
SHORT = SLIDE.replace(f"range(0, {64 - WINDOW + 1})", "range(0, 33)").replace(f"+ {WINDOW}", "+ 32")
FCD = f"{SHORT}, fcd as (select a.trial, cast(a.w0 as int) as i, cast(b.w0 as int) as j, corr(a.w, b.w) as w from sl a join sl b on a.trial = b.trial and a.i = b.i and a.j = b.j and a.w0 < b.w0 group by all)"
query("window_pair_join", f"{STRIDED} select a.trial, cast(a.w0 // 8 as int) as i, cast(b.w0 // 8 as int) as j, {q('corr(a.w, b.w)', 5)} as w from sl a join sl b on a.trial = b.trial and a.i = b.i and a.j = b.j and a.w0 < b.w0 group by all")(lambda s, d: rounded(C.fcd_strided(recs(s, d), 32, 0.75), "w", digits=5))
query("fcd_strided", f"{STRIDED} select a.trial, cast(a.w0 // 8 as int) as i, cast(b.w0 // 8 as int) as j, {q('corr(a.w, b.w)', 5)} as w from sl a join sl b on a.trial = b.trial and a.i = b.i and a.j = b.j and a.w0 < b.w0 group by all")(lambda s, d: rounded(C.fcd_strided(recs(s, d), 32, 0.75), "w", digits=5))
query("fcd_matrix", f"{FCD} select trial, i, j, {q('w', 5)} as w from fcd")(lambda s, d: rounded(C.fcd_matrix(recs(s, d), 32), "w", digits=5))
query("fcd_stat", f"{FCD} {seven('fcd', 'j >= i + 16', 3)}")(lambda s, d: even(C.stat_ut(C.fcd_matrix(recs(s, d), 32), 16), 3))
query("fluidity", f"{FCD} select trial, {q('var_pop(w)', 5)} as value from fcd where j >= i + 16 group by trial")(lambda s, d: rounded(C.fluidity(C.fcd_matrix(recs(s, d), 32), 16), "value", digits=5))
PHASES = f"{SIG}, {hilbert('sig')}"
query("plv_matrix", f"{PHASES} select a.trial, a.region as i, b.region as j, {q('sqrt(pow(avg(cos(a.angle - b.angle)), 2) + pow(avg(sin(a.angle - b.angle)), 2))')} as w from an a join an b on a.trial = b.trial and a.t = b.t and a.region < b.region group by all")(lambda s, d: C.plv_matrix(recs(s, d), digits=6))
query("analytic_signal", f"{PHASES} select trial, region, t, {q('amp')} as amp, {q('phase')} as phase from an")(lambda s, d: rounded(kernels.analytic_signal(recs(s, d)), "amp", "phase"))
query("coactivation_degree", f"{Z}, s as (select trial, t, sum(v) as total, count(*) as n from z group by all) select z.trial, z.region, z.t, {q('v * (total - v) / (n - 1)')} as value from z join s on s.trial = z.trial and s.t = z.t")(lambda s, d: rounded(C.coactivation_degree(sig(s, d)), "value"))
WHOLE = f"{SIG}, gl as (select trial, region, t, v from sig union all select trial, -1, t, avg(v) from sig group by trial, t), {hilbert('gl')}"
query("coactivation_phase", f"{WHOLE}, df as (select b.trial, b.region, a.angle - b.angle as d from an a join an b on a.trial = b.trial and a.t = b.t where a.region = -1 and b.region >= 0) select trial, region, {q('avg(d - 2 * pi() * floor((d + pi()) / (2 * pi())))')} as value from df group by all")(lambda s, d: rounded(C.coactivation_phase(recs(s, d)), "value"))

# Comparison costs: trial 0 is the empirical recording; the others are three sets of three duplicates.
SIM = "select trial, (trial - 1) // 3 as set_id, i, j, w from fc where trial > 0"
query("fc_vectors", f"{FC} select trial, set_id, i, j, {q('w')} as w from ({SIM})")(lambda s, d: costs.simulated(C.fc_matrix(recs(s, d).filter("trial > 0"), digits=6)))
query("fc_dup_average", f"{FC} select set_id, i, j, {q('avg(w)')} as w from ({SIM}) group by all")(lambda s, d: costs.set_average(recs(s, d), digits=6))
query("fisher_z", f"{FC} select trial, i, j, {q('0.5 * ln((1 + w) / (1 - w))')} as z from fc")(lambda s, d: C.fisher_matrix(recs(s, d), digits=6))
COST = f"{FC}, sm as (select set_id, i, j, avg(w) as w from ({SIM}) group by all), pr as (select set_id, sm.i, sm.j, atanh(sm.w) as x, atanh(e.w) as y from sm join fc e on e.trial = 0 and e.i = sm.i and e.j = sm.j)"
query("emp_sim_join", f"{COST} select set_id, i, j, {q('x')} as x, {q('y')} as y from pr")(lambda s, d: costs.set_pairs(recs(s, d), digits=6))
query("fc_correlation_cost", f"{COST} select set_id, {q('coalesce(1 - corr(x, y), 10)')} as cost from pr group by set_id")(lambda s, d: rounded(costs.set_cost(recs(s, d)), "cost"))
BINS = 200
HIST = f"{FCD}, h as (select trial, cast(least(floor((w + 1) / 2 * {BINS}), {BINS - 1}) as int) as bin, count(*) as n from fcd group by all)"
query("fcd_histogram", f"{HIST} select trial, bin, n from h")(lambda s, d: costs.fcd_histogram(C.fcd_matrix(recs(s, d), 32), BINS))
KS = f"""{HIST}, grid as (select trial, bin from (select distinct trial from h) cross join (select cast(unnest(range(0, {BINS})) as int) as bin)),
p as (select g.trial, g.bin, coalesce(h.n, 0) as n from grid g left join h using (trial, bin)), c as (select trial, bin, sum(n) over (partition by trial order by bin) as c, sum(n) over (partition by trial) as total from p)"""
query("fcd_ks_cost", f"{KS}, sc as (select (trial - 1) // 3 as set_id, bin, avg(c) as c from c where trial > 0 group by all) select set_id, {q('max(abs(sc.c - e.c)) / any_value(e.total)')} as cost from sc join c e on e.trial = 0 and e.bin = sc.bin group by set_id")(lambda s, d: rounded(costs.fcd_ks_cost(C.fcd_matrix(recs(s, d), 32), BINS), "cost"))
query("ks_distance", f"{KS} select a.trial, {q('max(abs(a.c / a.total - e.c / e.total))')} as distance from c a join c e on e.trial = 0 and e.bin = a.bin where a.trial > 0 group by a.trial")(lambda s, d: rounded(costs.ks_distance(C.fcd_matrix(recs(s, d), 32), BINS), "distance"))
