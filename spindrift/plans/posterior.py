"""Parameter tables, posterior summaries and information measures as queries.

Posterior samples: customers of a nation (cond), parameters p0 (balance in thousands) and p1 (from the key). Prior
samples: the same of suppliers. theta and x: quantity, discount, price and tax of line items.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spindrift.operators import infotheory as I
from spindrift.operators import registry as G
from spindrift.operators import posterior as B
from spindrift.operators import stats as A
from spindrift.plans.base import SIG, q, query, recs, rounded, sig, table

POST = """with recursive cu as (select cast(c_nationkey as bigint) as cond, c_custkey as sample, c_acctbal / 1000 as p0, (c_custkey * 37 % 101) / 10.0 as p1 from customer),
post as (select cond, sample, 'p0' as param, p0 as value from cu union all select cond, sample, 'p1', cast(p1 as double) from cu),
prior as (select s_suppkey as sample, 'p0' as param, s_acctbal / 1000 as value from supplier union all select s_suppkey, 'p1', cast((s_suppkey * 37 % 101) / 10.0 as double) from supplier)"""
ENDS = f"{POST}, ends as (select cond, param, count(*) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as s, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from post group by all)"
PEN = f"{SIG}, ft as (select trial, region, 'mean_' || region as label, avg(v) as value from sig group by all union all select trial, region, 'std_' || region, stddev_pop(v) from sig group by all)"


def _long(df, cond, key, balance):
    wide = df.select(*cond, F.col(key).alias("sample"), (F.col(balance) / 1000).alias("p0"), (F.col(key) * 37 % 101 / 10).cast("double").alias("p1"))
    return wide.unpivot([c for c in wide.columns if c not in ("p0", "p1")], ["p0", "p1"], "param", "value")


def post(s, d):
    return _long(table(s, d, "customer"), [F.col("c_nationkey").cast("long").alias("cond")], "c_custkey", "c_acctbal")


def prior(s, d):
    return _long(table(s, d, "supplier"), [], "s_suppkey", "s_acctbal")


def truth(s):
    return s.createDataFrame([("p0", 4.0), ("p1", 5.0)], "param string, truth double")


query("posterior_mean", f"{POST} select cond, param, {q('avg(value)')} as value from post group by all")(lambda s, d: rounded(post(s, d).groupBy("cond", "param").agg(F.avg("value").alias("value")), "value"))
for ddof, kind in ((0, "pop"), (1, "samp")):
    name = "posterior_shrinkage" if ddof == 0 else "posterior_shrinkage_sample"
    query(name, f"{POST} select cond, p.param, {q(f'1 - var_{kind}(value) / any_value(b)')} as value from post p join (select param, var_{kind}(value) as b from prior group by param) x using (param) group by cond, p.param")(
        lambda s, d, ddof=ddof: rounded(B.shrinkage(prior(s, d), post(s, d), ddof), "value")
    )
    name = "posterior_zscore" if ddof == 0 else "posterior_zscore_sample"
    query(name, f"{POST} select cond, param, {q(f'abs(avg(value) - max(case when param = $$p0$$ then 4.0 else 5.0 end)) / stddev_{kind}(value)')} as value from post group by all")(lambda s, d, ddof=ddof: rounded(B.zscores(post(s, d), truth(s), ddof), "value"))
BOTH = "(select param, value from post union all select param, value from prior)"
query("posterior_limits", f"{POST} select param, {q('min(value)')} as low, {q('max(value)')} as high from {BOTH} group by param")(lambda s, d: rounded(B.limits(post(s, d), prior(s, d)), "low", "high"))
query("plot_limits", f"{POST} select param, {q('min(value) - 0.1 * (max(value) - min(value))')} as low, {q('max(value) + 0.1 * (max(value) - min(value))')} as high from {BOTH} group by param")(lambda s, d: rounded(B.limits(post(s, d), prior(s, d), pad=0.1), "low", "high"))


def kde_sql(points: int, factor: str = "n") -> str:
    return f"""{ENDS}, gr as (select e.*, g, lo + (hi - lo) * g / {points - 1} as x, s * pow({factor}, -0.2) as h from ends e cross join (select unnest(range(0, {points})) as g)),
kd as (select p.cond, p.param, g, any_value(x) as x, sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) as density from gr join post p using (cond, param) group by all)"""


query("kde_1d", f"{kde_sql(50)} select cond, param, cast(g as int) as g, {q('x')} as x, {q('density')} as density from kd")(lambda s, d: rounded(B.kde(post(s, d), 50), "x", "density"))
query("posterior_peaks", f"{kde_sql(100)} select cond, param, {q('arg_max(x, density)')} as value from kd group by all")(lambda s, d: rounded(B.peaks(B.kde(post(s, d), 100)), "value"))
query("posterior_peaks_silverman", f"{kde_sql(100, 'n * 0.75')} select cond, param, {q('arg_max(x, density)')} as value from kd group by all")(lambda s, d: rounded(B.peaks(B.kde(post(s, d), 100, 'silverman')), "value"))
query("hist_1d", f"{ENDS}, b as (select *, greatest(ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))), 1) as bins from ends) select p.cond, p.param, cast(least(floor((value - lo) / (hi - lo) * bins), bins - 1) as int) as bin, count(*) as n from post p join b using (cond, param) group by all")(lambda s, d: B.hist_1d(post(s, d)))
PAIRS = f"{ENDS}, pl as (select p.cond, p.sample, p.param, value, cast(least(floor((value - lo) / (hi - lo) * 50), 49) as int) as bin from post p join ends using (cond, param))"
query("hist_2d", f"{PAIRS} select a.cond, a.param as p, b.param as q, a.bin as bx, b.bin as by, count(*) as n from pl a join pl b on a.cond = b.cond and a.sample = b.sample and a.param < b.param group by all")(lambda s, d: B.hist_2d(post(s, d)))
query("pair_summary", f"{PAIRS} select cond, param as p, param as q, bin as bx, bin as by, count(*) as n from pl group by all union all select a.cond, a.param, b.param, a.bin, b.bin, count(*) from pl a join pl b on a.cond = b.cond and a.sample = b.sample and a.param < b.param group by all")(
    lambda s, d: B.hist_1d(post(s, d), 50).select("cond", F.col("param").alias("p"), F.col("param").alias("q"), F.col("bin").alias("bx"), F.col("bin").alias("by"), "n").unionByName(B.hist_2d(post(s, d)))
)
KDE2 = f"""{POST}, w as (select cond, sample, p0 as x, cast(p1 as double) as y from cu), b as (select cond, count(*) as n, min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from w group by cond),
g as (select b.*, gx, gy, lox + (hix - lox) * gx / 11 as px, loy + (hiy - loy) * gy / 11 as py, (vx * vy - c * c) * pow(n, -1.0 / 3) as det from b cross join (select unnest(range(0, 12)) as gx) cross join (select unnest(range(0, 12)) as gy)),
r as (select g.cond, cast(gx as int) as gx, cast(gy as int) as gy, sum(exp(-0.5 * (vy * pow(px - x, 2) - 2 * c * (px - x) * (py - y) + vx * pow(py - y, 2)) / det)) as e from g join w using (cond) group by all),
kd as (select cond, gx, gy, (e - min(e) over p) / (max(e) over p - min(e) over p) as density from r window p as (partition by cond))"""
query("kde_2d", f"{KDE2} select cond, 'p0' as p, 'p1' as q, gx, gy, {q('density')} as density from kd")(lambda s, d: rounded(B.kde_2d(post(s, d), 12), "density"))
query("credible_levels", f"{KDE2} select cond, 'p0' as p, 'p1' as q, gx, gy, {q('sum(density) over (partition by cond order by density desc, gx, gy rows unbounded preceding) / sum(density) over (partition by cond)', 5)} as mass from kd")(
    lambda s, d: rounded(B.credible_levels(B.kde_2d(post(s, d), 12), ["cond", "p", "q"], ["gx", "gy"]).drop("density"), "mass", digits=5)
)

# Priors
BOUNDS = [("l_quantity", 5.0, 45.0), ("l_discount", 0.01, 0.09)]
LOG_V = B.log_volume(BOUNDS)


def theta(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


KEEP = "select l_orderkey, l_linenumber, l_quantity, l_discount"
IN_BOX = "l_quantity between 5 and 45 and l_discount between 0.01 and 0.09"
query("prior_logprob", f"{KEEP}, {q(f'case when {IN_BOX} then {-LOG_V!r} else -1e308 end')} as log_prob from lineitem")(
    lambda s, d: rounded(B.prior_logprob(theta(s, d), BOUNDS).withColumn("log_prob", F.greatest("log_prob", F.lit(-1e308))), "log_prob")
)
query("prior_prob", f"{KEEP}, {q(f'case when {IN_BOX} then {math.exp(-LOG_V)!r} else 0 end')} as prob from lineitem")(lambda s, d: rounded(B.prior_logprob(theta(s, d), BOUNDS).withColumn("prob", F.exp("log_prob")).drop("log_prob"), "prob"))
query("prior_cdf", f"{KEEP}, {q('least(greatest((l_quantity - 5) / 40, 0), 1) * least(greatest((l_discount - 0.01) / 0.08, 0), 1)')} as cdf from lineitem")(lambda s, d: rounded(B.prior_cdf(theta(s, d), BOUNDS), "cdf"))
query("prior_moments", f"{POST}, b as (select param, min(value) as low, max(value) as high from prior group by param) select param, {q('(low + high) / 2')} as mean, {q('pow(high - low, 2) / 12')} as variance, {q('(high - low) / sqrt(12)')} as std, {q('high - low')} as width from b")(
    lambda s, d: rounded(B.prior_moments(B.limits(prior(s, d))), "mean", "variance", "std", "width")
)
query("prior_sample")(lambda s, d: B.prior_sample(s, [(r.param, r.low, r.high) for r in B.limits(prior(s, d)).orderBy("param").collect()], prior(s, d).select("sample").distinct().count(), seed=3))
# Draws at a share u of each box's width, by the discount of a line item: which of them the narrower box takes.
U = "cast(l_discount * 10 as double)"
DRAWS = f"select l_orderkey, l_linenumber, {', '.join(f'({low!r} + ({high - low!r}) * {U}) as {n}' for n, low, high in B.PRIOR_BOX)} from lineitem"


def box_draws(s, d):
    return B.draws_at(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).cast("double").alias("u")), B.PRIOR_BOX)


query("prior_ranges", f"with x as ({DRAWS}) " + " union all ".join(f"select '{n}' as param, {low!r}::double as low, {high!r}::double as high, {q(f'min({n})')} as least, {q(f'max({n})')} as most from x" for n, low, high in B.PRIOR_BOX))(
    lambda s, d: rounded(
        B.bounds_table(s, B.PRIOR_BOX).join(box_draws(s, d).unpivot(["l_orderkey"], [n for n, _, _ in B.PRIOR_BOX], "param", "value").groupBy("param").agg(F.min("value").alias("least"), F.max("value").alias("most")), "param"), "least", "most"
    )
)
CHECKS = " and ".join(f"{n} between {low!r} and {high!r}" for n, low, high in B.CHECK_BOX)
query("param_range_check", f"select l_orderkey, l_linenumber, {CHECKS} as ok from ({DRAWS})")(lambda s, d: box_draws(s, d).select("l_orderkey", "l_linenumber", B.inside(B.CHECK_BOX).alias("ok")))
query("finite_rows", f"{POST} select cond, sample, p0 as value from cu where p0 > 0")(lambda s, d: B.finite_rows(post(s, d).filter("param = 'p0'").select("cond", "sample", F.when(F.col("value") > 0, F.col("value")).otherwise(float("nan")).alias("value")), ["value"]))
query("drop_nonfinite_samples", f"{POST} select cond, sample, p0 as value from cu where p0 > 0")(
    lambda s, d: B.finite_rows(post(s, d).filter("param = 'p0'").select("cond", "sample", F.when(F.col("value") > 0, F.col("value")).otherwise(float("-inf")).alias("value")), ["value"])
)
REJECT = f"{POST}, ok as (select cond, sample, p0 as value, row_number() over (partition by cond order by sample) as rank from cu where -abs(p0 - 2) > -4)"


def _kept(s, d):
    scored = post(s, d).filter("param = 'p0'").select("cond", "sample", "value", (-F.abs(F.col("value") - 2)).alias("log_p"))
    return B.rejection(scored, -4.0, 30)


query("rejection_filter", f"{REJECT}, k as (select * from ok where rank <= 30), g as (select cond, unnest(range(1, 31)) as rank from (select distinct cond from cu)), l as (select cond, arg_max(value, rank) as last from k group by cond) select g.cond, cast(g.rank as int) as rank, coalesce(k.value, l.last, -1.0) as value from g left join k using (cond, rank) left join l using (cond)")(
    lambda s, d: B.padded(_kept(s, d), post(s, d).select("cond", F.lit(-1.0).alias("fallback")).distinct(), 30)
)
query("train_val_split")(lambda s, d: B.split(theta(s, d).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber")), "key").groupBy("held_out").agg(F.count("*").alias("n")))
# The axes of the grid: rates by region of the world, weights by nation, delays by size of part.
AXES = {"g": ("region", "r_regionkey", 0.1), "w": ("nation", "n_nationkey", 1.0), "tau": ("part", "p_size", 0.5)}


def axes(s, d):
    return {name: [r[0] * step for r in table(s, d, t).select(F.col(c).cast("double")).distinct().orderBy(c).collect()] for name, (t, c, step) in AXES.items()}


AXIS = ", ".join(f"{n} as (select {c} * {step}::double as {n}, row_number() over (order by {c}) - 1 as {n}_at, count(*) over () as {n}_n from (select distinct {c} from {t}))" for n, (t, c, step) in AXES.items())
query("sweep_grid", f"with {AXIS} select cast((g_at * w_n + w_at) * tau_n + tau_at as bigint) as set_id, {q('g')} as g, {q('w')} as w, {q('tau')} as tau, cast(dup as int) as dup from g cross join w cross join tau cross join (select unnest(range(0, 2)) as dup)")(
    lambda s, d: rounded(B.sweep_grid(s, axes(s, d), 2), "g", "w", "tau")
)
NODES = "nodes as (select p_partkey as region, p_size / 10.0 as myelin, p_retailprice / 1000 as gradient from part)"


def nodes(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("region"), (F.col("p_size") / 10).alias("myelin"), (F.col("p_retailprice") / 1000).alias("gradient"))


def draws(s, d):
    key = F.col("n_nationkey")
    return table(s, d, "nation").select(key.cast("long").alias("trial"), (key * 0.1).alias("a"), (key * 0.2 - 1).alias("b"), F.lit(0.5).alias("c"))


query("node_param_expand", f"with {NODES} select cast(n_nationkey as bigint) as trial, region, {q('n_nationkey * 0.1 * myelin + (n_nationkey * 0.2 - 1) * gradient + 0.5')} as value from nation cross join nodes")(lambda s, d: rounded(B.node_param_expand(draws(s, d), nodes(s, d)), "value"))
FIT = f"with {NODES}, o as (select myelin as x, gradient as y, 2 * myelin - gradient + sin(region) as v from nodes), m as (select covar_pop(x, x) as xx, covar_pop(y, y) as yy, covar_pop(x, y) as xy, covar_pop(x, v) as xv, covar_pop(y, v) as yv, avg(x) as mx, avg(y) as my, avg(v) as mv from o), r as (select *, (yy * xv - xy * yv) / (xx * yy - xy * xy) as a, (xx * yv - xy * xv) / (xx * yy - xy * xy) as b from m)"
query("node_param_fit", f"{FIT} select {q('a')} as a, {q('b')} as b, {q('mv - a * mx - b * my')} as c from r")(lambda s, d: rounded(B.node_param_fit(nodes(s, d).withColumn("value", 2 * F.col("myelin") - F.col("gradient") + F.sin("region"))), "a", "b", "c"))
query("node_poly_fit")(lambda s, d: rounded(B.node_poly_fit(nodes(s, d).withColumn("value", 2 * F.col("myelin") - F.col("gradient") + F.sin("region")), 3), "coef", digits=4))
query("param_broadcast", "select n_nationkey as node, r_regionkey as set_id, cast(case when n_nationkey = 3 and r_regionkey = 2 then 9 when n_nationkey = 3 then 7 when r_regionkey = 1 then 5 else 1 end as double) as value from nation cross join region")(
    lambda s, d: B.param_broadcast(
        s.createDataFrame([(3, 2, 9.0), (3, None, 7.0), (None, 1, 5.0), (None, None, 1.0)], "node int, set_id int, value double"),
        table(s, d, "nation").select(F.col("n_nationkey").alias("node")),
        table(s, d, "region").select(F.col("r_regionkey").alias("set_id")),
    )
)

# Conditional density
JOINT = ["l_discount"], ["l_quantity", "l_tax"]


def joint(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100 + F.col("l_quantity") / 10).alias("l_discount"), "l_quantity", (F.col("l_tax") * 100).alias("l_tax"))


def conditions(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("cond"), (F.col("n_nationkey") * 2.0).alias("l_quantity"), F.lit(4.0).alias("l_tax"))


query("cond_density_fit")(lambda s, d: s.createDataFrame([(i, float(w), [float(x) for x in m]) for i, (w, m, _) in enumerate(B.mixture_fit(joint(s, d), *JOINT, k=2, rounds=15))], "component int, weight double, mean array<double>"))
query("cond_sample")(lambda s, d: B.cond_sample(conditions(s, d), B.mixture_fit(joint(s, d), *JOINT, k=2, rounds=15), *JOINT, n=200))
MIX = [(0.4, [5.0, 20.0, 3.0], [[4.0, 1.0, 0.2], [1.0, 90.0, 0.5], [0.2, 0.5, 5.0]]), (0.6, [6.0, 30.0, 4.0], [[3.0, -1.0, 0.1], [-1.0, 80.0, 0.4], [0.1, 0.4, 6.0]])]


def _fixed():
    import numpy as np

    return [(w, np.array(m), np.array(c)) for w, m, c in MIX]


def _log_prob_sql() -> str:
    import numpy as np

    logits, joints = [], []
    for p in B.conditional(_fixed(), 1):
        d = [f"(l_quantity - {p['mx'][0]!r})", f"(l_tax - {p['mx'][1]!r})"]
        d = [x.replace("np.float64(", "").replace("))", ")") for x in d]
        form = " + ".join(f"({float(p['prec'][i, j])!r}) * {d[i]} * {d[j]}" for i in range(2) for j in range(2))
        logit = f"({math.log(p['w'])!r} - 0.5 * ({p['logdet']!r} + {form}))"
        r = f"(l_discount - {float(p['mt'][0])!r} - ({float(p['slope'][0, 0])!r}) * {d[0]} - ({float(p['slope'][0, 1])!r}) * {d[1]})"
        logits.append(logit)
        joints.append(f"({logit} - 0.5 * ({float(np.log(p['cov'][0, 0]))!r} + {r} * {r} / {float(p['cov'][0, 0])!r} + {math.log(2 * math.pi)!r}))")
    lse = lambda t: f"(greatest({', '.join(t)}) + ln({' + '.join(f'exp({x} - greatest({", ".join(t)}))' for x in t)}))"
    return f"with j as (select l_orderkey, l_linenumber, l_discount * 100 + l_quantity / 10 as l_discount, l_quantity, l_tax * 100 as l_tax from lineitem) select l_orderkey, l_linenumber, {q(f'{lse(joints)} - {lse(logits)}')} as log_prob from j"


query("cond_log_prob", _log_prob_sql())(lambda s, d: rounded(B.cond_log_prob(joint(s, d), _fixed(), *JOINT).select("l_orderkey", "l_linenumber", "log_prob"), "log_prob"))

# Feature tables
NAMES = ["calc_mean", "calc_std"]


def features(s, d):
    return A.long(A.region_stats(sig(s, d), NAMES), NAMES).select("trial", "feature", "label", "value")


FT = f"{SIG}, ft as (select trial, 'calc_mean' as feature, 'calc_mean_' || region as label, avg(v) as value from sig group by trial, region union all select trial, 'calc_std', 'calc_std_' || region, stddev_pop(v) from sig group by trial, region), st as (select label, avg(value) as mean, stddev_pop(value) as scale, stddev_samp(value) as std, count(*) as n from ft group by label)"
query("feature_standardize", f"{FT} select trial, label, {q('coalesce((value - mean) / nullif(scale, 0), 0)', 4)} as value from ft join st using (label) where n > 1")(
    lambda s, d: rounded(B.standardize(features(s, d), B.feature_stats(features(s, d)).filter("std is not null")), "value", digits=4)
)
query("scaler_apply_join", f"{FT} select trial, label, {q('coalesce((value - mean) / nullif(scale, 0), 0)', 4)} as value from ft join st using (label) where n > 1 and trial = 0")(
    lambda s, d: rounded(B.standardize(features(s, d).filter("trial = 0"), B.feature_stats(features(s, d)).filter("std is not null")), "value", digits=4)
)
query("low_variance_drop", f"{FT} select trial, feature, label, {q('value')} as value from ft join st using (label) where std > 0.012")(lambda s, d: rounded(B.low_variance_drop(features(s, d), B.feature_stats(features(s, d)), 0.012), "value"))
query("slice_features", f"{FT} select trial, feature, label, {q('value')} as value, case when feature = 'calc_std' then 0 else 1 end as position from ft")(lambda s, d: rounded(B.slice_features(features(s, d), ["calc_std", "calc_mean"]), "value"))
query("feature_cols_pick", f"{FT} select trial, {q('max(value) filter (label = $$calc_mean_0$$)')} as calc_mean_0, {q('max(value) filter (label = $$calc_std_3$$)')} as calc_std_3 from ft group by trial")(
    lambda s, d: rounded(features(s, d).groupBy("trial").pivot("label", ["calc_mean_0", "calc_std_3"]).agg(F.first("value")), "calc_mean_0", "calc_std_3")
)
query("features_pivot", f"{FT} select trial, label, {q('value')} as value from (select distinct trial from ft) cross join (select distinct label from ft) left join ft using (trial, label)")(lambda s, d: G.cells(rounded(features(s, d), "value")))
query("theta_features_join", f"{FT} select trial, cast(trial * 0.5 as double) as p0, label, {q('value')} as value from ft")(
    lambda s, d: rounded(B.theta_features_join(recs(s, d).select("trial").distinct().withColumn("p0", F.col("trial") * 0.5), features(s, d).drop("feature")), "value")
)
query("pca_embed")(lambda s, d: rounded(B.pca_embed(A.region_stats(sig(s, d), ["calc_mean", "calc_std", "calc_max", "calc_kurtosis"]), ["calc_mean", "calc_std", "calc_max", "calc_kurtosis"], 2).select("trial", F.abs(F.get("pc", F.lit(0))).alias("pc0"), F.abs(F.get("pc", F.lit(1))).alias("pc1")), "pc0", "pc1"))

# Information measures
query("entropy_bin", f"{SIG}, c as (select trial, region, round(v, 1) as v, count(*) as c from sig group by 1, 2, round(v, 1)) select trial, region, {q('-sum(p * log2(p)) / log2(any_value(n))')} as value from (select trial, region, c / sum(c) over w as p, sum(c) over w as n from c window w as (partition by trial, region)) group by all")(
    lambda s, d: rounded(I.entropy_bin(sig(s, d), 1), "value")
)
GAUSS = f"{SIG}, st as (select trial, region, avg(v) as m, stddev_pop(v) as s, stddev_samp(v) * pow(count(*) * 0.75, -0.2) as h, min(v) as lo, max(v) as hi from sig group by all)"
SHARE = "select trial, region, {out} as value from (select trial, region, d / sum(d) over (partition by trial, region) as p from g) where p > 0 group by all"
query("entropy_gauss", f"{GAUSS}, g as (select trial, region, exp(-0.5 * pow((lo + (hi - lo) * g / 99 - m) / s, 2)) as d from st cross join (select unnest(range(0, 100)) as g)) " + SHARE.format(out=q("-sum(p * log2(p)) / log2(100)")))(lambda s, d: rounded(I.entropy_gauss(sig(s, d)), "value"))
query("entropy_kde", f"{GAUSS}, g as (select trial, region, g, sum(exp(-0.5 * pow((lo + (hi - lo) * g / 49 - v) / h, 2))) as d from st join sig using (trial, region) cross join (select unnest(range(0, 50)) as g) group by all) " + SHARE.format(out=q("-sum(p * log2(p)) / log2(50)")))(lambda s, d: rounded(I.entropy_kde(sig(s, d)), "value"))
query("calc_entropy", f"{SIG}, n as (select trial, region, least(v - lag(v) over w, lead(v) over w - v) as gap from sig window w as (partition by trial, region order by v, t)) select trial, region, {q('(avg(ln(greatest(gap, 2.2250738585072014e-308))) + ln(2) + list_sum(list_transform(range(1, count(*)), lambda i: 1.0::double / i))) / ln(2)', 5)} as value from n group by trial, region")(
    lambda s, d: rounded(I.entropy_nearest(sig(s, d)), "value", digits=5)
)
query("pairs_build", "select cast(a.n_nationkey as int) as source, cast(b.n_nationkey as int) as target from nation a cross join nation b where a.n_nationkey < 4 and b.n_nationkey >= 20")(lambda s, d: I.pairs_build(s, list(range(4)), [r[0] for r in table(s, d, "nation").filter("n_nationkey >= 20").select("n_nationkey").collect()]))
query("lag_pair_join", f"{SIG} select a.trial, a.region, a.t, a.v, b.v as past from sig a join sig b on a.trial = b.trial and a.region = b.region and b.t = a.t - 3")(lambda s, d: I.lag_pairs(sig(s, d), 3))
# Each region with the next one.
KSG = f"""{SIG}, xy as (select a.trial, a.region as source, b.region as target, a.t, a.v as x, b.v as y from sig a join sig b on b.region = a.region + 1 and b.trial = a.trial and b.t = a.t),
ds as (select a.trial, a.source, a.target, a.t, b.t as o, abs(a.x - b.x) as dx, abs(a.y - b.y) as dy from xy a join xy b on a.trial = b.trial and a.source = b.source and a.target = b.target and a.t <> b.t),
nn as (select * from (select *, row_number() over (partition by trial, source, target, t order by greatest(dx, dy), o) as rk from ds) where rk <= 4), ep as (select trial, source, target, t, max(dx) as ex, max(dy) as ey from nn group by all),
ct as (select trial, source, target, t, count(*) filter (dx <= ex) as nx, count(*) filter (dy <= ey) as ny from ds join ep using (trial, source, target, t) group by all),
ps as (select m, coalesce(list_sum(list_transform(range(1, m), lambda i: 1.0::double / i)), 0) as psi from (select unnest(range(1, 70)) as m)),
av as (select trial, source, target, avg(a.psi + b.psi) as s, count(*) as n from ct join ps a on a.m = nx join ps b on b.m = ny group by all)
select trial, source, target, {q('greatest((select psi from ps where m = 4) - 0.25 - s + (select psi from ps where m = n), 0) * 1.4427', 5)} as value from av"""
query("calc_mi", KSG)(lambda s, d: rounded(I.mutual_information(recs(s, d), I.neighbours(recs(s, d))), "value", digits=5))
KTE = f"""{SIG}, xy as (select a.trial, a.region as source, b.region as target, a.t, a.v as s, b.v as p, c.v as x from sig a join sig b on b.region = a.region + 1 and b.trial = a.trial and b.t = a.t join sig c on c.trial = b.trial and c.region = b.region and c.t = b.t + 1),
ds as (select a.trial, a.source, a.target, a.t, abs(a.x - b.x) as dx, abs(a.p - b.p) as dp, abs(a.s - b.s) as dc from xy a join xy b on a.trial = b.trial and a.source = b.source and a.target = b.target and a.t <> b.t),
rk as (select *, row_number() over (partition by trial, source, target, t order by greatest(dx, dp, dc)) as rk from ds), ep as (select trial, source, target, t, greatest(dx, dp, dc) as e from rk where rk = 4),
ct as (select trial, source, target, t, count(*) filter (dp < e) + 1 as nz, count(*) filter (greatest(dx, dp) < e) + 1 as nxz, count(*) filter (greatest(dc, dp) < e) + 1 as nyz from ds join ep using (trial, source, target, t) group by all),
ps as (select m, coalesce(list_sum(list_transform(range(1, m), lambda i: 1.0::double / i)), 0) as psi from (select unnest(range(1, 70)) as m))
select trial, source, target, {q('(select psi from ps where m = 4) + avg(a.psi - b.psi - c.psi)', 5)} as value from ct join ps a on a.m = nz join ps b on b.m = nxz join ps c on c.m = nyz group by all"""
query("calc_te", KTE)(lambda s, d: rounded(I.transfer_entropy(recs(s, d), I.neighbours(recs(s, d))), "value", digits=5))
query("surrogate_null")(lambda s, d: rounded(I.surrogate_null(recs(s, d), I.neighbours(recs(s, d))), "value", digits=5))
query("nat2bit", f"{SIG} select trial, region, {q('avg(v) * 1.4427')} as value from sig group by all")(lambda s, d: rounded(I.nat2bit(A.region_stats(sig(s, d), ["calc_mean"]).withColumnRenamed("calc_mean", "value")), "value"))
