"""Features run through the configuration with parameters of their own, and measures at two levels at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import infotheory as I
from spindrift.operators import registry as G
from spindrift.operators import spectral as P
from spindrift.operators import states
from spindrift.plans.base import SIG, q, query, recs, rounded, sig
from spindrift.plans.connectivity import FC, HALF
from spindrift.plans.posterior import GAUSS, KSG, SHARE
from spindrift.plans.spectral import FS, SPEC, spec


def configured(feature: str, digits: int = 6, **parameters):
    """A query that extracts one feature with these parameters."""
    config = G.update(G.by_names(G.default_config(), feature), feature, parameters)
    for features in config.values():
        for entry in features.values():
            entry["use"] = True
    return lambda s, d: rounded(G.extract(sig(s, d), config, fs=FS), "value", digits=digits)


def labelled(feature: str, values: str, label: str = "region") -> str:
    """The rows of extract() from rows (trial, region, value)."""
    return f"select trial, '{feature}' as feature, '{feature}_' || {label} as label, value from ({values})"


query("cfg_indices", f"{SIG} {labelled('calc_moments', f'select trial, region, k, {q('avg(pow(v - m, k))')} as value from (select *, avg(v) over (partition by trial, region) as m from sig where region in (0, 3, 4)) cross join (select unnest([2, 3]) as k) group by trial, region, k', "k || '_' || region")}")(
    configured("calc_moments", indices=[0, 3, 4], orders=[2, 3])
)
ONSET = "select trial, region, cast(case when max(d) < 0.2 then 0 else arg_min(t, struct_pack(a := -coalesce(d, -1e300), b := t)) end as double) as value from (select *, lead(v) over (partition by trial, region order by t) - v as d from sig) group by trial, region"
query("cfg_threshold", f"{SIG} {labelled('seizure_onset', ONSET)}")(configured("seizure_onset", threshold=0.2))
query("cfg_dx", f"{SIG} {labelled('auc', f'select trial, region, {q('sum(0.25 * (v + n))')} as value from (select *, lead(v) over (partition by trial, region order by t) as n from sig) where n is not null group by trial, region')}")(configured("auc", dx=0.5))
query("cfg_prob", f"{GAUSS}, g as (select trial, region, exp(-0.5 * pow((lo + (hi - lo) * g / 99 - m) / s, 2)) as d from st cross join (select unnest(range(0, 100)) as g)) {labelled('entropy_bin', SHARE.format(out=q('-sum(p * log2(p)) / log2(100)')))}")(configured("entropy_bin", prob="gauss"))
query("cfg_catch24", f"{SIG} select trial, 'catch22' as feature, 'DN_Mean_' || region as label, {q('avg(v)')} as value from sig group by trial, region union all select trial, 'catch22', 'DN_Spread_Std_' || region, {q('stddev_samp(v)')} from sig group by trial, region")(
    configured("catch22", features=["DN_Mean"], catch24=True)
)
query("cfg_fc_function", f"{SIG}, c as (select a.trial, covar_samp(a.v, b.v) as w from sig a join sig b on a.trial = b.trial and a.t = b.t and a.region < b.region group by a.trial, a.region, b.region) select trial, 'fc_stat' as feature, 'fc_stat_' || k as label, {q('case k when $$mean$$ then m when $$max$$ then hi else lo end')} as value from (select trial, avg(w) as m, max(w) as hi, min(w) as lo from c group by trial) cross join (select unnest(['mean', 'max', 'min']) as k)")(
    configured("fc_stat", fc_function="cov", features=["mean", "max", "min"], eigenvalues=False, pca_num_components=0, quantiles=None)
)
query("cfg_masks", f"{FC}, h as (select *, {HALF} as mask from fc join n using (trial)) select trial, 'fc_sum' as feature, 'fc_sum_' || mask || '_sum' as label, {q('2 * sum(abs(w))', 4)} as value from h group by trial, mask")(configured("fc_sum", digits=4, masks=["intrah", "interh"]))
# Each mask's matrix with zeros outside it and on the diagonal.
query("cfg_masks_quantiles", f"{FC}, h as (select trial, i, j, case when {HALF} = 'interh' then w else 0.0 end as w from fc join n using (trial)), f as (select trial, w from h union all select trial, w from h union all select trial, 0.0 from (select distinct trial, region from sig)) select trial, 'fc_stat' as feature, 'fc_stat_interh_q' || k as label, {q('case k when 5 then a else b end')} as value from (select trial, quantile_cont(w, 0.05) as a, quantile_cont(w, 0.95) as b from f group by trial) cross join (select unnest([5, 95]) as k)")(
    configured("fc_stat", masks=["interh"], features=[], eigenvalues=False, pca_num_components=0, quantiles=[0.05, 0.95])
)
query("cfg_average", KSG.replace("select trial, source, target, (round(", "select trial, 'calc_mi' as feature, 'calc_mi' as label, (round(avg(").replace(", 5) + 0.0) as value from av", "), 5) + 0.0) as value from av group by trial"))(
    configured("calc_mi", digits=5, time_diff=0, average=True)
)

# Grouping sets: every series, and with a null region all of a trial
query("entropy_levels", f"{SIG}, c as (select trial, region, round(v, 1) as x, count(*) as c, grouping(region) as g from sig group by grouping sets ((trial, region, round(v, 1)), (trial, round(v, 1)))) select trial, region, {q('1 - sum(c * log2(c)) / sum(c) / log2(sum(c))')} as value from c group by trial, region, g")(
    lambda s, d: rounded(I.entropy_levels(sig(s, d), 1), "value")
)
query("spectrum_levels", f"{SPEC} select trial, region, k, {q('any_value(freq)')} as freq, {q('avg(mag)', 5)} as mag from sp group by grouping sets ((trial, region, k), (trial, k))")(lambda s, d: rounded(rounded(P.levels(spec(s, d)), "freq"), "mag", digits=5))
query("calc_entropy_pooled", f"{SIG}, n as (select trial, least(v - lag(v) over w, lead(v) over w - v) as gap from sig window w as (partition by trial order by v)) select trial, {q('(avg(ln(greatest(gap, 2.2250738585072014e-308))) + ln(2) + list_sum(list_transform(range(1, count(*)), lambda i: 1.0::double / i))) / ln(2)', 5)} as value from n group by trial")(
    lambda s, d: rounded(I.entropy_pooled(sig(s, d)), "value", digits=5)
)
# No SQL: tests compare its sums with a plain recursion and its paths with planted ones.
query("hmm_fit_regions")(lambda s, d: states.fit_trials(recs(s, d)).withColumn("state", F.col("state").cast("int")))
