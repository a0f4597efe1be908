"""Sources, sinks, configuration, extraction and streams as queries."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from spindrift.operators import posterior as B
from spindrift.operators import registry as G
from spindrift.plans.base import SIG, q, query, recs, rounded, sig, table
from spindrift.plans.connectivity import NATIONS, nation_edges
from spindrift.plans.posterior import FT, features
from spindrift.sources import files
from spindrift.streaming import windows as X


def folder(spark) -> str:
    """A new folder under the shared one (spark.checkpoint.dir); only in local mode, as in tests, may that be unset, and a temporary one is used."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/signal-{uuid.uuid4().hex}"


def _matrix(spark, d, sep: str) -> str:
    """The nation connectome's weights as a text matrix, one file."""
    e = nation_edges(spark, d).unionByName(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("src"), F.col("n_nationkey").cast("int").alias("dst"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("length")))
    ordered = lambda c, of: F.transform(F.array_sort(F.collect_list(F.struct(c, of))), lambda x: x[of])
    rows = e.groupBy("src").agg(F.array_join(ordered("dst", "weight"), sep).alias("line"))
    one = rows.groupBy().agg(F.array_join(ordered("src", "line"), "\n").alias("value"))
    path = folder(spark)
    one.write.text(path)
    return path


CELLS = f"with {NATIONS} select cast(a.n_nationkey as int) as i, cast(b.n_nationkey as int) as j, coalesce(e.weight, 0.0) as value from nation a cross join nation b left join e on e.src = a.n_nationkey and e.dst = b.n_nationkey"
query("src_matrix_text", CELLS)(lambda s, d: files.matrix_text(s, _matrix(s, d, " ")))
query("src_matrix_csv", CELLS)(lambda s, d: files.matrix_csv(s, _matrix(s, d, ",")))


@query("src_region_meta", "select n_name as label, cast(n_nationkey as double) as x, n_regionkey * 2.0::double as y, -1.5::double as z from nation")
def src_region_meta(spark, d):
    path = folder(spark)
    table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("double"), F.col("n_regionkey") * 2.0, F.lit(-1.5)).write.csv(path, sep=" ")
    return files.region_meta(spark, path)


def _bundle(spark, d):
    path = folder(spark)
    f = features(spark, d)
    files.save_bundle(path, f, recs(spark, d).select("trial").distinct().withColumn("p0", F.col("trial") * 0.5), B.feature_stats(f))
    return files.load_bundle(spark, path)


query("snk_features", f"{FT} select trial, feature, label, {q('value')} as value from ft")(lambda s, d: rounded(_bundle(s, d)["features"], "value"))
query("src_cached", f"{FT} select label, {q('mean')} as mean, {q('scale')} as scale from st")(lambda s, d: rounded(_bundle(s, d)["feature_stats"].select("label", "mean", "scale"), "mean", "scale"))

# Configuration: what is left of the features that the signal table gives
HELD = {"calc_mean": "avg(v)", "calc_std": "stddev_pop(v)", "calc_max": "max(v)", "rms": "sqrt(avg(v * v))", "abs_energy": "sum(v * v)"}


def _union(names) -> str:
    return f"{SIG} " + " union all ".join(f"select trial, '{n}' as feature, '{n}_' || region as label, {q(HELD[n])} as value from sig group by trial, region" for n in names)


BASE = G.by_names(G.default_config(), list(HELD))


def _extracted(config):
    return lambda s, d: rounded(G.extract(sig(s, d), config), "value")


query("extract_features", _union(HELD))(_extracted(BASE))
# Every built-in feature: no SQL of reasonable size; tests compare it with the operators one by one.
query("extract_features_all")(_extracted(G.update(G.default_config(), "auc_lim", {"xlim": [[0, 10], [5, 40]]})))
query("cfg_by_domain", _union(["abs_energy"]))(_extracted(G.by_domain(BASE, "temporal")))
query("cfg_by_names", _union(["calc_mean", "rms"]))(_extracted(G.by_names(BASE, ["CALC_MEAN", "rms"])))
query("cfg_by_tag", _union(["abs_energy"]))(_extracted(G.by_tag(BASE, "eeg")))
query("cfg_update", f"{SIG} select trial, 'calc_moments' as feature, 'calc_moments_' || k || '_' || region as label, {q('avg(pow(v - m, k))')} as value from (select *, avg(v) over (partition by trial, region) as m from sig) cross join (select unnest([2, 3]) as k) group by trial, region, k")(
    _extracted(G.update(G.by_names(G.default_config(), "calc_moments"), "calc_moments", {"orders": [2, 3]}))
)
REPORTED = ["calc_mean", "abs_energy"]
query("cfg_report", f"{SIG} select 'statistical' as domain, 'calc_mean' as feature, true as use, trial, count(distinct region) as labels from sig group by trial union all select 'temporal', 'abs_energy', true, trial, count(distinct region) from sig group by trial")(
    lambda s, d: G.as_table(s, G.by_names(BASE, REPORTED)).select("domain", "feature", "use").join(G.extract(sig(s, d), G.by_names(BASE, REPORTED)).groupBy("feature", "trial").agg(F.countDistinct("label").alias("labels")), "feature")
)


def _spread(recordings, factor: float = 1.0):
    """Range of each series, times a factor."""
    span = (F.array_max("v") - F.array_min("v")) * factor
    return recordings.select("trial", F.concat(F.lit("span_"), "region").alias("label"), span.alias("value"))


query("cfg_add", f"{SIG} select trial, 'span' as feature, 'span_' || region as label, {q('2 * (max(v) - min(v))')} as value from sig group by trial, region")(_extracted(G.add({}, "user", "span", _spread, {"factor": 2.0})))
HERE = os.path.dirname(__file__)
query("cfg_add_json", f"{SIG} select trial, 'peak_to_peak' as feature, 'peak_to_peak_' || region as label, {q('0.5 * (max(v) - min(v))')} as value from sig group by trial, region union all select trial, 'energy_share', 'energy_share_' || region, {q('sum(v * v) / any_value(e)')} from (select *, sum(v * v) over (partition by trial) as e from sig) group by trial, region")(
    _extracted(G.add_json({}, f"{HERE}/example_features.json", f"{HERE}/example_features.py"))
)
query("extract_features_df", f"{SIG}, x as (select trial, 'calc_mean_' || region as label, {q('avg(v)')} as value from sig group by trial, region) select trial, label, value from (select distinct trial from x) cross join (select distinct label from x) left join x using (trial, label)")(
    lambda s, d: G.cells(rounded(G.extract(sig(s, d), G.by_names(BASE, "calc_mean")), "value"))
)
query("extract_features_list", f"{SIG}, f as (select trial, 'calc_mean_' || region as label, avg(v) as value from sig group by trial, region) select trial, string_agg(label, ',' order by label) as labels, count(*) as n, {q('sum(value)', 5)} as total from f group by trial")(
    lambda s, d: rounded(G.as_lists(G.extract(sig(s, d), G.by_names(BASE, "calc_mean"))).select("trial", F.array_join("labels", ",").alias("labels"), F.size("labels").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), "total", digits=5)
)

# Streams: events by type
SERIES = "ts, event_type as series, value from events"
FINAL = "(select max(ts) from events) - interval 1 hour"


def events(spark, d, stream: bool = True):
    schema = table(spark, d, "events").schema  # a pattern below, as a stream takes no single file by its plain name
    raw = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet") if stream else table(spark, d, "events")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("series"), "value")


def _run(spark, stream, mode="append"):
    return X.to_table(stream, folder(spark), "stream", mode)


def _stamped(df, *columns):
    return rounded(df, "mean", "std", "min", "max").withColumns({c: F.unix_timestamp(c) for c in columns})


FIVE = f"count(*) as n, {q('avg(value)')} as mean, {q('stddev_pop(value)')} as std, {q('min(value)')} as min, {q('max(value)')} as max"
query("stream_region_stats", f"select cast(floor(epoch(date_trunc('day', ts))) as bigint) as start, series, {FIVE} from (select {SERIES}) group by date_trunc('day', ts), series having date_trunc('day', ts) + interval 1 day <= {FINAL}")(
    lambda s, d: _stamped(_run(s, X.window_stats(events(s, d), "1 day")), "start")
)
query("stream_sliding_stats", f"select cast(floor(epoch(start)) as bigint) as start, series, {FIVE} from (select {SERIES}) join (select unnest([0, 1]) as k) on true cross join lateral (select date_trunc('day', ts) - k * interval 1 day as start) group by start, series having start + interval 2 day <= {FINAL}")(
    lambda s, d: _stamped(_run(s, X.window_stats(events(s, d), "2 days", "1 day")), "start")
)
GAP = "with s as (select *, case when ts - lag(ts) over (partition by series order by ts) < interval 30 minute then 0 else 1 end as c from (select ts, event_type as series, value from events)), r as (select *, sum(c) over (partition by series order by ts rows unbounded preceding) as run from s)"
query("stream_session_stats", f"{GAP} select cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts) + interval 30 minute)) as bigint) as finish, series, {FIVE} from r group by series, run having max(ts) + interval 30 minute <= {FINAL}")(
    lambda s, d: _stamped(_run(s, X.session_stats(events(s, d), "30 minutes")), "start", "finish")
)
TICKS = f"with tk as (select date_trunc('day', ts) as tick, series, avg(value) as value from (select {SERIES}) group by date_trunc('day', ts), series having date_trunc('day', ts) + interval 1 day <= {FINAL})"
query("tick_correlation", f"{TICKS} select cast(floor(epoch(time_bucket(interval 7 day, a.tick, timestamp '1970-01-01'))) as bigint) as start, a.series as a, b.series as b, count(*) as n, {q('covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0)')} as r from tk a join tk b on a.tick = b.tick and a.series < b.series group by all")(
    lambda s, d: rounded(X.pair_correlation(_run(s, X.tick_means(events(s, d), "1 day")), "7 days"), "r").withColumn("start", F.unix_timestamp("start"))
)
query("stream_fc", f"{TICKS}, fc as (select cast(floor(epoch(time_bucket(interval 7 day, a.tick, timestamp '1970-01-01'))) as bigint) as start, a.series as a, b.series as b, count(*) as n, {q('covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0)')} as r from tk a join tk b on a.tick = b.tick and a.series < b.series group by all) select * from fc where start + 7 * 86400 <= epoch({FINAL})")(
    lambda s, d: rounded(_run(s, X.stream_correlation(events(s, d), "1 day", "7 days")), "r").withColumn("start", F.unix_timestamp("start"))
)


@query("stream_onset", f"{TICKS}, st as (select tick, series, lead(value) over (partition by series order by tick) - value as jump from tk) select series, cast(floor(epoch(arg_max(tick, jump))) as bigint) as at, {q('max(jump)')} as jump from st group by series having max(jump) >= 0.02")
def stream_onset(spark, d):
    """Finished ticks of the first stream are the input of the second, which keeps a state per series."""
    path = folder(spark)
    ticks = X.to_table(X.tick_means(events(spark, d), "1 day"), path, "ticks")
    found = X.to_table(X.onset(spark.readStream.schema(ticks.schema).parquet(f"{path}/ticks")), path, "onset", "update")
    last = found.groupBy("series").agg(F.max_by(F.struct("at", "jump"), "batch").alias("b"))
    return rounded(last.select("series", F.unix_timestamp("b.at").alias("at"), F.col("b.jump").alias("jump")), "jump")


