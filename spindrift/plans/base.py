"""Registration of queries and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import signal as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under name, with the DuckDB SQL of the same result."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the embeddings: a trial per label, its vectors as regions in the order of their ids."""
    return S.recordings(S.number_regions(table(spark, sf_dir, "embeddings"), "label", "vec_id"), "label", "region", "embedding")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_signal(recs(spark, sf_dir))


def R(x: str | Column, digits: int = 6) -> Column:
    """Rounded, so that sums in another order compare equal."""
    return F.round(F.expr(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: R(F.col(c), digits) for c in columns})


def q(x: str, digits: int = 6) -> str:
    """The SQL of R."""
    return f"(round({x}, {digits}) + 0.0)"


#: The signal of the embeddings, as the first of a list of common table expressions.
SIG = """with recursive num as (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as region from embeddings),
sig as (select cast(label as bigint) as trial, cast(region as int) as region, cast(i - 1 as int) as t, cast(x as double) as v
        from (select label, region, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from num))"""
#: Events by day: one trial, a region per event type, t counts days.
DAILY = """with per as (select event_type as series, date_trunc('day', ts) as day, avg(value) as v from events group by 1, 2),
grid as (select unnest(generate_series((select min(day) from per), (select max(day) from per), interval 1 day)) as day),
names as (select series, row_number() over (order by series) - 1 as region from (select distinct series from per)),
sig as (select cast(0 as bigint) as trial, cast(region as int) as region, cast(date_diff('day', (select min(day) from per), g.day) as int) as t,
        coalesce(last_value(v ignore nulls) over (partition by region order by g.day), 0.0) as v
        from names n cross join grid g left join per p on p.series = n.series and p.day = g.day)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_events(table(spark, sf_dir, "events"), "ts", "event_type", "value")


def hilbert(source: str) -> str:
    """Tables hb (trial, region, t, v, y: the transform's value) and an (with amp and the unwrapped phase) of a table (trial, region, t, v) of 64 samples a series, by the kernel 2 / n / tan(pi m / n) at odd distances m."""
    return f"""hb as (select a.trial, a.region, a.t, a.v, b.y from {source} a join (select o.trial, o.region, g.t, sum(o.v * case when (g.t - o.t) % 2 <> 0 then 2.0 / 64 / tan(pi() * (g.t - o.t) / 64) else 0 end) as y from {source} o cross join (select unnest(range(0, 64)) as t) g group by all) b on b.trial = a.trial and b.region = a.region and b.t = a.t),
ph as (select *, sqrt(v * v + y * y) as amp, atan2(y, v) as angle from hb), st as (select *, angle - lag(angle) over (partition by trial, region order by t) as d from ph),
an as (select trial, region, t, amp, angle, sum(coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), angle)) over (partition by trial, region order by t) as phase from st)"""
