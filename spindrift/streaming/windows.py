"""Series as streams: (ts TIMESTAMP, series STRING, value DOUBLE) with event time, watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _five() -> list[Column]:
    return [F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]


def window_stats(stream: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, series, n, mean, std, min, max) per tumbling or sliding window; a window is final once the watermark passes its end."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "series").agg(*_five())
    return found.select(F.col("w.start").alias("start"), "series", "n", "mean", "std", "min", "max")


def session_stats(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """(start, finish, series, n, mean, std, min, max) per burst of activity that a pause of ``gap`` ends."""
    found = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "series").agg(*_five())
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "series", "n", "mean", "std", "min", "max")


def tick_means(stream: DataFrame, tick: str, delay: str = "1 hour") -> DataFrame:
    """(tick, series, value): mean value per tick of time."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", tick).alias("w"), "series").agg(F.avg("value").alias("value")).select(F.col("w.start").alias("tick"), "series", "value")


def pair_correlation(ticks: DataFrame, every: str) -> DataFrame:
    """(start, a, b, n, r) of finished ticks: correlation of each pair of series inside each window of time; for foreachBatch or batch."""
    x, y = F.col("x"), F.col("y")
    one = ticks.select("tick", F.col("series").alias("a"), F.col("value").alias("x"))
    other = ticks.select("tick", F.col("series").alias("b"), F.col("value").alias("y"))
    met = one.join(other, "tick").filter("a < b").withColumn("start", F.window("tick", every)["start"])
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return met.groupBy("start", "a", "b").agg(F.count("*").alias("n"), r.alias("r"))


def stream_correlation(stream: DataFrame, tick: str, every: str, delay: str = "1 hour") -> DataFrame:
    """(start, a, b, n, r) of a stream (ts, series, value): the correlation of each pair of series over the tick means of each window of time, in one streaming plan.

    Three aggregations follow each other: means a tick and series, the series of a tick side by side, and moments a window
    and pair, which merge over ticks and batches. A window is given out once the watermark passes its end, and then its state goes; later
    rows are left out. State holds open ticks and windows: a row a pair and window, a list of the series a tick. Ticks count
    where both series have a value; a pair whose series has no spread, or has one tick, has a null r. A series that is null is left out.
    """
    means = stream.filter("series is not null").withWatermark("ts", delay).groupBy(F.window("ts", tick).alias("w"), "series").agg(F.avg("value").alias("value"))
    seen = F.when(F.col("value").isNotNull(), F.struct("series", "value"))
    ticks = means.groupBy("w").agg(F.array_sort(F.collect_list(seen)).alias("s"))
    one = ticks.select("w", "s", F.posexplode("s").alias("i", "one"))
    met = one.select("w", "one", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("other"))
    x, y = F.col("one.value"), F.col("other.value")
    moments = met.groupBy(F.window(F.window_time("w"), every).alias("v"), F.col("one.series").alias("a"), F.col("other.series").alias("b")).agg(
        F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")
    )
    return moments.select(F.col("v.start").alias("start"), "a", "b", "n", "r")


def onset(ticks: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(series, at, jump): the largest rise from one tick to the next so far, and the tick before it, as state per series.

    State is the last value and the best rise. Ticks of a series must come in order, as finished windows do; a batch
    is sorted first. A rise below the threshold is not reported.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state):
        last, best, at = state.get if state.exists else (None, None, None)
        rows = sorted((r for frame in frames for r in frame.itertuples()), key=lambda r: r.tick)
        for row in rows:
            now = row.tick.value // 1000
            if last is not None and (best is None or row.value - last[1] > best):
                best, at = row.value - last[1], last[0]
            last = (now, row.value)
        state.update((last, best, at))
        if best is not None and best >= threshold:
            yield pd.DataFrame({"series": [key[0]], "at": pd.to_datetime([at], unit="us"), "jump": [best]})

    return ticks.groupBy("series").applyInPandasWithState(
        update, "series string, at timestamp, jump double", "last struct<at:long,value:double>, best double, at long", "update", "NoTimeout"
    )


def onset_batch(ticks: DataFrame, threshold: float = 0.02) -> DataFrame:
    """The same of a finished table."""
    from pyspark.sql import Window

    step = ticks.withColumn("jump", F.lead("value").over(Window.partitionBy("series").orderBy("tick")) - F.col("value"))
    best = step.groupBy("series").agg(F.max_by(F.struct("tick", "jump"), F.struct("jump", -F.unix_micros("tick"))).alias("b"))
    return best.filter(F.col("b.jump") >= threshold).select("series", F.col("b.tick").alias("at"), F.col("b.jump").alias("jump"))


def to_table(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there now into Parquet (append) or, for update mode, rewritten last values per batch, and read it back."""
    path, marks = f"{folder}/{name}", f"{folder}/{name}-progress"
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(path)
