"""Files that hold matrices, region tables and feature bundles."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_text(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """(i, j, value): a text matrix, one row a line. A file is read whole, so rows count in the order of its lines; empty lines and comments (#) are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    kept = lines.select(F.posexplode(F.filter("lines", lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))).alias("i", "line"))
    cells = kept.select("i", F.posexplode(F.split(F.trim("line"), sep)).alias("j", "cell"))
    return cells.select("i", "j", F.col("cell").cast("double").alias("value"))


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from a headerless CSV of numbers."""
    return matrix_text(spark, path, r"\s*,\s*")


def edges(weights: DataFrame, lengths: DataFrame) -> DataFrame:
    """(src, dst, weight, length) of two matrices."""
    w = weights.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("weight"))
    return w.join(lengths.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("length")), ["src", "dst"])


def region_meta(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(label, x, y, z) of a region table without header."""
    return spark.read.csv(path, sep=sep, schema="label string, x double, y double, z double", comment="#")


def bold_npz(spark: SparkSession, path: str, key: str = "bold") -> DataFrame:
    """(trial, region, t, v): the named array [samples x regions] of each .npz file, trials numbered by a hash of the path."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                x = np.load(io.BytesIO(content))[key].T
                region, t = np.indices(x.shape)
                yield pd.DataFrame({"path": name, "region": region.ravel().astype("int32"), "t": t.ravel().astype("int32"), "v": x.ravel().astype(float)})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, region int, t int, v double")
    return rows.select(F.abs(F.xxhash64("path")).alias("trial"), "region", "t", "v")


def save_bundle(folder: str, features: DataFrame, theta: DataFrame, stats: DataFrame) -> None:
    """Features, parameters and training statistics as Parquet under one folder."""
    for name, df in (("features", features), ("theta", theta), ("feature_stats", stats)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What save_bundle wrote; a missing column is an error."""
    wanted = {"features": {"trial", "label", "value"}, "theta": {"trial"}, "feature_stats": {"label", "mean", "scale", "std"}}
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in wanted}
    for name, columns in wanted.items():
        if not columns <= set(found[name].columns):
            raise ValueError(f"{name} lacks {sorted(columns - set(found[name].columns))}")
    return found
