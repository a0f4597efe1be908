"""All registered queries of the signal library: name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import stats as A
from spindrift.plans import base, catch22, connectivity, files, parameters, posterior, spectral, stats  # noqa: F401  registration


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five features of every region, a trial a row."""
    names = ["calc_mean", "calc_std", "calc_kurtosis", "zero_crossing", "abs_energy"]
    found = A.long(A.region_stats(base.sig(spark, sf_dir), names), names)
    return found.groupBy("trial", "feature").agg(F.avg("value").alias("value")).groupBy("trial").pivot("feature", names).agg(F.first("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
