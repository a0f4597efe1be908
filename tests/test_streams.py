"""Streams against plain loops over the same rows: several batches, late rows, series without values."""

from __future__ import annotations

import itertools
import os
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest

from spindrift.streaming import windows as X

START = datetime(2024, 1, 4)  # a Thursday: weeks of seven days since 1970 start there


def write(spark, folder, name, rows, age):
    """One file of the source; older files come first."""
    spark.createDataFrame(rows, "ts timestamp, series string, value double").coalesce(1).write.parquet(f"{folder}/{name}")
    for root, _, files in os.walk(f"{folder}/{name}"):
        for f in files:
            os.utime(f"{root}/{f}", (1_700_000_000 - age, 1_700_000_000 - age))


def plain(rows, finished):
    by = {}
    for ts, series, value in rows:
        if series is not None and value is not None:
            by.setdefault(((ts - START).days, series), []).append(value)
    mean, found = {k: float(np.mean(v)) for k, v in by.items()}, {}
    for a, b in itertools.combinations(sorted({s for _, s in mean}), 2):
        for week in {d // 7 for d, _ in mean}:
            both = [(mean[d, a], mean[d, b]) for d in range(week * 7, week * 7 + 7) if (d, a) in mean and (d, b) in mean]
            if both and START + timedelta(days=week * 7 + 7) <= finished:
                x, y = np.array(both).T
                found[week, a, b] = (len(both), None if x.std() * y.std() == 0 else float(((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std())))
    return found


@pytest.fixture(scope="module")
def streamed(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rng = np.random.default_rng(3)
    at = lambda day: START + timedelta(days=day, hours=float(rng.uniform(0, 23)))
    batches = []
    for first, last in ((0, 9), (9, 17), (17, 26)):
        rows = [(at(day), s, float(rng.normal(1e6, 1.0))) for day in range(first, last) for s in ("a", "b", "c") for _ in range(2) if (day, s) != (3, "c")]
        rows += [(at(day), "flat", 2.0) for day in range(first, last)] + [(at(first), None, 1.0), (at(first), "empty", None)]
        batches.append(rows)
    late = [(START + timedelta(days=1), "a", -1e9)]  # its week was given out before the last batch came
    for i, rows in enumerate([*batches[:2], batches[2] + late]):
        write(spark, folder, f"part={i}", rows, 100 - i)
    source = spark.readStream.schema("ts timestamp, series string, value double, part int").option("maxFilesPerTrigger", 1).parquet(folder)
    out = tempfile.mkdtemp(prefix="spark-")
    found = X.to_table(X.stream_correlation(source, "1 day", "7 days"), out, "fc").collect()
    on_time = [r for rows in batches for r in rows]
    return found, plain(on_time, max(r[0] for r in on_time) - timedelta(hours=1))


def test_closed_windows_equal_plain_correlations_and_late_rows_are_left_out(streamed):
    found, want = streamed
    got = {((r.start - START).days // 7, r.a, r.b): (r.n, r.r) for r in found}
    assert len(got) == len(found) and got.keys() == want.keys() and len({w for w, _, _ in got}) == 3
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else got[k][1] == pytest.approx(r, abs=1e-6)), k


def test_windows_still_open_wait(streamed):
    assert max((r.start - START).days // 7 for r in streamed[0]) == 2  # the fourth week ends on day 28
