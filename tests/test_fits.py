"""Polynomial node fits against numpy's least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from spindrift.operators import posterior as B


def columns(m, g, order):
    return np.stack([np.ones_like(m), *[m**i for i in range(1, order + 1)], *[g**i for i in range(1, order + 1)]], axis=1)


def frame(spark, m, g, v):
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(m, g, v)], "myelin double, gradient double, value double")


def fit(df, order):
    rows = B.node_poly_fit(df, order).collect()
    assert [(r.term, r.power) for r in rows] == [("one", 0), *[("myelin", i) for i in range(1, order + 1)], *[("gradient", i) for i in range(1, order + 1)]]
    return [r.coef for r in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_coefficients_equal_plain_least_squares(spark, order):
    rng = np.random.default_rng(order)
    m, g = rng.uniform(-2, 2, (2, 300))
    v = 1 + 2 * m - 0.5 * g**3 + rng.normal(0, 0.1, 300)
    assert fit(frame(spark, m, g, v), order) == pytest.approx(list(np.linalg.lstsq(columns(m, g, order), v, rcond=None)[0]), abs=1e-8)


def test_dependent_columns_still_fit(spark):
    rng = np.random.default_rng(9)
    g = rng.uniform(-1, 1, 100)
    m, v = np.full(100, 2.0), 3 + g
    assert columns(m, g, 2) @ np.array(fit(frame(spark, m, g, v), 2)) == pytest.approx(v, abs=1e-6)


def test_bad_rows_are_left_out_and_no_rows_give_nulls(spark):
    good = frame(spark, [0, 1, 2, 3, 4], [1, 0, 2, 5, 3], [1, 2, 0, 4, 4])
    bad = spark.createDataFrame([(None, 1.0, 1.0), (1.0, float("nan"), 2.0), (1.0, 1.0, float("inf"))], "myelin double, gradient double, value double")
    assert fit(good.unionByName(bad), 1) == pytest.approx(fit(good, 1))
    assert all(c is None or pd.isna(c) for c in fit(bad, 1))
    with pytest.raises(ValueError):
        B.node_poly_fit(good, 0)
