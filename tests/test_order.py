"""Rows of pairs leave a tile in an order that takes little room in files, and are the same rows."""

import numpy as np
import pytest

from spindrift.operators import connectivity as C
from spindrift.operators import kernels, tiles


def recordings(spark, trials):
    return spark.createDataFrame([(t, r, x[r].tolist()) for t, x in trials.items() for r in range(len(x))], "trial long, region int, v array<double>")


def bytes_a_row(df, folder):
    df.write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.glob("*.parquet")) / df.sparkSession.read.parquet(str(folder)).count()


def matrix(rows, n):
    out = np.full((n, n), np.inf)
    assert not rows.duplicated(["i", "j"]).any()
    out[rows.i, rows.j] = rows.w
    return out[np.triu_indices(n, 1)]


@pytest.fixture(scope="module")
def many():
    return np.random.default_rng(11).normal(size=(2000, 64))


def test_many_rounded_pairs_take_half_the_room(spark, many, tmp_path):
    recs = recordings(spark, {0: many})
    # In the order of the regions a pair takes 8.4 bytes, as its value is written in full.
    got = C.fc_matrix(recs, digits=5)
    assert bytes_a_row(got, tmp_path / "fc") < 4.7
    np.testing.assert_allclose(matrix(got.toPandas(), 2000), np.corrcoef(many)[np.triu_indices(2000, 1)], atol=5.1e-6)
    assert bytes_a_row(C.plv_matrix(recs, digits=5), tmp_path / "plv") < 4.7
    assert bytes_a_row(C.fisher_matrix(recs, digits=5), tmp_path / "z") < 4.7


def test_many_rounded_windows_take_half_the_room(spark, many, tmp_path):
    got = C.sliding_fc_strided(recordings(spark, {0: many}), 40, 0.5, digits=5)
    assert bytes_a_row(got, tmp_path / "windows") < 4.7
    rows = got.toPandas()
    assert sorted(rows.w0.unique()) == [0, 20]
    for lo in (0, 20):
        np.testing.assert_allclose(matrix(rows[rows.w0 == lo], 2000), np.corrcoef(many[:, lo : lo + 40])[np.triu_indices(2000, 1)], atol=5.1e-6)


def test_values_are_put_in_order_only_where_that_saves_room():
    rng = np.random.default_rng(4)
    repeated, few, single = rng.integers(0, 100_000, 1_000_000) / 1e5, rng.integers(0, 1000, 1_000_000) / 1e3, rng.normal(size=300_000)
    at = tiles.in_order(repeated)
    assert (np.diff(repeated[at]) >= 0).all() and (np.sort(at) == np.arange(len(at))).all()
    for w in (few, single, np.zeros(0), np.full(10, np.nan)):
        assert tiles.in_order(w) == slice(None)


@pytest.mark.parametrize("digits", [None, 3])
@pytest.mark.parametrize("cut, hop", [(1 << 14, 1), (30, 1), (30, 7)])
def test_windows_as_rows_equal_those_as_lists(spark, monkeypatch, digits, cut, hop):
    monkeypatch.setattr(tiles, "CHUNK", 50)
    rng = np.random.default_rng(6)
    bad = rng.normal(size=(9, 60))
    bad[2, :35], bad[4, 50] = 3.0, np.nan
    recs = recordings(spark, {0: rng.normal(size=(21, 60)).cumsum(axis=1), 1: bad, 2: rng.normal(size=(3, 41)), 3: rng.normal(size=(1, 60))})
    starts = np.arange(0, 41, hop)
    got = {(r.trial, r.w0, r.i, r.j): r.w for r in tiles.windows(recs, 20, starts, 21, 4, cut, digits).collect()}
    wanted = {}
    for r in tiles.window_vectors(recs, 20, starts, 21, 4, cut, digits).collect():
        wanted |= {(r.trial, int(starts[r.first + k]), r.i, r.j): w for k, w in enumerate(r.f)}
    assert got.keys() == wanted.keys() and {k[0] for k in got} == {0, 1, 2}
    np.testing.assert_allclose([got[k] for k in wanted], list(wanted.values()), atol=1e-9 if digits is None else 0.00101, equal_nan=True)
    assert np.isnan(list(got.values())).any()
    assert tiles.windows(recs, 20, starts[:0], 21).count() == 0 and kernels.strided(10, 20, 0.5, 200)[1].size == 0


def test_rounding_in_place_is_half_away_from_zero():
    x = np.array([0.125, -0.125, 1e-9, -1e-9, np.nan, np.inf, -np.inf, 1e300, -1.005, 2.5])
    before = x.copy()
    got = tiles.near(x, 2)
    np.testing.assert_array_equal(x, before)
    np.testing.assert_array_equal(got, [0.13, -0.13, 0, 0, np.nan, np.inf, -np.inf, 1e300, -1.0, 2.5])
    assert not np.signbit(got[2:4]).any()
