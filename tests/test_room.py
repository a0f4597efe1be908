"""What rows of pairs take in files does not grow with the regions of a tile, and the order that sees to it loses no row."""

import numpy as np
import pytest

from spindrift.operators import connectivity as C
from spindrift.operators import costs, tiles
from spindrift.operators import signal as S

from tests.test_order import bytes_a_row, matrix, recordings


@pytest.fixture(scope="module")
def many():
    return np.random.default_rng(12).normal(size=(2000, 64))


def rows_of(found):
    parts = [np.column_stack([np.asarray(c, float) for c in columns]) for columns in found]
    return np.concatenate(parts)


def stretches(x):
    return 1 + np.count_nonzero(x[1:] != x[:-1])


@pytest.mark.parametrize("same, more", [(False, False), (True, False), (False, True), (True, True)])
def test_ranges_of_values_lose_no_pair(monkeypatch, same, more):
    for name, value in (("TOGETHER", 4000), ("STRIP", 700), ("FEW", 100), ("CHUNK", 512)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(130, 130) if same else (130, 97)), 3)
    m[5], m[:, 60], m[7, 8], m[9, 9:12], m[100, 3] = np.nan, -np.inf, np.inf, 1e300, -1e12
    keep = rng.random(m.shape) < 0.7
    beside = [rng.normal(size=m.shape), rng.random(m.shape) < 0.5] if more else []
    got = rows_of(tiles.by_value(*m.shape, lambda r, c: (m[r, c], keep[r, c], [x[r, c] for x in beside]), 2, None, same))
    i, j = np.nonzero(keep & (np.arange(m.shape[1]) > np.arange(130)[:, None]) if same else keep)
    wanted = np.column_stack([i, j, tiles.near(m[i, j], 2), *(x[i, j] for x in beside)])
    np.testing.assert_array_equal(got[np.lexsort(got[:, 1::-1].T)], wanted[np.lexsort(wanted[:, 1::-1].T)])
    # What can be put in order is, over the whole tile: as many stretches of equal values as values, less than two a range more.
    w = got[np.isfinite(got[:, 2]) & (np.abs(got[:, 2]) < 1e6), 2]
    assert len(np.unique(w)) <= stretches(w) < len(np.unique(w)) + 2 * len(w) / 4000 + 2


def test_rows_that_stay_repeat_their_places_closely():
    m = np.random.default_rng(1).integers(0, 9, (40, 3000)) / 10
    got = rows_of(tiles.by_value(40, 3000, lambda r, c: (m[r, c], None, []), 6))
    assert len(got) == m.size and (m[got[:, 0].astype(int), got[:, 1].astype(int)] == got[:, 2]).all()
    # A snappy block has 64 KB: the same places come again within a few hundred bytes.
    assert (got[tiles.ACROSS : 30 * tiles.ACROSS, 1] == got[: 29 * tiles.ACROSS, 1]).all()


def test_a_mask_makes_only_its_pairs(spark):
    x = np.random.default_rng(3).normal(size=(31, 40))
    recs = recordings(spark, {0: x, 1: x[:6], 2: x[:1]})
    for mask in ("interh", "intrah"):
        got = C.fc_matrix(recs, digits=6, mask=mask)
        assert "Join" not in (plan := got._jdf.queryExecution().toString())[: plan.index("FlatMapGroupsInArrow")]
        wanted = C.only_mask(C.fc_matrix(recs, digits=6), C.sizes(recs), mask)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        assert sorted(map(tuple, C.fc_matrix(recs, mask=mask).select("trial", "i", "j").collect())) == sorted(tuple(r)[:3] for r in wanted.collect())
    with pytest.raises(ValueError):
        C.fc_matrix(recs, digits=6, mask="other")


def test_pairs_of_long_signals_leave_by_value(spark, many, tmp_path):
    sig = S.to_signal(recordings(spark, {0: many}))
    # In the order of the regions, rounded after they had left their tiles, both took more than 8 bytes.
    got = C.inner_products(sig, digits=3)
    assert bytes_a_row(got, tmp_path / "inner") < 4.7
    np.testing.assert_allclose(matrix(got.withColumnRenamed("value", "w").toPandas(), 2000), (many @ many.T)[np.triu_indices(2000, 1)], atol=5.1e-4)
    got = C.fc_join(sig, digits=5)
    assert bytes_a_row(got, tmp_path / "join") < 4.7
    np.testing.assert_allclose(matrix(got.toPandas(), 2000), np.corrcoef(many)[np.triu_indices(2000, 1)], atol=5.1e-6)


def test_rounding_in_the_tiles_keeps_gaps_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(0, r, t, None if (r, t) == (1, 3) or r == 5 else float(rng.normal())) for r in range(7) for t in range(12) if (r + t) % 5]
    sig = spark.createDataFrame([*rows, *((1, r, t, float(rng.normal())) for r in range(3) for t in range(9))], "trial long, region int, t int, v double")
    for of, name in ((C.inner_products, "value"), (C.fc_join, "w")):
        got, wanted = ({(r.trial, r.i, r.j): r[name] for r in of(sig, **k).collect()} for k in ({"digits": 4}, {}))
        assert got.keys() == wanted.keys() and None in got.values()
        assert all(got[k] is None if w is None else abs(got[k] - w) < 5.1e-5 for k, w in wanted.items())


def test_pairs_of_sets_leave_by_value(spark, many, tmp_path):
    recs = recordings(spark, {t: many[:1500] + t * many[500:] for t in (0, 1)})
    # Both values in full take more than 16 bytes with their places.
    got = costs.set_pairs(recs, 1, digits=5)
    assert bytes_a_row(got, tmp_path / "pairs") < 13.5
    assert bytes_a_row(costs.set_average(recs, 1, digits=5), tmp_path / "mean") < 5.5
    rows = got.toPandas()
    for c, x in (("x", many[:1500] + many[500:]), ("y", many[:1500])):
        np.testing.assert_allclose(matrix(rows.assign(w=rows[c]), 1500), np.arctanh(np.corrcoef(x)[np.triu_indices(1500, 1)]), atol=5.1e-6)


def test_a_range_of_values_goes_through_all_windows(spark, many):
    got = C.sliding_fc_strided(recordings(spark, {0: many}), 40, 0.5, digits=5).filter("i < 1000 and j >= 1000").toPandas()
    # About 100,000 values are two ranges, each of which a file's dictionary holds: both windows for the first, then both for the second.
    assert len(got) == 2_000_000 and stretches(got.w0.to_numpy()) == 4
    first = got.w[:900_000]
    # The value at the border may be in both ranges.
    assert first.max() <= got.w[-900_000:].min() and stretches(got.w.to_numpy()) < 4 * 200_000
