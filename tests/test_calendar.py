from datetime import datetime, timedelta

import pytest

from barfold.operators.calendar import Calendar, Geometry, Schedule, hours, splits

PRODUCTION = Geometry(8760, 24, 24, 168, 24)
SMALL = Geometry(168, 24, 24, 48, 24)


@pytest.mark.parametrize(
    "first, last, geometry, ceiling, rows, snap, cut, counts",
    [
        (datetime(2020, 2, 20, 8), datetime(2026, 6, 29, 22), PRODUCTION, 720, 55719, 4,
         datetime(2023, 4, 25, 23), (1161, 795, 114)),
        (datetime(2024, 1, 4), datetime(2024, 1, 30, 22), SMALL, 48, 647, 12,
         datetime(2024, 1, 16, 23), (14, 5, 3)),
        (datetime(2024, 1, 1), datetime(2024, 1, 30, 22), SMALL, 48, 719, 0,
         datetime(2024, 1, 15, 23), (15, 7, 4)),
    ],
)
def test_known_calendars(first, last, geometry, ceiling, rows, snap, cut, counts):
    c = Calendar(first, last, 0.5, geometry, ceiling)
    assert (c.rows, c.snap, c.cut) == (rows, snap, cut)
    assert tuple(c.folds(n) for n in ("oos", "in_sample_dense", "in_sample")) == counts


def test_oos_windows_tile_and_in_sample_ends_at_the_cut():
    c = Calendar(datetime(2024, 1, 4), datetime(2024, 1, 30, 22), 0.5, SMALL, 48)
    oos = c.schedule("oos")
    starts = [oos.at(j * oos.step + oos.train) for j in range(oos.n_folds)]
    assert starts[0] == c.cut
    assert all(b - a == timedelta(hours=24) for a, b in zip(starts, starts[1:]))
    assert starts[-1] + timedelta(hours=24) == c.last + timedelta(hours=1)
    for name in ("in_sample", "in_sample_dense"):
        s = c.schedule(name)
        assert s.start >= c.first
        assert s.at((s.n_folds - 1) * s.step + s.train + s.test) == c.cut


@pytest.mark.parametrize(
    "change, message",
    [
        ({"geometry": Geometry(168, 12, 24, 48, 24)}, "differs from horizon"),
        ({"geometry": Geometry(168, 24, 24, 48, 12)}, "out-of-sample step"),
        ({"geometry": Geometry(168, 24, 24, 30, 24)}, "multiple of horizon"),
        ({"geometry": Geometry(168, 24, 24, 48, 24, "growing")}, "unknown mode"),
        ({"cut_fraction": 1.0}, "between 0 and 1"),
        ({"longest_lookback": 49}, "inner"),
        ({"last": datetime(2024, 1, 30, 22, 30)}, "whole number of hours"),
        ({"last": datetime(2024, 1, 10)}, "hours before the cut"),
    ],
)
def test_bad_geometry_is_refused(change, message):
    base = {
        "first": datetime(2024, 1, 4), "last": datetime(2024, 1, 30, 22), "cut_fraction": 0.5,
        "geometry": SMALL, "longest_lookback": 48,
    }
    with pytest.raises(ValueError, match=message):
        Calendar(**(base | change))


def test_hours():
    assert [hours(v) for v in (5, "24h", "30d", "2w", timedelta(days=1))] == [5, 24, 720, 336, 24]
    with pytest.raises(ValueError):
        hours("5 minutes")


@pytest.mark.parametrize("mode", ["sliding", "expanding"])
def test_membership_by_division_equals_ranges(spark, mode):
    from pyspark.sql import functions as F

    s = Schedule(datetime(2024, 1, 2), 50, 7, 11, 6, mode)
    rows = spark.range(s.origin - 30, s.origin + 200).withColumnRenamed("id", "p")
    low, high = s.train_folds(F.col("p"))
    tlow, thigh = s.test_folds(F.col("p"))
    for r in rows.select("p", low.alias("a"), high.alias("b"), tlow.alias("c"), thigh.alias("d")).collect():
        off = r.p - s.origin
        train = [j for j in range(6) if (0 if mode == "expanding" else j * 11) <= off < j * 11 + 50]
        test = [j for j in range(6) if j * 11 + 50 <= off < j * 11 + 57]
        assert list(range(r.a, r.b + 1)) == train
        assert list(range(r.c, r.d + 1)) == test


def test_splits_stop_before_the_end():
    s = splits(datetime(2024, 1, 1), datetime(2024, 1, 11), train="7d", test="1d", step="1d")
    assert s.n_folds == 3
    assert splits(datetime(2024, 1, 1), datetime(2024, 1, 3), train="7d", test="1d", step="1d").n_folds == 0
