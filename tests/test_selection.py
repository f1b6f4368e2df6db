"""Quantiles and median slopes by counting against sorting and all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplan.operators import matching, selection
from trackplan.sources.shared import stored


@pytest.mark.parametrize(("most", "bins"), [(10_000, 4096), (20, 8), (1, 3)])
def test_percentiles(spark, most, bins):
    rng = np.random.default_rng(1)
    values = {0: rng.normal(size=500), 1: np.exp(rng.normal(size=301) * 8), 2: np.full(90, 3.5), 3: np.repeat([1.0, 2.0], 45), 4: np.array([7.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [(0, None), (5, None)]
    frame = spark.createDataFrame(rows, "k long, v double")
    for q in (0.5, 0.1, 1.0):
        found = {r.k: r.value for r in selection.percentiles(frame, ["k"], F.col("v"), q, stored, most, bins).collect()}
        assert found == pytest.approx({k: float(np.quantile(x, q)) for k, x in values.items()}, rel=1e-12)


def test_falling_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 200):
        t, r = rng.integers(0, 20, n).astype(float), rng.integers(-9, 9, n).astype(float)
        assert selection.falling(t, r) == sum(t[i] < t[j] and r[i] >= r[j] for i in range(n) for j in range(n))


def test_median_slopes(spark):
    """Ties in time and value, an even and an odd number of pairs, a steep and a flat group."""
    rng = np.random.default_rng(3)
    groups = {0: (rng.integers(0, 30, 90), rng.normal(size=90)), 1: (np.arange(40), 1e4 * np.arange(40) + rng.normal(size=40)), 2: (np.arange(7), np.ones(7)), 3: (np.array([1, 1, 2]), np.array([0.0, 1.0, 5.0])), 4: (np.array([1, 1]), np.array([2.0, 3.0]))}
    rows = [(k, float(a), float(b)) for k, (t, e) in groups.items() for a, b in zip(t, e, strict=True)]
    found = {r.k: r.slope for r in selection.median_slopes(spark.createDataFrame(rows, "k long, t double, e double"), ["k"], "t", "e", stored, 4, slopes=15, rounds=16).collect()}
    for k, (t, e) in groups.items():
        slopes = [(e[j] - e[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]]
        assert (k in found) == bool(slopes)
        if slopes:
            assert found[k] == pytest.approx(np.median(slopes), rel=1e-9, abs=1e-9)


def test_nearest_by_bands(spark):
    """References near, at every distance, equal and null; the same rows as by all pairs, from far fewer pairs."""
    rng = np.random.default_rng(6)
    references = [(k, int(h)) for k, h in enumerate(rng.integers(-(1 << 63), 1 << 63, 400))]
    rows = []
    for g in range(60):
        for f in range(3):
            h = references[int(rng.integers(0, 400))][1] if g % 4 else int(rng.integers(-(1 << 63), 1 << 63))
            for b in rng.choice(64, int(rng.integers(0, 18)), replace=False).tolist():
                h ^= -(1 << 63) if b == 63 else 1 << b
            rows.append((g, f, h, None if f == 2 else h ^ 1))
    rows += [(99, 0, None, None), (98, 0, references[5][1], references[5][1])]
    frame = spark.createDataFrame(rows, "g long, f int, h long, h2 long")
    known = spark.createDataFrame([*references, (900, references[5][1]), (901, None)], "id long, rh long")
    args = (["g"], ["f"], ["h", "h2"], "rh", "id")
    want = {tuple(r) for r in matching.nearest(frame, known, *args).collect() if r.g != 99}
    assert {tuple(r) for r in matching.nearest_indexed(frame, known, *args, stored).collect() if r.g != 99} == want


def test_nearest_by_bands_spreads_no_flips(spark, monkeypatch):
    """Bands with all their flips are never broadcast, however small their rows look before they are multiplied; blocks give the least of equally close references."""
    monkeypatch.setattr(matching, "BLOCK", 70, raising=False)
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(-(1 << 63), 1 << 63, n).tolist()
    hashes, near = draw(300), draw(40)
    rows = [(f"g{k // 2}" if k > 5 else None, k % 2, h ^ (1 << k % 50) if k % 3 else near[k % 40], h) for k, h in enumerate(hashes)]
    # two references under one name, and two variants of a row that are as close to different ones
    known = [(f"r{k % 190:03}", h) for k, h in enumerate(draw(260) + near)] + [("r999", 0b111), ("r000", 0b111 << 40)]
    rows += [("tie", 0, 0b110, 0b011 << 40), ("none", 0, None, None), ("none", 1, None, None)]
    frame, references = spark.createDataFrame(rows, "g string, f int, h long, h2 long"), spark.createDataFrame([*known, ("a", None)], "id string, rh long")
    plans = []

    def cut(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    args = (["g"], ["f"], ["h", "h2"], "rh", "id")
    want = {tuple(r) for r in matching.nearest(frame, references, *args).collect()}
    assert {tuple(r) for r in matching.nearest_indexed(frame, references, *args, cut).collect()} == want
    assert any(r[0] is None for r in want) and ("tie", 1, 0, "r000", 1) in want and ("none", 64, 0, "a", 0) in want
    assert not [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin" in line and "band" in line]


@pytest.mark.parametrize("few", [100_000, 0])
def test_median_slopes_of_many_blocks(spark, few):
    """Noise, repeated points, two values only, one value, a burst with a far end and a null group: in few rounds, without a row for each point and slope."""
    rng = np.random.default_rng(4)
    groups = {"noise": (rng.random(700) * 30, np.round(rng.exponential(50, 700), 2)), "copies": (np.repeat(rng.random(40), 15), np.repeat(rng.normal(size=40), 15)), "coins": (rng.integers(0, 200, 500), rng.integers(0, 2, 500)), "flat": (np.arange(300), np.full(300, 2.5)), "burst": (np.append(rng.random(400) * 1e-6, 1e3), rng.normal(size=401)), "line": (np.arange(90), 3.0 - 2.0 * np.arange(90))}
    rows = [(k, float(a), float(b)) for k, (t, e) in groups.items() for a, b in zip(t, e, strict=True)] + [(None, 1.0, 2.0), (None, 2.0, 3.0), ("alone", 1.0, None), ("alone", 2.0, 1.0)]
    stores = []

    def cut(df, name):
        out = stored(df, name)
        stores.append(out.count())
        return out

    found = {r.k: r.slope for r in selection.median_slopes(spark.createDataFrame(rows, "k string, t double, e double"), ["k"], "t", "e", cut, 4, slopes=31, precision=1e-11, few=few, block=128).collect()}
    assert found.keys() == groups.keys()
    for k, (t, e) in groups.items():
        i, j = np.nonzero(t[:, None] < t)
        slopes = (e[j] - e[i]) / (t[j] - t[i])
        assert found[k] == pytest.approx(np.median(slopes), rel=1e-13 if few else 1e-9, abs=1e-9), k
    assert sum(stores) < len(rows) and len(stores) < 25, stores


def test_median_slopes_store_no_row_for_each_slope(spark):
    rng = np.random.default_rng(5)
    t, e = rng.random(700) * 30, np.round(rng.exponential(50, 700), 2)
    stores = []

    def cut(df, name):
        out = stored(df, name)
        stores.append(out.count())
        return out

    points = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, e, strict=True)], "k long, t double, e double")
    found = selection.median_slopes(points, ["k"], "t", "e", cut, 4, slopes=31, precision=1e-9).first().slope
    i, j = np.nonzero(t[:, None] < t)
    assert found == pytest.approx(np.median((e[j] - e[i]) / (t[j] - t[i])), rel=1e-13)
    assert sum(stores) < len(t)
