"""Long series in blocks against the kernels on whole series."""

import numpy as np
import pytest

from trackplan.operators import align, timeline
from trackplan.sources.shared import stored

RATE = 100.0


def frame(spark, tracks, length):
    rows = [(k, i, float(v)) for k, s in tracks.items() for i, v in enumerate(s)]
    return timeline.blocks(spark.createDataFrame(rows, "track long, i long, v double"), ["track"], "i", "v", length)


@pytest.fixture(scope="module")
def tracks():
    rng = np.random.default_rng(4)
    master = {k: rng.normal(size=3000) for k in range(4)}
    late = {k: np.concatenate((rng.normal(size=37 * k), s))[: len(s) - 100 * k] for k, s in master.items()}
    late[3] = np.full(2000, 2.0)  # no variation: nothing can be found
    return late, master


@pytest.mark.parametrize("length", [200, 333, 5000])
def test_correlation_is_independent_of_blocks(spark, tracks, length):
    late, master = tracks
    found = timeline.correlated(frame(spark, late, length), frame(spark, master, length), ["track"], length, RATE, 2.0)
    for r in found.collect():
        assert (r.offset, r.confidence) == pytest.approx(align.lag(late[r.track], master[r.track], RATE, 2.0), rel=1e-6)


def test_probes_equal_the_kernel(spark, tracks):
    late, master = tracks
    probes = spark.createDataFrame([(k, p, t, -0.3 * k) for k in range(3) for p, t in enumerate((0.0, 3.21, 14.0, 24.0))], "track long, probe int, t double, expected double")
    found = timeline.offsets_at(probes, frame(spark, late, 250), frame(spark, master, 250), ["track"], "probe", 250, RATE, 0.5, 4.0).collect()
    assert len(found) == 12
    for r in found:
        want = align.offset_at(late[r.track], master[r.track], RATE, r.t, -0.3 * r.track, 0.5, 4.0)
        assert r.offset == pytest.approx(want[0], abs=1e-9)


def test_conformed_tracks_are_aligned(spark):
    """A late track and one with a piece cut out, moved onto the master's timeline, block by block; a third is refused."""
    rng = np.random.default_rng(9)
    master = rng.normal(size=4000)
    late = np.concatenate((np.zeros(150), master))[:4000]
    cut = np.concatenate((master[:1500], master[1700:]))
    knots = [(0, 0.0, -1.5, 0.0), (0, 40.0, 38.5, 0.0), (1, 0.0, 0.0, 0.0), (1, 15.0, 15.0, 2.0), (1, 15.000001, 17.000001, 0.0), (1, 38.0, 40.0, 0.0), (2, 0.0, 0.0, 31.0), (2, 38.0, 40.0, 0.0)]
    table = spark.createDataFrame(knots, "track long, old_t double, new_t double, gap double")
    out, refused = timeline.conformed(frame(spark, {0: late, 1: cut, 2: cut}, 300), table, ["track"], 300, RATE)
    assert [tuple(r) for r in refused.collect()] == [(2, 31.0)]
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.track, r.block)):
        found.setdefault(r.track, []).extend(r.samples)
    for k, source in ((0, late), (1, cut)):
        line = [x[1:] for x in knots if x[0] == k]
        assert found[k] == pytest.approx(align.conformed(source, source, RATE, line).tolist(), abs=1e-9)
    assert found[0][:3800] == pytest.approx(master[:3800].tolist(), abs=1e-6)
    assert found[1][:1499] == pytest.approx(master[:1499].tolist(), abs=1e-3) and not any(found[1][1502:1698]) and found[1][1703:3990] == pytest.approx(master[1703:3990].tolist(), abs=1e-3)


def test_steps_are_found_in_rounds(spark):
    """Steps of the offset planted at known places, many tracks at once."""
    rng = np.random.default_rng(5)
    master, tracks, steps = {}, {}, []
    for k in range(5):
        s = rng.normal(size=6000)
        at = 2000 + 300 * k
        master[k], tracks[k] = s, np.concatenate((s[:at], rng.normal(size=60), s[at:]))[:6000]
        steps.append((k, 0, 10.0, 50.0, 0.0, -0.6))
    table = spark.createDataFrame(steps, "track long, step int, t0 double, t1 double, before double, after double")
    found = timeline.localised_steps(table, frame(spark, tracks, 500), frame(spark, master, 500), ["track"], "step", 500, RATE, 0.5, 2.0, stored).collect()
    for r in found:
        assert abs(r["at"] - (20 + 3 * r.track)) <= 40 / 2**5 + 2.0
