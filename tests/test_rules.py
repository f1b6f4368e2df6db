"""Fixtures for rules that SQL over the tables does not reach."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplan.functions import numbers as N
from trackplan.functions import text as X
from trackplan import registry
from trackplan.operators import align, planning, rectangles, series, tracks
from trackplan.operators.queue import scannable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("order, combed, height, expected", [("progressive", 80, 480, False), ("tt", 30, 576, True), ("", 80, 240, False), ("", 80, 480, True)])
def test_interlace(spark, order, combed, height, expected):
    assert one(spark, N.interlace_decision(F.lit(order), F.lit(combed), F.lit(100), F.lit(height)))["interlaced"] is expected


def test_small_rules(spark):
    assert one(spark, N.ratio(F.lit("24000/1001"))) == pytest.approx(23.976, abs=1e-3)
    assert one(spark, N.ratio(F.lit("5/0"), 7.0)) == 7.0
    assert one(spark, N.ratio(F.lit("x"), 7.0)) == 7.0
    assert one(spark, N.base_cq(F.lit("mid"), F.lit(10), F.lit(True))) == 21
    assert one(spark, N.is_lossless(F.lit("dts"), F.lit(3920049))) and not one(spark, N.is_lossless(F.lit("dts"), F.lit(768000)))
    assert [one(spark, N.padded_height(F.lit(h))) for h in (2076, 1608, 2160, 1944, 1943)] == [2160, 0, 0, 2160, 0]
    assert one(spark, planning.upscale_factor(F.lit(360), [2, 3, 4])) == 3
    assert one(spark, planning.tile_ladder(F.lit(100))) == [100, 64, 64, 0]
    assert one(spark, N.runtime_agrees(F.lit(5760), F.lit(100)))["note"] == "runtime_pal_speedup"
    assert one(spark, N.hamming(F.lit(5).cast("long"), F.lit(None).cast("long"))) == 64
    assert one(spark, N.repair_strength("auto", F.lit("awful"), F.lit(True))) == "strong" and one(spark, N.repair_strength("weak", F.lit("high"), F.lit(False))) is None


def test_text(spark):
    assert one(spark, X.strip_suffix(F.lit("Ep Title_AV1_AV1"))) == "Ep Title"
    assert one(spark, X.strip_suffix(F.lit("AV1 Rising"))) == "AV1 Rising"
    assert one(spark, X.clock_seconds(F.lit("01:02:03.5"))) == 3723.5
    text = "some words of a synopsis, long enough to be wrapped at sixty-four characters; " * 3
    assert one(spark, X.word_wrapped(F.lit(text))) == textwrap.wrap(text, 64, break_on_hyphens=False)
    assert one(spark, X.sniffed_language(X.script_profile(F.lit("Hi.")))) == "unknown"


def test_name_is_idempotent(spark):
    none = F.lit(None).cast("string")
    name = X.build_name(F.lit("A Film: Two, AV1"), F.lit(2001), F.lit(None).cast("int"), F.lit(None).cast("int"), none, none, F.lit(1080))
    assert one(spark, name) == "A_Film_Two-(2001)-AV1_1080p"
    p = X.parsed_path(F.concat(name, F.lit(".mkv")))
    again = X.build_name(p["title"], p["year"], p["season"], p["episode"], none, none, F.lit(1080))
    assert one(spark, again) == one(spark, name)


def test_scannable(spark):
    rows = spark.createDataFrame([("a/x.MKV", 10), ("a/._y.mkv", 10), ("a/z.txt", 10), ("b.mp4", 1)], "path string, size long")
    assert [r.path for r in scannable(rows, least=5).collect()] == ["a/x.MKV"]


def test_tracks(spark):
    kind = "array<struct<idx int, lang string, ch int, codec string, bit_rate long, aux boolean>>"
    both = F.from_json(F.lit('[{"idx":1,"lang":"jpn","ch":2,"codec":"aac"},{"idx":2,"lang":"eng","ch":6,"codec":"dts","bit_rate":768000}]'), kind)
    assert [s["kind"] for s in one(spark, tracks.audio_slots(both))] == ["boosted", "original", "japanese"]
    lone = F.from_json(F.lit('[{"idx":4,"lang":"fre","ch":2,"codec":"aac"}]'), kind)
    assert [tuple(s) for s in one(spark, tracks.audio_slots(lone))] == [("boosted", 4, "eng"), ("original", 4, "eng")]
    two = F.from_json(F.lit('[{"idx":4,"lang":"fre","ch":2,"codec":"aac"},{"idx":5,"lang":"ger","ch":2,"codec":"aac"}]'), kind)
    assert [tuple(s) for s in one(spark, tracks.audio_slots(two))] == [("foreign", 4, "fre")]
    subs = F.from_json(F.lit('[{"idx":3,"lang":"eng","forced":false,"sdh":false},{"idx":4,"lang":"jpn","forced":false,"sdh":false},{"idx":5,"lang":"eng","forced":true,"sdh":false}]'), "array<struct<idx int, lang string, codec string, forced boolean, sdh boolean, title string>>")
    assert tuple(one(spark, tracks.subtitle_slots(subs, F.lit(True)))) == (5, 3, 4)
    assert [s["idx"] for s in one(spark, tracks.usable_subtitles(subs, F.array(F.lit(4)), F.array().cast("array<string>")))] == [3, 5]
    assert one(spark, tracks.position_of(subs, F.lit(5))) == 2


def test_alignment_kernels():
    rng = np.random.default_rng(1)
    base = rng.normal(size=20000)
    late = np.concatenate([np.zeros(25), base])[:20000]
    found, sure = align.lag(late[:6000], base[:6000], 100.0, 2.0)
    assert found == pytest.approx(-0.25) and sure > 8
    assert all(a[3] and a[1] == pytest.approx(-0.25) for a in align.anchors(late, base, 100.0, step=30.0)[1:])
    assert align.broad_offset(late, base, 100.0)[0] == pytest.approx(-0.25) and align.broad_offset(late, base, 100.0, 0.1)[0] is None
    assert align.localised(lambda t: 0.0 if t < 37 else 1.0, 0.0, 64.0, 0.0, 1.0, steps=6) == pytest.approx(37, abs=1)
    out = align.warped(np.ones(1000), 100.0, np.array([0.0, 10.0]), np.array([0.0, 12.0]), [(2.0, 3.0)])
    assert len(out) == 1200 and out[250] == 0 and out[100] == 1


def test_timeline_chain(spark):
    """A track that starts late, and one that lacks 1.2 s in the middle, come out aligned."""
    rng = np.random.default_rng(8)
    master = rng.normal(size=30000)
    tracks_ = {1: np.concatenate([np.zeros(40), master])[:30000], 2: np.concatenate([master[:15000], master[15120:]])}
    rows = []
    for k, a in tracks_.items():
        found = [x for x in align.anchors(a, master, 100.0, step=20.0, window=10.0) if x[3]]
        for x, y in zip(found, [*found[1:], None], strict=True):
            place = align.localised(lambda t, a=a: align.offset_at(a, master, 100.0, t, 0.0, 6.0, 2.0)[0], x[0], y[0], x[1], y[1], steps=6) if y and abs(y[1] - x[1]) > 0.1 else None
            rows.append((k, float(x[0]), float(x[1]), len(a) / 100.0, place))
    anchors = spark.createDataFrame(rows, "k int, t double, offset double, duration double, step_at double")
    knots = {}
    for r in series.build_warp(anchors, ["k"], "duration", step_at="step_at").orderBy("old_t").collect():
        knots.setdefault(r.k, []).append((r.old_t, r.new_t, r.gap))
    for k, a in tracks_.items():
        out = align.conformed(a, master, 100.0, knots[k])
        for t in (50.0, 120.0, 220.0, 270.0):
            at = int(t * 100)
            assert align.lag(out[at : at + 1500], master[at - 200 : at + 1700], 100.0, 4.0, 0.0)[0] == pytest.approx(2.0, abs=0.02), (k, t)


def test_lines_of_small_groups(spark):
    """One point, or one time, gives slope 0 and the median."""
    rows = [("a", 1.0, 5.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0), ("c", 0.0, 0.0), ("c", 1.0, 2.0)]
    found = {r.g: r for r in series.robust_line(spark.createDataFrame(rows, "g string, t double, e double"), ["g"], "t", "e").collect()}
    assert [(found[g].slope, found[g].intercept, found[g].rms) for g in "ab"] == [(0.0, 5.0, 0.0), (0.0, 2.0, 0.0)] and found["c"].slope == pytest.approx(2.0)


def test_rectangles(spark):
    rows = spark.createDataFrame([(1, 1904, 800, 8, 140), (1, 1912, 802, 4, 138), (1, 1908, 804, 6, 136), (2, 1918, 1078, 0, 0)], "k int, w int, h int, x int, y int").withColumn("fw", F.lit(1920)).withColumn("fh", F.lit(1080))
    found = {r.k: tuple(r)[1:] for r in rectangles.bounding(rows, ["k"], "fw", "fh").collect()}
    assert found == {1: (1912, 804, 4, 136), 2: (None,) * 4}


def test_plan_branches(spark):
    """Every branch of the plan occurs in the query."""
    rows = registry.queries()["plan_rules"](spark, "/root/testdata/sf0.01").collect()
    words = " ".join(r.chain + ";" + r.notes for r in rows)
    for part in ("bwdif", "crop=", "eq=", "deblock=filter=weak", "deblock=filter=strong", "hqdn3d", "zscale", "range=16", "scale=-2:1080", "scale=-2:2160", "atadenoise", "cas=", "uhd_padded", "uhd_downscaled", "uhd_native", "upscale_kept", "hq_source", "lowres", "budget_unavailable", "uhd_budget_cq", "hlg_kept", "deband_skipped", "downscaled_to_1080"):
        assert part in words, part
    assert {r.gate for r in rows} == {True, False} and {r.out_space for r in rows} == {"hdr10", "hlg", "sdr709"}


def test_registry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['trackplan.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and 'quality_tier' in e.queries()"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_joins_beyond_broadcast(spark):
    from trackplan.operators import joins

    rows = spark.range(200).select((F.col("id") / 2).alias("v"))
    gaps = spark.createDataFrame([(3.0, 4.5), (9.5, 31.0), (40.0, 40.0)], "g0 double, g1 double")
    for closed in (False, True):
        few, many = (sorted(map(tuple, joins.in_intervals(rows, gaps, F.col("v"), "g0", "g1", closed, 10.0, most).collect()), key=repr) for most in (10, 0))
        assert few == many and len(few) == 200 and sum(r[1] is not None for r in few) == (49 if closed else 46)
    few, many = (sorted(map(tuple, joins.all_pairs(rows, gaps, most, 4).collect())) for most in (10, 0))
    assert few == many and len(few) == 600


def test_settings(spark):
    from trackplan.functions import numbers, settings

    given = spark.createDataFrame([("x", {"cq_offset": "-20", "uhd_max_gb": " 2.5 ", "sr_tile": "1.5", "gpu_max_pct": "99", "hwaccel": "CUDA "})], "k string, m map<string, string>")
    found = {r.key: (r.value, r.outcome) for r in settings.numbers(given, ["k"], F.col("m")).collect()}
    assert len(found) == len(settings.NUMBERS) and found["cq_offset"] == (-8.0, "limited") and found["uhd_max_gb"] == (2.5, "set")
    assert found["sr_tile"] == (0.0, "unreadable") and found["gpu_max_pct"] == (98.0, "limited") and found["cpu_max_pct"] == (80.0, "default")
    assert {r.key: r.value for r in settings.choices(given, ["k"], F.col("m")).collect()}["hwaccel"] == "cuda"
    assert [r[0] for r in spark.sql("SELECT explode(array('x', '50', NULL)) AS t").select(numbers.clamped(F.col("t"), 1.0, 9.0, 5.0)).collect()] == [5.0, 9.0, 5.0]
