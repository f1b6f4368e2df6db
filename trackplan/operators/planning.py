"""A plan for each item from an ordered list of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.numbers import CQ_CEILING, CQ_FLOOR
from .tracks import picked_audio

# Filters, and qualities of upscaled, repaired and small pictures.
DEINTERLACE = "bwdif=mode=send_frame:parity=auto:deint=all"
TEN_BIT, OUTPUT = "format=yuv420p10le", "format=p010le"
DEBLOCK = {"weak": "deblock=filter=weak:block=8", "strong": "deblock=filter=strong:block=8"}
DENOISE, REPAIR_DEBAND = "hqdn3d=1.6:1.2:2.5:2.5", "deband=1thr=0.011:2thr=0.011:3thr=0.011:4thr=0.011:range=14:blur=1"
DEBAND = "deband=1thr=0.008:2thr=0.008:3thr=0.008:4thr=0.008:range=16:blur=1"
SCALE = {1080: "scale=-2:1080:flags=lanczos+accurate_rnd+full_chroma_int", 2160: "scale=-2:2160:flags=lanczos+accurate_rnd+full_chroma_int"}
STABILISE = "atadenoise=0a=0.02:0b=0.04:1a=0.02:1b=0.04:2a=0.02:2b=0.04:s=9"
UPSCALE_CQ, UPSCALE_LINES, REPAIR_CQ, SMALL_LINES, SMALL_TRIM, SMALL_CEILING = 28, 720, 24, 576, 8, 36
SATURATED_LINES = 720
MATRIX = {"bt709": "709", "bt470bg": "470bg", "smpte170m": "170m", "smpte240m": "240m", "bt2020nc": "2020_ncl"}
PRIMARIES = {"bt709": "709", "bt470bg": "bt470bg", "bt470m": "bt470m", "smpte170m": "170m", "smpte240m": "240m", "bt2020": "2020", "film": "film"}
TRANSFER = {"bt709": "709", "smpte170m": "601", "bt470bg": "601", "bt470m": "601", "gamma22": "601", "gamma28": "601", "smpte240m": "smpte240m", "iec61966-2-1": "iec61966-2-1", "srgb": "iec61966-2-1"}
FULL_RANGE = ["pc", "full", "jpeg"]


@dataclass(frozen=True)
class Options:
    """What a run asks for, and what its tools can do (a filter, or None)."""

    target: int = 1080
    to_hdr: bool = False
    tone_filter: str | None = None
    hlg_filter: str | None = None
    normalizes: bool = True
    measures: bool = True
    offset: int = 0
    boost_percent: float = 30.0
    repair: str = "auto"
    deband: str = "auto"
    saturation: float = 1.06
    hdr_saturation: float = 1.0
    sharpen: float = 0.30
    stabilise: bool = True


def first_spelling(candidates: Column, known: Column) -> Column:
    """The first candidate that is known or a number; the first of all if nothing is known, the last if none fits."""
    fits = F.filter(candidates, lambda c: F.array_contains(known, c) | c.rlike(r"^\d+$"))
    return F.when(F.size(known) == 0, F.get(candidates, F.lit(0))).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.element_at(candidates, -1)))


def normalized_colour(space: Column, primaries: Column, transfer: Column, range_: Column, height: Column) -> Column:
    """The filter that brings a picture to the usual colours; unknown tags are taken as usual for its height."""
    usual = lambda small, large: F.when(height <= 576, small).otherwise(large)
    m = F.coalesce(N.lookup(MATRIX, space, None), usual("470bg", "709"))
    p = F.coalesce(N.lookup(PRIMARIES, primaries, None), usual("bt470bg", "709"))
    t = F.coalesce(N.lookup(TRANSFER, transfer, None), usual("601", "709"))
    r = F.when(range_.isin(*FULL_RANGE), "full").otherwise("limited")
    return F.format_string("zscale=matrixin=%s:primariesin=%s:transferin=%s:rangein=%s:matrix=709:primaries=709:transfer=709:range=limited", m, p, t, r)


def _within(cq: Column, ceiling: int = CQ_CEILING) -> Column:
    return F.greatest(F.lit(CQ_FLOOR), F.least(F.lit(ceiling), cq)).cast("int")


def planned(items: DataFrame, o: Options = Options()) -> DataFrame:
    """Add chain, cq, out_space, out_w, out_h, maxrate_kbps, upscaled, downscaled, repair, large_master, gate, needs_dv_strip, dv5 and notes.

    items: w, h, crop_w, crop_h, crop_x, crop_y (null: no crop), fps, depth,
    hdr, prim, space, trc, color_range, tier, interlaced, size, dur and notes;
    with audios (tracks) also audio and audio_why are added.
    The order of filters is that of the chain; each step of the quality number
    is limited before the next.
    """
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    out = items.withColumn("_ch", F.coalesce("crop_h", "h")).withColumn("_sw", F.coalesce("crop_w", "w"))
    out = out.withColumn("_large", N.is_large_source(c("w"), c("_sw"), c("_ch")))
    out = out.withColumn("_deblock", N.repair_strength(o.repair, c("tier"), c("_large")))
    out = out.withColumn("repair", c("tier").isin("low", "awful") | ((c("_ch") <= 576) & (c("tier") != "high")))
    # colour
    plain = ~c("hdr").isin("hdr10", "dv78", "hlg")
    usual = ["", "unknown", "bt709"]
    odd = plain & (~text("prim").isin(*usual) | ~text("space").isin(*usual))
    hlg = c("hdr") == "hlg"
    widened = plain & F.lit(o.to_hdr and o.tone_filter is not None)
    space = F.when(c("hdr").isin("hdr10", "dv78"), "hdr10").when(hlg, "hdr10" if o.hlg_filter else "hlg").when(widened, "hdr10").otherwise("sdr709")
    colour = F.when(widened, F.lit(o.tone_filter)).when(hlg, F.lit(o.hlg_filter)).when(odd & F.lit(o.normalizes), normalized_colour(c("space"), c("prim"), c("trc"), c("color_range"), c("h")))
    out = out.withColumn("out_space", space).withColumn("_colour", colour)
    deband = ~c("repair") & (F.lit(o.deband == "always") | (F.lit(o.deband == "auto") & (c("depth") < 10)))
    # size
    master = c("_large") & F.lit(o.target >= 2160)
    padded, reduced = master & (N.padded_height(c("_ch")) > 0), master & (c("_ch") > 2160)
    up, down = ~master & (c("_ch") < 1080), reduced | (~master & (c("_ch") > 1080))
    out = out.withColumn("large_master", master).withColumn("_padded", padded).withColumn("upscaled", up).withColumn("downscaled", down)
    resized = c("_padded") | c("upscaled") | c("downscaled")
    sharpened = ~resized & F.lit(o.sharpen > 0)
    steadied = c("upscaled") & ~c("_large") & F.lit(o.stabilise)
    cropped = c("crop_h").isNotNull()
    saturated = (c("_ch") <= SATURATED_LINES) & F.lit(o.saturation != 1.0)
    chain = [
        (c("interlaced"), F.lit(DEINTERLACE)), (cropped, F.format_string("crop=%d:%d:%d:%d", "crop_w", "crop_h", "crop_x", "crop_y")), (saturated, F.lit(f"eq=saturation={o.saturation:.3f}")),
        (c("depth") < 10, F.lit(TEN_BIT)), (c("_deblock").isNotNull(), N.lookup(DEBLOCK, c("_deblock"), None)), (c("repair"), F.lit(DENOISE)), (c("repair"), F.lit(REPAIR_DEBAND)), (c("_colour").isNotNull(), c("_colour")),
        (deband, F.lit(DEBAND)), (resized, F.when(c("large_master"), SCALE[2160]).otherwise(SCALE[1080])), (steadied, F.lit(STABILISE)), (sharpened, F.lit(f"cas=strength={o.sharpen:.2f}")), (F.lit(True), F.lit(OUTPUT)),
    ]
    some = lambda pairs: F.array_compact(F.array(*[F.when(test, value) for test, value in pairs]))
    out = out.withColumn("chain", some(chain))
    # quality
    flag = F.when(c("out_space").isin("hdr10", "hlg"), 1).otherwise(0)
    tiered = N.base_cq(c("tier"), c("depth"), c("out_space").isin("hdr10", "hlg"))
    cq = F.when(c("upscaled") & (c("_ch") < UPSCALE_LINES), _within(UPSCALE_CQ - flag)).when(c("upscaled") | ~c("repair"), tiered).otherwise(_within(REPAIR_CQ - flag))
    out = out.withColumn("_cq0", cq.cast("int"))
    out = out.withColumn("_cq1", _within(c("_cq0") + o.offset) if o.offset else c("_cq0"))
    step = N.boost_steps(o.boost_percent, c("h"), c("depth"))
    out = out.withColumn("_cq2", F.when(step != 0, _within(F.bround(c("_cq1") + step))).otherwise(c("_cq1")))
    small = c("upscaled") & (c("_ch") <= SMALL_LINES)
    out = out.withColumn("_cq3", F.when(small, _within(c("_cq2") + SMALL_TRIM, max(CQ_CEILING, SMALL_CEILING))).otherwise(c("_cq2")))
    height = F.when(c("large_master"), F.when(c("_padded") | c("downscaled"), 2160).otherwise(c("_ch"))).when(resized, 1080).otherwise(c("_ch"))
    out = out.withColumn("out_h", height.cast("int"))
    out = out.withColumn("out_w", (F.bround(c("_sw") * c("out_h").cast("double") / F.greatest(F.lit(1), c("_ch")) / 2.0) * 2).cast("int"))
    out = out.withColumn("_budget", F.when(c("large_master"), N.budget_mbps(c("size"), c("dur"), c("_deblock").isNull())).otherwise(0.0))
    pixels = c("out_w").cast("double") * c("out_h") * c("fps")
    out = out.withColumn("cq", F.when(c("large_master"), N.fitting_cq(c("_cq3"), pixels, c("_budget"))).otherwise(c("_cq3")).cast("int"))
    out = out.withColumn("maxrate_kbps", F.floor(c("_budget") * 1500).cast("int"))
    plain_gate = ~cropped & ~c("interlaced") & ~c("repair") & ~c("upscaled") & ~c("downscaled") & c("_colour").isNull() & (c("out_space") == "sdr709")
    out = out.withColumn("gate", plain_gate & F.lit(not o.to_hdr and o.measures))
    moved = lambda name, a, b: (c(a) != c(b), F.format_string(name, a, b))
    notes = [
        (c("interlaced"), F.lit("deinterlaced_bwdif_same_rate")), (saturated, F.lit(f"sd_saturation_{o.saturation:.2f}")), (c("depth") < 10, F.lit("filtered_at_10bit")), (c("_deblock").isNotNull(), F.format_string("uhd_deblock_%s_tier_%s", "_deblock", "tier")),
        (c("repair"), F.concat(F.lit("repair_chain_tier_"), "tier")), (hlg, F.lit("hlg_converted_to_pq" if o.hlg_filter else "hlg_kept_no_libplacebo")), (odd, F.lit("sdr_normalized_bt709" if o.normalizes else "sdr_odd_space_kept_no_zscale")), (widened, F.lit("sdr_expanded_to_hdr10_libplacebo")),
        (deband, F.lit("deband_applied")), (~c("repair") & ~deband & F.lit(o.deband == "auto"), F.lit("deband_skipped_source_already_10bit")), (c("_padded"), F.format_string("uhd_padded_%d_to_2160_lines", "_ch")), (c("large_master") & c("downscaled"), F.lit("uhd_downscaled_to_2160_lines")),
        (c("large_master") & ~resized, F.format_string("uhd_native_%dx%d", "_sw", "_ch")), (c("upscaled"), F.lit("upscaled_to_1080_lines")), (steadied, F.lit("upscale_temporal_stabiliser")), (~c("large_master") & c("downscaled"), F.lit("downscaled_to_1080_lines")), (sharpened, F.lit(f"cas_sharpen_{o.sharpen:.2f}")),
        (c("upscaled") & (c("_ch") >= UPSCALE_LINES), F.format_string("upscale_kept_tier_cq_%dp_source", "_ch")), moved(f"cq_offset_{o.offset:+d}_%d_to_%d", "_cq0", "_cq1"), moved(f"hq_source_boost_{o.boost_percent:.0f}pct_cq_%d_to_%d", "_cq1", "_cq2"),
        (c("_cq2") != c("_cq3"), F.format_string("lowres_%dp_cq_%d_to_%d", "_ch", "_cq2", "_cq3")), (c("large_master") & (c("_budget") <= 0), F.lit("uhd_budget_unavailable")), moved("uhd_budget_cq_%d_to_%d", "_cq3", "cq"),
    ]
    gain = min(max(o.hdr_saturation, 0.25), 1.30)
    if abs(gain - 1.0) > 0.001:
        notes.insert(8, (widened, F.lit(f"sdr_hdr_saturation_{gain:.2f}")))
    # the floor of quality is held even where the file grows beyond its budget, and that is said
    predicted = N.predicted_mbps(pixels, N.BPP_AT_27, c("cq"))
    gib = lambda rate: rate * 1e6 * c("dur") / 8 / float(1 << 30)
    notes.append((c("large_master") & (c("_budget") > 0) & (predicted > c("_budget")), F.format_string("uhd_over_budget_%.2fGB_target_%.2fGB_at_cq_%d", gib(predicted), gib(c("_budget")), "cq")))
    if "audios" in items.columns:
        picked = picked_audio(c("audios"))
        out = out.withColumn("audio", picked["track"]).withColumn("audio_why", picked["reason"])
        notes += [(c("audio").isNull(), F.lit("no_audio_stream")), (c("audio").isNotNull() & (c("audio_why") != "eng"), F.concat(F.lit("audio_pick_"), c("audio_why")))]
    out = out.withColumn("needs_dv_strip", c("hdr") == "dv78").withColumn("dv5", c("hdr") == "dv5")
    out = out.withColumn("notes", F.concat("notes", some(notes)))
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def ladder(start: Column, step: int = 2, tries: int = 3, floor: int = CQ_FLOOR) -> Column:
    """Values to try: start, start - step, ... not below the floor."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: start - i * step), lambda q: q >= floor)


def tile_ladder(tile: Column) -> Column:
    half = lambda d: F.greatest(F.lit(64), F.floor(tile / d).cast("int"))
    return F.array(tile, half(2), half(4), F.lit(0))


def tile_for(budget_mb: Column, cost: Column, frame: Column) -> Column:
    """Tile edge that a memory budget allows: a multiple of 32 from 64 to the frame or 896."""
    edge = F.floor(400 * F.sqrt(budget_mb / cost) / 32) * 32
    return F.greatest(F.lit(64), F.least(edge, frame, F.lit(896))).cast("int")


def upscale_factor(height: Column, factors: list[int], target: int = 1080) -> Column:
    """The smallest factor that reaches the target, else the largest."""
    case = F.lit(None).cast("int")
    for f in sorted(factors, reverse=True):
        case = F.when(height * f >= target, f).otherwise(case)
    return F.coalesce(case, F.lit(max(factors)))


def first_success(attempts: DataFrame, by: list[str], rank: str, ok: Column) -> DataFrame:
    """The first attempt of each group that succeeded."""
    return attempts.where(ok).groupBy(*by).agg(F.min_by(F.struct(*[c for c in attempts.columns if c not in by]), rank).alias("a")).select(*by, "a.*")
