"""Numeric rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CODEC_FACTOR = {"h264": 1.0, "hevc": 1.35, "vp9": 1.25, "mpeg2video": 0.45, "mpeg4": 0.6, "msmpeg4v3": 0.55, "msmpeg4v2": 0.5, "vc1": 0.8, "wmv3": 0.7, "wmv2": 0.5, "vp8": 0.8, "mpeg1video": 0.4, "theora": 0.6, "h263": 0.4, "flv1": 0.45}
OTHER_CODEC_FACTOR = 0.8
TIERS = [(0.090, "high"), (0.045, "mid"), (0.022, "low")]
BASE_CQ = {"high": 21, "mid": 23, "low": 26, "awful": 28}
CQ_FLOOR, CQ_CEILING = 10, 30
LOSSLESS = ["truehd", "mlp", "dts_hd", "dtshd", "flac", "alac", "pcm_s16le", "pcm_s24le", "pcm_s16be", "pcm_s24be", "pcm_bluray", "pcm_dvd"]
LOSSLESS_TIER = {"truehd": 3, "mlp": 3, "pcm_bluray": 2, "flac": 2, "dts": 1}
INTERLACED_HEIGHTS = [480, 486, 540, 576, 1080]
NO_HASH_DISTANCE = 64
BUDGET_BYTES, OVERHEAD_MBPS, BPP_AT_27, LARGE_CEILING = 10.0 * 1024**3, 2.5, 0.1157, 32


def lookup(values: dict, key: Column, default) -> Column:
    """A small constant table as a map literal; without a default, null for other keys."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def first_of(value: Column, pairs: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first limit that the value reaches."""
    case = None
    for limit, name in pairs:
        case = (F.when if case is None else case.when)(value >= limit, name)
    return case.otherwise(otherwise)


def ratio(text: Column, default: float = 0.0) -> Column:
    """`a/b` or a number as a double, else the default."""
    parts = F.split(text, "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 2, F.try_divide(number(0), F.nullif(number(1), F.lit(0.0)))).otherwise(number(0)), F.lit(default))


def truthy(text: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("", "0", "no", "off", "false")


def clamped(text: Column, low: float, high: float, default: float) -> Column:
    """A setting as a number within limits; the default if it can't be read."""
    number = text.try_cast("double")
    return F.when(number.isNull(), default).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def bits_per_pixel(bitrate: Column, pixels: Column) -> Column:
    return bitrate / F.greatest(F.lit(1.0), pixels)


def quality_tier(quality: Column) -> Column:
    return first_of(quality, TIERS, "awful")


def base_cq(tier: Column, depth: Column, hdr: Column) -> Column:
    base = lookup(BASE_CQ, tier, BASE_CQ["awful"]) - F.when(depth >= 10, 1).otherwise(0) - F.when(hdr, 1).otherwise(0)
    return F.greatest(F.lit(CQ_FLOOR), F.least(F.lit(CQ_CEILING), base))


def boost_steps(percent: float, height: Column, depth: Column) -> Column:
    """CQ steps for a large source: six double the rate."""
    return F.when((F.lit(percent) > 0) & (height >= 2000) & (depth >= 10), -6.0 * F.log2(F.lit(1 + percent / 100))).otherwise(0.0)


def predicted_mbps(pixels: Column, bpp_at_27: float, cq: Column) -> Column:
    return F.lit(bpp_at_27) * pixels * F.pow(F.lit(2.0), (27 - cq) / 4.5) / 1e6


def budget_mbps(size: Column, duration: Column, match_source: Column | None = None, cap: float = BUDGET_BYTES) -> Column:
    """Rate that a file may use: the smaller of source and cap over its duration, less the overhead; 0 if the duration is unknown."""
    source = F.nullif(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0))
    if match_source is not None:
        source = F.when(match_source, source)
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.5), F.least(F.coalesce(source, F.lit(cap)), F.lit(cap)) * 8 / duration / 1e6 - OVERHEAD_MBPS))


def fitting_cq(start: Column, pixels: Column, budget: Column, bpp: float = BPP_AT_27, most: int = LARGE_CEILING) -> Column:
    """The least cq from start on that fits the budget, or the most; the start itself if there is no budget or it is above."""
    fits = F.get(F.filter(F.sequence(start, F.greatest(start, F.lit(most))), lambda c: predicted_mbps(pixels, bpp, c) <= budget), F.lit(0))
    return F.when((budget <= 0) | (start >= most), start).otherwise(F.coalesce(fits, F.lit(most)))


def interlace_decision(order: Column, combed: Column, determined: Column, height: Column) -> Column:
    """struct(interlaced, note) of a flagged field order against measured combing."""
    share = F.coalesce(F.try_divide(combed.cast("double"), determined.cast("double")), F.lit(0.0))
    flagged = F.coalesce(order, F.lit("")).isin("tt", "bb", "tb", "bt")
    progressive = F.coalesce(order, F.lit("")) == "progressive"
    high = share > 0.30
    yes = F.when(flagged, share > 0.10).when(progressive, False).otherwise((share > 0.45) & (combed >= 50) & height.isin(*INTERLACED_HEIGHTS))
    note = F.when(flagged & (share <= 0.10), "flagged interlaced, measured progressive").when(progressive & high, "flagged progressive, measured combing").when(~flagged & ~progressive & ~yes & high, "combing measured, not trusted")
    return F.struct(yes.alias("interlaced"), note.alias("note"))


def is_large_source(width: Column, crop_width: Column, crop_height: Column) -> Column:
    return (width >= 3000) & (crop_width * crop_height >= 5_500_000)


def padded_height(height: Column) -> Column:
    """2160 for a height within a tenth below it, else 0."""
    return F.when((height >= 1944) & (height < 2160), 2160).otherwise(0)


def repair_strength(mode: str, tier: Column, large: Column) -> Column:
    """Filter strength for large sources: by tier (`auto`), forced (`weak`, `strong`), or none (`off`)."""
    by_tier = F.when(tier == "awful", "strong").when(tier == "low", "weak") if mode == "auto" else F.lit(None if mode == "off" else mode).cast("string")
    return F.when(large, by_tier)


def is_lossless(codec: Column, bitrate: Column) -> Column:
    codec = F.lower(F.coalesce(codec, F.lit("")))
    return codec.isin(*LOSSLESS) | ((codec == "dts") & (F.coalesce(bitrate, F.lit(0)) > 1_500_000))


def audio_rank(codec: Column, channels: Column, bitrate: Column) -> Column:
    """struct ordered from worst to best: lossless, codec tier, channels, bitrate."""
    lossless = is_lossless(codec, bitrate)
    tier = F.when(lossless, lookup(LOSSLESS_TIER, F.lower(codec), 0)).otherwise(0)
    return F.struct(lossless.cast("int").alias("lossless"), tier.alias("tier"), F.coalesce(channels, F.lit(0)).alias("channels"), F.coalesce(bitrate, F.lit(0)).cast("long").alias("bitrate"))


def rates_agree(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= tolerance)


def durations_agree(out: Column, video: Column, container: Column, tolerance: float = 1.0) -> Column:
    return F.abs(out - F.coalesce(F.nullif(video, F.lit(0.0)), container)) <= tolerance


def runtime_agrees(seconds: Column, minutes: Column) -> Column:
    """struct(ok, note) of a measured against a listed runtime; speed-ups of 4 % are told apart first."""
    r = F.try_divide(seconds.cast("double"), minutes.cast("double") * 60)
    near = lambda x, t: F.abs(r - x) <= t
    percent = F.abs((r - 1) * 100).cast("int")
    unknown = r.isNull() | (seconds <= 0) | (minutes <= 0)
    ok = F.when(unknown, True).otherwise(near(1.0, 0.06))
    note = F.when(unknown, "runtime_unknown").when(near(0.96, 0.015), "runtime_pal_speedup").when(near(1.0417, 0.015), "runtime_pal_slowdown").when(near(1.0, 0.06), "runtime_match").otherwise(F.concat(F.lit("runtime_off_by_"), percent.cast("string"), F.lit("_pct")))
    return F.struct(ok.alias("ok"), note.alias("note"))


def difference_hash(values: Column, width: int, height: int) -> Column:
    """Row-major bits `left > right` of a width x height grid, first bit highest; null if values are missing."""
    places = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])
    bits = F.transform(places, lambda i: F.when(F.get(values, i) > F.get(values, i + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(values) >= width * height, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(NO_HASH_DISTANCE))


def verdict(distance: Column, references: Column, limit: int = 12) -> Column:
    return F.when(references == 0, "no_reference_images").when(distance <= limit, "confirmed").otherwise("unverified")
