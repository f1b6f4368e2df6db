"""Settings: numbers within limits, choices from lists, and what became of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import truthy

# Key, kind, least, most, default.
NUMBERS = [
    ("scratch_min_free_gb", "int", 5, 2000, 50),
    ("sr_scale", "int", 0, 4, 0),
    ("sr_tile", "int", 0, 4096, 0),
    ("sr_tile_max", "int", 64, 4096, 896),
    ("gpu_max_pct", "int", 50, 99, 98),
    ("gpu_settle_sec", "int", 0, 120, 5),
    ("gpu_wait_sec", "int", 0, 3600, 300),
    ("gpu_temp_max_c", "int", 0, 95, 80),
    ("gpu_cool_sec", "int", 1, 300, 15),
    ("sr_vram_mb", "int", 512, 65536, 15000),
    ("sr_vram_reserve_mb", "int", 0, 16384, 3400),
    ("sr_strength", "int", 0, 100, 50),
    ("cas_strength", "float", 0.0, 1.0, 0.30),
    ("sr_chunk_pause_sec", "float", 0.0, 60.0, 0.0),
    ("sdr_to_hdr_saturation", "float", 0.25, 1.30, 1.0),
    ("sd_saturation", "float", 0.5, 2.0, 1.06),
    ("whisper_queue", "int", 0, 60, 20),
    ("audio_conform_step", "float", 10.0, 600.0, 60.0),
    ("cq_offset", "int", -8, 8, 0),
    ("duration_tolerance_sec", "float", 0.1, 60.0, 1.0),
    ("upscale_cq_max_h", "int", 0, 1080, 720),
    ("lowres_trim_h", "int", 0, 1080, 576),
    ("lowres_cq_trim", "int", 0, 20, 8),
    ("lowres_cq_ceil", "int", 20, 50, 36),
    ("uhd_min_width", "int", 1280, 8192, 3000),
    ("uhd_min_pixels", "int", 1000000, 40000000, 5500000),
    ("uhd_pad_band_pct", "int", 0, 50, 10),
    ("uhd_cq_ceil", "int", 16, 50, 32),
    ("uhd_max_gb", "float", 1.0, 200.0, 10.0),
    ("uhd_overhead_mbps", "float", 0.0, 20.0, 2.5),
    ("uhd_bpp_ref", "float", 0.0, 1.0, 0.1157),
    ("cpu_max_pct", "int", 0, 100, 80),
    ("min_free_gb", "float", 0.0, 1e9, 20.0),
    ("audio_opus_per_ch", "int", 48, 256, 128),
    ("hq_source_boost_pct", "float", 0.0, 200.0, 30.0),
    ("audio_mix_centre", "float", 0.5, 2.0, 1.25),
    ("audio_mix_enhance", "float", 0.0, 3.0, 0.6),
    ("svtav1_preset", "int", 0, 13, 6),
    ("upscale_cq", "int", 10, 30, 28),
]
#: Key, what it may be; the first is the default.
CHOICES = [
    ("encoder", ["auto", "nvenc", "svtav1"]),
    ("sr_backend", ["auto", "cuda", "ncnn", "off"]),
    ("audio_mode", ["auto", "copy", "opus", "aac"]),
    ("translate_provider", ["deepl", "openai", "argos"]),
    ("artifact_repair", ["auto", "off", "weak", "strong"]),
    ("deband_mode", ["auto", "always", "off"]),
    ("hwaccel", ["auto", "cuda", "none"]),
    ("sr_model", ["realesr-general-x4v3", "realesr-animevideov3", "realesrgan-x4plus-anime"]),
]
#: Tiers of quality, and those that are repaired unless others are named.
TIERS, REPAIRED = ["high", "mid", "low", "awful"], ["low", "awful"]
#: Shares of a machine stay at or below a ceiling, whatever is asked for.
CEILED, CEILING = ["gpu_max_pct", "cpu_max_pct"], 98
INTEGER, DECIMAL = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def numbers(rows: DataFrame, by: list[str], given: Column) -> DataFrame:
    """by, key, value, outcome of every number among the settings: `default` (not given), `set`, `limited`, `unreadable` (the default stays).

    `given` maps keys to texts; infinite values are unreadable.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(float(default)).alias("default")) for k, kind, low, high, default in NUMBERS])
    each = rows.select(*by, given.alias("_given"), F.inline(rules)).withColumn("_text", F.col("_given")[F.col("key")])
    shape = F.when(F.col("kind") == "int", F.rlike("_text", F.lit(INTEGER))).otherwise(F.rlike("_text", F.lit(DECIMAL)))
    number = F.when(shape, F.trim(F.col("_text")).try_cast("double"))
    most = F.when(F.col("key").isin(*CEILED), F.least("high", F.lit(float(CEILING)))).otherwise(F.col("high"))
    value = F.when(number.isNull(), F.col("default")).otherwise(F.least(F.greatest(number, "low"), most))
    outcome = F.when(F.col("_text").isNull(), "default").when(number.isNull(), "unreadable").when(number == value, "set").otherwise("limited")
    return each.select(*by, "key", value.alias("value"), outcome.alias("outcome"))


def choices(rows: DataFrame, by: list[str], given: Column) -> DataFrame:
    """by, key, value, outcome (`default`, `set`, `unknown`) of every choice; case and outer spaces don't count."""
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, allowed)).alias("allowed")) for k, allowed in CHOICES])
    each = rows.select(*by, given.alias("_given"), F.inline(rules)).withColumn("_text", F.lower(F.trim(F.col("_given")[F.col("key")])))
    fits = F.array_contains("allowed", F.col("_text"))
    outcome = F.when(F.coalesce("_text", F.lit("")) == "", "default").when(fits, "set").otherwise("unknown")
    return each.select(*by, "key", F.when(fits, F.col("_text")).otherwise(F.get("allowed", F.lit(0))).alias("value"), outcome.alias("outcome"))


def target_height(text: Column, default: int = 1080) -> Column:
    """1080 or 2160 from the digits of a text, else the default."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.coalesce(F.when(digits.isin("1080", "2160"), digits.cast("int")), F.lit(default))


def name_list(text: Column) -> Column:
    """Lower-cased names of a comma-separated text, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def repaired_tiers(text: Column) -> Column:
    """The known tiers of a comma-separated text, as they are written there; the default, if there is none."""
    named = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.isin(*TIERS))
    return F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, REPAIRED)))


def tile_threads(text: Column, default: str = "4:4:4") -> Column:
    """A text of the form `load:process:save`, else the default."""
    return F.coalesce(F.when(F.rlike(F.trim(text), F.lit(r"^[0-9]+:[0-9]+:[0-9]+$")), F.trim(text)), F.lit(default))


def stall_seconds(text: Column, default: int = 420) -> Column:
    """Whole seconds, cut off, at least 0; the default if it isn't a number."""
    number = F.when(F.rlike(text, F.lit(DECIMAL)), F.trim(text).try_cast("double"))
    return F.when(number.isNull(), default).otherwise(F.greatest(number.cast("long"), F.lit(0)))


def switches(given: Column, names: list[str]) -> Column:
    """map of the named switches that are given, as booleans."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.when(given[n].isNotNull(), truthy(given[n])).alias("value")) for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
