"""Subtitle cues: parsing, clamping, rendering, usefulness, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cue_seconds, cue_time

TIMING = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)"


def parsed(files: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, pos, timing, start, stop, body of every block with a timing on its first or second line and text after it."""
    blocks = files.select(*by, F.posexplode(F.split(F.col(text), r"\r?\n[ \t]*\r?\n")).alias("pos", "block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: F.trim(x) != "")
    blocks = blocks.select(*by, "pos", lines.alias("lines")).where(F.size("lines") >= 2)
    at = F.when(F.get("lines", F.lit(1)).contains("-->"), 2).when(F.get("lines", F.lit(0)).contains("-->"), 1)
    blocks = blocks.withColumn("_at", at).where("_at is not null")
    timing = F.get("lines", F.col("_at") - 1)
    return blocks.select(*by, "pos", timing.alias("timing"), cue_seconds(F.regexp_extract(timing, TIMING, 1)).alias("start"), cue_seconds(F.regexp_extract(timing, TIMING, 2)).alias("stop"), F.slice("lines", F.col("_at") + 1, F.size("lines")).alias("body"))


def clamped(cues: DataFrame, duration: Column) -> DataFrame:
    """Cues that begin in time, cut at the duration; unreadable timings and unknown durations are left alone."""
    known = duration > 0
    kept = cues.where(~known | F.col("start").isNull() | (F.col("start") < duration))
    return kept.withColumn("trimmed", F.coalesce(known & (F.col("stop") > duration), F.lit(False))).withColumn("stop", F.when(F.col("trimmed"), duration).otherwise(F.col("stop")))


def useful(cues: DataFrame, by: list[str], least: int = 20, characters: int = 200) -> DataFrame:
    """Groups with enough cues and text."""
    size = F.sum(F.char_length(F.array_join("body", "\n")))
    return cues.groupBy(*by).agg(F.count("*").alias("cues"), size.alias("characters")).where((F.col("cues") >= least) & (F.col("characters") > characters))


def rendered(cues: DataFrame, by: list[str]) -> DataFrame:
    """One text for each group, its cues numbered from 1."""
    items = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("\n", F.concat(cue_time(F.col("start")), F.lit(" --> "), cue_time(F.col("stop"))), F.array_join("body", "\n")).alias("t"))))
    return cues.groupBy(*by).agg(items.alias("i")).select(*by, F.array_join(F.transform("i", lambda x, k: F.concat((k + 1).cast("string"), F.lit("\n"), x["t"])), "\n\n").alias("text"))


def batches(cues: DataFrame, by: list[str], position: str, size: int = 80) -> DataFrame:
    return cues.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def numbered_reply(text: Column) -> Column:
    """array<struct(number, text)> of lines `3. text`."""
    pattern = r"^\s*(\d+)[\t.)]\s*(.*)"
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).try_cast("int").alias("number"), F.regexp_extract(x, pattern, 2).alias("text")))


def translated(source: DataFrame, replies: DataFrame, by: list[str], number: str, least: float = 0.5) -> DataFrame:
    """Source lines with their replies; a group of which less than the share (or nothing) was answered stays as it is."""
    both = source.join(replies.select(*by, number, F.col("text").alias("_reply")), [*by, number], "left")
    share = both.groupBy(*by).agg(F.avg(F.when(F.coalesce("_reply", F.lit("")) != "", 1.0).otherwise(0.0)).alias("_share"))
    ok = (F.col("_share") > 0) & (F.col("_share") >= least) & (F.coalesce("_reply", F.lit("")) != "")
    return both.join(share, by).withColumn("translated", ok).withColumn("text", F.when(ok, F.col("_reply")).otherwise(F.col("text"))).drop("_reply", "_share")


def tag_decision(tag: Column, sniffed: Column, bitmap: Column) -> Column:
    """The language to use: content beats the tag where it contradicts it; bitmaps and unknown content leave the tag."""
    low = F.lower(F.coalesce(tag, F.lit("und")))
    english, japanese = low.isin("eng", "en"), low.isin("jpn", "ja", "jp")
    case = F.when(bitmap | F.coalesce(sniffed, F.lit("unknown")).isin("unknown", "unreadable"), tag)
    return case.when(sniffed == "latin", F.when(japanese, "eng").otherwise(tag)).when((sniffed == "jpn") & ~japanese, "jpn").when((sniffed != "jpn") & english, sniffed).otherwise(tag)


def spoken_text(text: Column) -> Column:
    """The lines of a subtitle text that are neither numbers nor timings, as one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~F.contains(x, F.lit("-->"))), " ")
