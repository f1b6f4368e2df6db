"""Sessions, tables, file listings, settings files and probe records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import clock_seconds
from ..operators.tracks import stream_bitrate

PROBE = """streams array<struct<index int, codec_type string, codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string, bit_rate string, bits_per_raw_sample string, pix_fmt string, color_transfer string, color_primaries string, color_space string, color_range string, field_order string, start_time string, side_data_list array<struct<side_data_type string, dv_profile int>>, channels int, channel_layout string, duration string, nb_frames string, tags map<string, string>, disposition map<string, int>>>, format struct<duration string, size string, bit_rate string, tags map<string, string>>"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of all files under a root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")


def outputs(files: DataFrame, suffix: str = "mkv") -> DataFrame:
    """Finished files: of the suffix, not temporary, not under `failed`."""
    return files.where(F.col("path").endswith(f".{suffix}") & ~F.contains("path", F.lit(".tmp")) & ~F.array_contains(F.split("path", "/"), F.lit("failed")))


def settings(lines: DataFrame, by: list[str], line: str = "value", number: str = "number") -> DataFrame:
    """key, value of `key = value` lines; comments are cut off, keys lower-cased, the last of repeated keys counts."""
    text = F.trim(F.get(F.split(F.col(line), "#"), F.lit(0)))
    rows = lines.where(text.contains("=")).select(*by, number, F.lower(F.trim(F.substring_index(text, "=", 1))).alias("key"), F.trim(F.regexp_extract(text, "=(.*)$", 1)).alias("value"))
    return rows.groupBy(*by, "key").agg(F.max_by("value", number).alias("value"))


def probed(records: DataFrame, json: str = "json") -> DataFrame:
    """Probe JSON as columns: picture, rates with their fallbacks, audio and subtitle arrays; unusable records are left out."""
    p = records.withColumn("p", F.from_json(F.col(json), PROBE))
    video = F.get(F.filter("p.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    p = p.withColumn("v", video).where("v is not null")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    positive = lambda c: F.nullif(c, F.lit(0.0))
    duration = F.coalesce(positive(number("p.format.duration")), positive(number("v.duration")))
    rate = lambda c: F.when((ratio(F.col(c)) > 0) & (ratio(F.col(c)) <= 1000), ratio(F.col(c)))
    size, own, whole = number("p.format.size"), positive(number("v.bit_rate")), positive(number("p.format.bit_rate"))
    depth = F.coalesce(F.col("v.bits_per_raw_sample").try_cast("int"), F.when(F.contains("v.pix_fmt", F.lit("10")), 10).when(F.contains("v.pix_fmt", F.lit("12")), 12).otherwise(8))
    dovi = F.element_at(F.filter("v.side_data_list", lambda d: F.contains(F.coalesce(d["side_data_type"], F.lit("")), F.lit("DOVI"))), -1)["dv_profile"]
    trc = F.lower(F.coalesce("v.color_transfer", F.lit("")))
    hdr = F.when(dovi == 5, "dv5").when(dovi.isNotNull(), "dv78").when(trc == "smpte2084", "hdr10").when(trc == "arib-std-b67", "hlg").otherwise("sdr")
    of = lambda kind: F.filter("p.streams", lambda s: s["codec_type"] == kind)
    lang = lambda s: F.lower(F.coalesce(F.nullif(s["tags"]["language"], F.lit("")), F.lit("und"))).alias("lang")
    flag = lambda s, name: F.coalesce(s["disposition"][name], F.lit(0)) != 0
    start = lambda s: F.coalesce(s["start_time"].try_cast("double"), F.lit(0.0)).alias("start")
    aux = lambda s: (flag(s, "comment") | flag(s, "visual_impaired") | flag(s, "descriptions") | flag(s, "karaoke")).alias("aux")
    bits = lambda s: stream_bitrate(s["bit_rate"].try_cast("long"), F.coalesce(s["tags"], F.create_map().cast("map<string,string>"))).alias("bit_rate")
    audio = F.transform(of("audio"), lambda s: F.struct(s["index"].alias("idx"), lang(s), F.coalesce(F.nullif(s["channels"], F.lit(0)), F.lit(2)).alias("ch"), s["channel_layout"].alias("layout"), s["codec_name"].alias("codec"), bits(s), start(s), s["tags"]["title"].alias("title"), aux(s)))
    subs = F.transform(of("subtitle"), lambda s: F.struct(s["index"].alias("idx"), lang(s), s["codec_name"].alias("codec"), (F.coalesce(s["disposition"]["forced"], F.lit(0)) == 1).alias("forced"), (F.coalesce(s["disposition"]["hearing_impaired"], F.lit(0)) == 1).alias("sdh"), F.trim(s["tags"]["title"]).alias("title")))
    rates = {n: F.coalesce(ratio(F.col(f"v.{c}")), F.lit(0.0)).alias(n) for n, c in (("rr", "r_frame_rate"), ("ar", "avg_frame_rate"))}
    low = lambda c: F.lower(F.coalesce(f"v.{c}", F.lit("")))
    out = p.withColumn("dur", duration).where("dur > 0")
    return out.select(
        *records.columns, "dur", F.col("v.codec_name").alias("vcodec"), F.col("v.width").alias("w"), F.col("v.height").alias("h"), F.coalesce(rate("v.avg_frame_rate"), rate("v.r_frame_rate"), F.lit(24.0)).alias("fps"),
        F.coalesce(own, 0.85 * whole, 0.85 * size * 8 / F.col("dur")).alias("vbr"), F.when(own.isNotNull(), "stream").when(whole.isNotNull(), "container").otherwise("size").alias("vbr_basis"),
        depth.alias("depth"), hdr.alias("hdr"), F.coalesce("v.field_order", F.lit("")).alias("field_order"), audio.alias("audios"), subs.alias("subs"), census(F.col("p.streams")).alias("census"),
        F.col("p.format.size").try_cast("long").alias("bytes"), F.col("p.format.tags").alias("tags"), F.col("v.index").alias("vidx"), F.coalesce(F.when(rate("v.r_frame_rate").isNotNull(), F.col("v.r_frame_rate")), F.format_string("%.6f", F.coalesce(rate("v.avg_frame_rate"), F.lit(24.0)))).alias("fps_str"), *rates.values(),
        F.coalesce("v.pix_fmt", F.lit("")).alias("pix"), trc.alias("trc"), low("color_primaries").alias("prim"), low("color_space").alias("space"), low("color_range").alias("range"), dovi.alias("dovi"), F.size(of("attachment")).alias("atts"),
    )


def audio_durations(record: Column) -> Column:
    """Durations of the audio tracks of a probe record (JSON), in their order; 0 where neither field nor tag has one."""
    found = F.filter(census(F.from_json(record, PROBE)["streams"]), lambda s: s["kind"] == "audio")
    return F.coalesce(F.transform(found, lambda s: s["dur"]), F.array().cast("array<double>"))


def duration_of(record: Column) -> Column:
    """The container's duration of a probe record, 0 if it can't be read."""
    return F.coalesce(F.get_json_object(record, "$.format.duration").try_cast("double"), F.lit(0.0))


def census(streams: Column) -> Column:
    """array<struct(kind, idx, codec, ch, dur)> of video and audio tracks; dur is the larger of field and tag."""
    both = F.filter(streams, lambda s: s["codec_type"].isin("video", "audio"))
    tag = lambda s: clock_seconds(F.transform_keys(F.coalesce(s["tags"], F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))["duration"])
    return F.transform(both, lambda s: F.struct(s["codec_type"].alias("kind"), s["index"].alias("idx"), s["codec_name"].alias("codec"), s["channels"].alias("ch"), F.greatest(F.coalesce(s["duration"].try_cast("double"), F.lit(0.0)), tag(s)).alias("dur")))


def video_duration(stream: Column, tag: Column, frames: Column, fps: Column, last_packet: Column, container: Column) -> Column:
    """The first known duration: stream, tag, frames over rate, last packet, container."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return F.coalesce(some(stream), some(clock_seconds(tag)), some(F.try_divide(frames.cast("double"), F.nullif(fps, F.lit(0.0)))), some(last_packet), some(container), F.lit(0.0))


def last_packet(packets: DataFrame, by: list[str], duration: str) -> DataFrame:
    """End of the last packet of each group, read from the last two minutes of long ones; and packet counts."""
    near = (F.col(duration) <= 180) | (F.col("pts") >= F.col(duration) - 120)
    return packets.groupBy(*by).agg(F.count("*").alias("packets"), F.max(F.when(near & (F.col("pts") > 0), F.col("pts") + F.coalesce("length", F.lit(0.0)))).alias("last_end"))


#: Seconds of a folder of stored packets; the last stretch of a long file that is read, and up to where a file is short.
PACKET_SECONDS, LAST_SECONDS, SHORT_SECONDS = 600, 120, 180


def store_packets(packets: DataFrame, path: str) -> None:
    """Write packets in folders by time, within which they are sorted by file."""
    dealt = packets.withColumn("bucket", F.floor(F.greatest(F.coalesce("pts", F.lit(0.0)), F.lit(0.0)) / PACKET_SECONDS).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "pts").write.partitionBy("bucket").parquet(path)


def last_packet_stored(packets: DataFrame, durations: DataFrame, by: list[str], duration: str) -> DataFrame:
    """by, last_end: the end of the last packet of each file, from packets that `store_packets` wrote.

    A file asks for the folders of its last two minutes, a short one for all
    that it has; what is asked for prunes the folders before any is opened.
    """
    long = F.col(duration) > SHORT_SECONDS
    first = F.when(long, F.floor((F.col(duration) - LAST_SECONDS) / PACKET_SECONDS)).otherwise(0)
    asked = durations.where(F.col(duration) > 0).withColumn("bucket", F.explode(F.sequence(first.cast("int"), (F.floor(F.col(duration) / PACKET_SECONDS) + 1).cast("int"))))
    near = ~long | (F.col("pts") >= F.col(duration) - LAST_SECONDS)
    met = packets.join(asked, [*by, "bucket"]).where(near & (F.col("pts") > 0))
    return met.groupBy(*by).agg(F.max(F.col("pts") + F.coalesce("length", F.lit(0.0))).alias("last_end"))


def last_match(text: Column, pattern: str) -> Column:
    """The last match of a pattern in a tool's output."""
    return F.element_at(F.nullif(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")), -1)


def sample_row(line: Column, names: list[str]) -> Column:
    """Numbers of a comma-separated row by name; unreadable ones are left out."""
    cells = F.split(line, r"\s*,\s*")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.get(cells, F.lit(i)).try_cast("double").alias("value")) for i, n in enumerate(names)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def readable(lines: DataFrame, schema: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of JSON lines as columns beside the others, the lines that can't be read)."""
    kept = [c for c in lines.columns if c != text]
    read = lines.withColumn("_r", F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return read.where(~bad).select(*kept, "_r.*").drop("_corrupt"), read.where(bad).select(*kept, text)


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern in a tool's output."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
