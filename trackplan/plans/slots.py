"""Queries over track slots and other rules, every branch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import settings
from ..functions import text as X
from ..operators import align, planning, queue, series, tracks
from ..sources import sinks, tables
from ..sources.tables import table
from ..streaming import watch
from .catalog import query, seconds, sql_map
from .sequences import _E, _L, _events, _lines, _order
from .texts import _RANKED, _audio


def _best_sql(language: str) -> str:
    return f"""(SELECT l_orderkey, pos, ch FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY lossless DESC, tier DESC, ch DESC, rate DESC, pos) AS k FROM (
      SELECT *, CASE WHEN lossless THEN {sql_map({0: 3, 1: 1, 3: 2}, 'codec', 0)} ELSE 0 END AS tier, max(ch) OVER (PARTITION BY l_orderkey) AS widest FROM {_RANKED} WHERE language = '{language}') WHERE widest <= 2 OR ch > 2) WHERE k = 1)"""


_SLOTS = f"""
WITH n AS (SELECT l_orderkey, count(*) AS n, any_value(language) AS one, min(pos) FILTER (language = 'jpn') AS jpn, min_by(ch, pos) AS ch0, min_by(language, pos) AS lang0 FROM {_RANKED} GROUP BY l_orderkey),
b AS (SELECT n.l_orderkey, n = 1 AND e.pos IS NULL AND j.pos IS NULL AS lone, lang0, coalesce(e.pos, CASE WHEN n = 1 AND j.pos IS NULL THEN 0 END) AS e, coalesce(e.ch, CASE WHEN n = 1 AND j.pos IS NULL THEN ch0 END) AS ech, j.pos AS j, j.ch AS jch, ch0
  FROM n LEFT JOIN {_best_sql('eng')} e ON e.l_orderkey = n.l_orderkey LEFT JOIN {_best_sql('jpn')} j ON j.l_orderkey = n.l_orderkey)
SELECT l_orderkey, CASE WHEN e IS NOT NULL THEN
    'boosted:' || e || ':eng:true:' || CASE WHEN ech > 4 THEN 'true:English stereo' WHEN ech > 2 THEN 'false:English stereo downmix (dialogue boosted)' ELSE 'false:English stereo (dialogue boosted)' END || ';original:' || e || ':eng:false:false:English original ' || ech || 'ch'
      || CASE WHEN j IS NOT NULL THEN ';japanese:' || j || ':jpn:false:false:Japanese ' || jch || 'ch' ELSE '' END
    WHEN j IS NOT NULL THEN 'foreign:' || j || ':jpn:false:false:Japanese ' || jch || 'ch' ELSE 'foreign:0:' || lang0 || ':false:false:Original ' || ch0 || 'ch' END AS slots,
  concat_ws(';', CASE WHEN lone THEN 'single_audio_track_kept_lang_' || lang0 END, CASE WHEN e IS NULL THEN 'audio_foreign_primary_unboosted_' || CASE WHEN j IS NOT NULL THEN 'jpn' ELSE lang0 END END) AS notes FROM b"""


@query(_SLOTS)
def slot_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Audio slots with titles, stereo flags and notes; layouts of more than four channels have no mix."""
    planned = tracks.planned_audio(F.col("tracks"), lambda t: t["ch"] <= 4)
    rows = _audio(spark, folder).select("l_orderkey", planned.alias("p"))
    slot = lambda s: F.concat_ws(":", s["kind"], s["idx"].cast("string"), s["lang"], s["stereo"].cast("string"), s["native_stereo"].cast("string"), s["title"])
    return rows.select("l_orderkey", F.array_join(F.transform("p.slots", slot), ";").alias("slots"), F.array_join("p.notes", ";").alias("notes"))


_SUBS = f"""(SELECT l_orderkey, pos, {sql_map({0: 'eng', 1: 'jpn', 2: 'fre', 3: 'eng'}, 'l_partkey % 4', 'eng')} AS lang, l_returnflag = 'R' AS forced, l_returnflag = 'A' AS sdh FROM {_L})"""
_USABLE = f"""(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE lang WHEN 'eng' THEN 0 WHEN 'jpn' THEN 1 ELSE 2 END, CASE WHEN sdh THEN 2 WHEN forced THEN 1 ELSE 0 END, pos) AS k FROM {_SUBS} WHERE pos <> 2 AND (l_orderkey % 5 <> 0 OR lang IN ('eng', 'jpn')))"""


@query(f"""
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem),
f AS (SELECT o.l_orderkey, arg_min(pos, k) FILTER (lang = 'eng' AND forced) AS forced, arg_min(pos, k) FILTER (lang = 'eng' AND NOT forced) AS english, arg_min(pos, k) FILTER (lang = 'jpn') AS japanese, list(pos ORDER BY k) FILTER (pos IS NOT NULL) AS every FROM o LEFT JOIN {_USABLE} u ON u.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey),
e AS (SELECT l_orderkey, CAST(forced AS VARCHAR) AS forced, coalesce(CAST(english AS VARCHAR), CASE WHEN l_orderkey % 3 = 0 THEN 'generated eng' END) AS english, coalesce(CAST(japanese AS VARCHAR), CASE WHEN l_orderkey % 3 < 2 THEN 'generated jpn' END) AS japanese, every FROM f),
s AS (SELECT *, forced IS NULL AND l_orderkey % 2 = 1 AND english IS NOT NULL AS leads FROM e),
t AS (SELECT l_orderkey, every, coalesce(forced, CASE WHEN leads THEN english END, 'blank') AS slot1, CASE WHEN NOT leads THEN english END AS slot2, japanese AS slot3 FROM s)
SELECT l_orderkey, slot1, slot2, slot3, coalesce(array_to_string(list_filter(list_transform(every, lambda i: CAST(i AS VARCHAR)), lambda i: i IS DISTINCT FROM slot1 AND i IS DISTINCT FROM slot2 AND i IS DISTINCT FROM slot3), ','), '') AS rest FROM t""")
def slot_subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """Subtitle slots: readable tracks of the wanted languages by rank, generated ones where the source has none, a blank one in front."""
    lang = F.get(F.array(*map(F.lit, ("eng", "jpn", "fre", "eng"))), (F.col("l_partkey") % 4).cast("int"))
    sub = F.struct("pos", F.col("pos").alias("idx"), lang.alias("lang"), (F.col("l_returnflag") == "R").alias("forced"), (F.col("l_returnflag") == "A").alias("sdh"))
    rows = _lines(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(sub)).alias("subs"))
    key = F.col("l_orderkey")
    wanted = F.when(key % 5 == 0, F.array(F.lit("eng"), F.lit("jpn"))).otherwise(F.array().cast("array<string>"))
    made = F.when(key % 3 == 0, F.array(F.lit("eng"), F.lit("jpn"))).when(key % 3 == 1, F.array(F.lit("jpn"))).otherwise(F.array().cast("array<string>"))
    usable = tracks.usable_subtitles(F.col("subs"), F.array(F.lit(2).cast("long")), wanted)
    found = rows.select("l_orderkey", usable.alias("subs")).select("l_orderkey", tracks.planned_subtitles(F.col("subs"), made, key % 2 == 0).alias("p"))
    return found.select("l_orderkey", "p.slot1", "p.slot2", "p.slot3", F.array_join("p.rest", ",").alias("rest"))


@query(f"""
WITH p AS (SELECT l_orderkey, coalesce(min(pos) FILTER (language = 'eng'), min(pos) FILTER (language = 'jpn'), 0) AS picked, bool_or(language = 'eng') AS english FROM {_RANKED} GROUP BY l_orderkey),
r AS (SELECT *, CASE language WHEN 'eng' THEN 0 WHEN 'jpn' THEN 1 ELSE 2 END AS a FROM {_RANKED} JOIN p USING (l_orderkey))
SELECT l_orderkey, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY a, a = 2 AND pos <> picked, pos) FILTER (language <> 'eng' OR ch <= 2), '') AS ids,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY CASE WHEN pos = 2 THEN 0 WHEN pos = 1 THEN 1 ELSE 2 END, pos), '') AS imposed, CAST(coalesce(max(pos) FILTER (pos = 1), 0) AS BIGINT) AS position,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (language = 'fre'), string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS conform FROM r GROUP BY l_orderkey""")
def stereo_order(spark: SparkSession, folder: str) -> DataFrame:
    """English tracks that the downmix replaces; tracks in an imposed order; a stream's position; the languages to conform."""
    all_tracks = F.col("tracks")
    ids = lambda found: F.array_join(F.transform(found, lambda t: t["idx"].cast("string")), ",")
    ordered = tracks.audio_in_order(all_tracks, tracks.picked_audio(all_tracks)["track"], [], stereo_only=True)
    imposed = tracks.in_track_order(all_tracks, F.array(F.lit(2).cast("long"), F.lit(1).cast("long")))
    position = tracks.position_of(all_tracks, F.lit(1).cast("long")).cast("long")
    return _audio(spark, folder).select("l_orderkey", ids(ordered).alias("ids"), ids(imposed).alias("imposed"), position.alias("position"), ids(tracks.conform_tracks(all_tracks, F.array(F.lit("fre")))).alias("conform"))


@query(f"""
WITH s AS (SELECT user_id, count(*) AS points, min(t - a) AS head, 1728000 - max(t - a) AS tail, coalesce(max(nxt - t), 0) AS gap FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM (SELECT *, (SELECT floor(min(t)) FROM {_E}) AS a FROM {_E}) WHERE t - a < 1728000) GROUP BY user_id)
SELECT user_id, CASE WHEN tail > 86400 THEN 'tail' WHEN head > 86400 THEN 'head' WHEN gap > 86400 THEN 'gap' WHEN points < 3 THEN 'few' END AS problem FROM s""")
def coverage_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the first twenty days of each user are covered."""
    events = _events(spark, folder)
    rows = events.join(events.agg(F.floor(F.min("t")).alias("a"))).withColumn("t", F.col("t") - F.col("a")).where("t < 1728000")
    return series.coverage(rows, ["user_id"], "t", F.lit(1728000.0)).select("user_id", "problem")


@query("""
SELECT o_orderkey, CASE WHEN k = 0 AND o_totalprice > 100000 AND NOT f THEN 'skip_done' WHEN k = 1 THEN 'skip_codec' WHEN k = 2 THEN 'skip_failed' WHEN k = 3 AND a THEN 'skip_analyzed' ELSE 'process' END AS disposition
FROM (SELECT *, o_orderkey % 5 AS k, o_custkey % 2 = 0 AS f, o_custkey % 3 = 0 AS a FROM orders)""")
def resume_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Every last status with and without force and analysis alone."""
    status = F.get(F.array(*map(F.lit, ("done", "skipped_av1", "failed", "analyzed", "planned"))), (F.col("o_orderkey") % 5).cast("int"))
    rows, exists = table(spark, folder, "orders"), F.col("o_totalprice") > 100000
    force, analyze = F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0
    case = F.lit(None).cast("string")
    for f in (True, False):
        for a in (True, False):
            case = F.when((force == f) & (analyze == a), queue.disposition(status, exists, f, a)).otherwise(case)
    return rows.select("o_orderkey", case.alias("disposition"))


@query("""
SELECT o_orderkey, CAST(min(attempt) AS INT) AS attempt, arg_min(q, attempt) AS q FROM (SELECT o_orderkey, attempt, 30 - 2 * attempt AS q, (o_orderkey * 7 + attempt * 3) % 5 = 0 AS ok FROM orders, range(4) t(attempt)) WHERE ok GROUP BY o_orderkey""")
def first_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The first attempt of each ladder that succeeded."""
    attempts = table(spark, folder, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    attempts = attempts.select("o_orderkey", "attempt", (30 - 2 * F.col("attempt")).cast("long").alias("q"))
    return planning.first_success(attempts, ["o_orderkey"], "attempt", (F.col("o_orderkey") * 7 + F.col("attempt") * 3) % 5 == 0)


@query("""
SELECT p_partkey, tile, array_to_string([tile, greatest(64, tile // 2), greatest(64, tile // 4), 0], ',') AS ladder, CAST(CASE WHEN h * 2 >= 1080 THEN 2 WHEN h * 3 >= 1080 THEN 3 ELSE 4 END AS INT) AS factor FROM (
  SELECT p_partkey, CAST(greatest(64, least(least(CAST(floor(400 * sqrt(p_retailprice * 4 / (50 + p_size)) / 32) * 32 AS BIGINT), 256 + p_size * 16), 896)) AS INT) AS tile, 180 + p_size * 12 AS h FROM part)""")
def tile_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles that budgets allow, the ladder below each, and the smallest factor that reaches the target."""
    tile = planning.tile_for(F.col("p_retailprice") * 4, F.lit(50.0) + F.col("p_size"), F.lit(256) + F.col("p_size") * 16)
    rows = table(spark, folder, "part").select("p_partkey", "p_size", tile.alias("tile"))
    ladder = F.array_join(F.transform(planning.tile_ladder(F.col("tile")), lambda x: x.cast("string")), ",")
    return rows.select("p_partkey", "tile", ladder.alias("ladder"), planning.upscale_factor(F.lit(180) + F.col("p_size") * 12, [2, 3, 4]).cast("int").alias("factor"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def finished_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Files that count as finished: of the suffix, not temporary, not among the failed."""
    key = F.col("doc_id")
    path = F.concat(F.when(key % 5 == 0, "out/failed/").otherwise("out/"), key.cast("string"), F.when(key % 7 == 0, ".tmp").otherwise(""), F.when(key % 4 == 0, ".mkv").otherwise(".mp4"))
    return tables.outputs(table(spark, folder, "documents").select("doc_id", path.alias("path"))).select("doc_id")


@query(f"""
SELECT user_id, round(max(abs(o)), 6) AS worst, round(arg_min(o, (t, event_id)), 6) AS first, round(arg_max(o, (t, event_id)), 6) AS last, max(abs(o)) >= 0.04 AS repair FROM (SELECT *, value / 5000 - 0.001 AS o FROM {_E} WHERE event_type <> 'error' AND user_id % 2 = 0) GROUP BY user_id""")
def sync_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The worst, first and last offset of each user's good anchors."""
    rows = _events(spark, folder).where("user_id % 2 = 0").select("user_id", F.struct("t", "event_id").alias("t"), (F.col("value") / 5000 - 0.001).alias("offset"), (F.col("event_type") != "error").alias("good"))
    found = align.sync_report(rows, ["user_id"])
    return found.select("user_id", F.round("worst", 6).alias("worst"), F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "repair")


@query("SELECT event_id, CAST(event_id % 9000 AS VARCHAR) AS frame, CAST(event_id % 7 AS VARCHAR) || '.5x' AS speed, CAST(NULL AS VARCHAR) AS size FROM events")
def progress_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of one-line progress, however its signs are spaced."""
    key = F.col("event_id")
    line = F.concat(F.lit(" frame=  "), (key % 9000).cast("string"), F.lit(" fps=24 speed = "), (key % 7).cast("string"), F.lit(".5x "))
    rows = table(spark, folder, "events").select("event_id", watch.progress_pairs(line).alias("m"))
    return rows.select("event_id", F.col("m")["frame"].alias("frame"), F.col("m")["speed"].alias("speed"), F.col("m")["size"].alias("size"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY user_id")
def fresh_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The newest cached row of each user of the last ten days."""
    events = table(spark, folder, "events")
    end = events.agg(F.max("ts")).first()[0]
    rows = events.select("user_id", "event_type", "ts", "event_id").withColumn("at", F.struct("ts", "event_id"))
    young = watch.fresh(rows.select("user_id", "event_type", "ts", "at"), ["user_id"], "ts", F.lit(end).cast("timestamp_ntz"), days=10)
    last = rows.groupBy("user_id").agg(F.max_by("event_type", "at").alias("event_type"))
    return last.join(young.select("user_id"), "user_id", "left_semi")


@query(f"""
WITH r AS (SELECT event_id, user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total, t - min(t) OVER (PARTITION BY user_id) AS gone FROM {_E})
SELECT event_id, round(n / nullif(gone, 0), 9) AS rate, round((total - n) / (n / nullif(gone, 0)), 3) AS seconds_left FROM r""")
def progress_eta(spark: SparkSession, folder: str) -> DataFrame:
    """Rate and seconds left after each event of a user."""
    by = W.partitionBy("user_id")
    events = _events(spark, folder).withColumn("total", F.count("*").over(by)).withColumn("gone", F.col("t") - F.min("t").over(by))
    rows = series.progress(events, ["user_id"], _order(), F.lit(1), F.col("gone"), F.col("total"))
    return rows.select("event_id", F.round("rate", 9).alias("rate"), F.round("seconds_left", 3).alias("seconds_left"))


@query("SELECT CAST(count(*) AS BIGINT) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files FROM (SELECT lower(left(c_name, 4)) || c_custkey % 700 AS t, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1)")
def clash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """How many output names are asked for more than once, and by how many files."""
    target = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.upper(F.left("c_name", F.lit(4)))).otherwise(F.left("c_name", F.lit(4))), (F.col("c_custkey") % 700).cast("string"))
    rows = queue.with_clashes(table(spark, folder, "customer").withColumn("target", target), F.col("target")).where("clash_size > 1")
    return rows.agg(F.count_distinct(F.lower("target")).alias("groups"), F.count("*").alias("files"))


@query(f"""
WITH d AS (SELECT user_id, t / 86400 - 19000 AS t, value * 0 + (t / 86400 - 19000) * (user_id % 7) + user_id AS e FROM {_E} WHERE user_id % 5 = 0)
SELECT user_id, round(regr_slope(e, t), 4) AS slope, round(regr_intercept(e, t), 3) AS intercept, CAST(count(*) AS BIGINT) AS kept, CAST(0.0 AS DOUBLE) AS rms FROM d GROUP BY user_id""")
def line_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines through points that lie on one: slope, intercept and no error left."""
    t = F.col("t") / 86400 - 19000
    points = _events(spark, folder).where("user_id % 5 = 0").select("user_id", t.alias("t"), (t * (F.col("user_id") % 7) + F.col("user_id")).alias("e"))
    found = series.robust_line(points, ["user_id"], "t", "e")
    return found.select("user_id", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "kept", F.round("rms", 3).alias("rms"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ep Title' WHEN 1 THEN 'AV1 Rising' WHEN 2 THEN 'Ep' ELSE 'NAV1' END AS title, CAST(CASE p_partkey % 3 WHEN 0 THEN 1990 + p_size % 30 WHEN 1 THEN 1900 ELSE 1901 END AS INT) AS year,
  CASE p_partkey % 3 WHEN 0 THEN 'high,awful' ELSE 'low,awful' END AS tiers FROM part""")
def name_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Codec suffixes of titles, years of dates, and lists of tiers."""
    key = F.col("p_partkey")
    title = F.get(F.array(*map(F.lit, ("Ep Title_AV1_AV1", "AV1 Rising", "Ep - av1", "NAV1"))), (key % 4).cast("int"))
    date = F.when(key % 3 == 0, F.concat((1990 + F.col("p_size") % 30).cast("string"), F.lit("-05-01"))).when(key % 3 == 1, "n/a").otherwise("")
    tiers = F.when(key % 3 == 0, " high, none,awful").when(key % 3 == 1, "LOW")
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", X.strip_suffix(title).alias("title"), X.release_year(date, F.when(key % 3 == 1, 1900).otherwise(1901)).cast("int").alias("year"), F.array_join(settings.repaired_tiers(tiers), ",").alias("tiers"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dv5' WHEN 1 THEN 'dv78' WHEN 2 THEN 'hlg' ELSE 'sdr' END AS hdr, CAST(CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 END AS INT) AS dovi, 'bt2020' AS prim, 'bt2020nc' AS space, CASE WHEN p_size % 2 = 0 THEN 'tv' ELSE '' END AS range, '24000/1001' AS fps_str, CAST(1 AS INT) AS atts, CAST(0 AS INT) AS vidx,
  CASE p_size % 3 WHEN 0 THEN 'eng:640000:0.0:true' WHEN 1 THEN 'eng:448000:0.25:false' ELSE 'und:0:0.0:false' END AS audio, '3.5,0.0' AS durations, CAST(p_size AS DOUBLE) AS container, 'Signs' AS title, 'tt' || p_partkey AS imdb FROM part""")
def probe_full(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of a probe record: dynamic range, colours, rates, tags, attachments; starts, rates and kinds of audio."""
    key, size = F.col("p_partkey"), F.col("p_size")
    side = F.when(key % 4 == 0, ',"side_data_list":[{"side_data_type":"DOVI configuration record","dv_profile":5}]').when(key % 4 == 1, ',"side_data_list":[{"side_data_type":"Mastering display metadata"},{"side_data_type":"DOVI configuration record","dv_profile":8}]').otherwise("")
    trc = F.when(key % 4 == 2, "ARIB-STD-B67").otherwise("bt709")
    video = F.format_string('{"index":0,"codec_type":"video","codec_name":"hevc","width":3840,"height":2160,"avg_frame_rate":"24000/1001","r_frame_rate":"24000/1001","bit_rate":"9000","color_transfer":"%s","color_primaries":"BT2020","color_space":"bt2020nc"%s%s}', trc, F.when(size % 2 == 0, ',"color_range":"TV"').otherwise(""), side)
    audio = F.when(size % 3 == 0, '"tags":{"language":"ENG","BPS-eng":"640000","DURATION":"00:00:03.500"},"disposition":{"comment":1}').when(size % 3 == 1, '"bit_rate":"448000","start_time":"0.25","tags":{"language":"eng"},"duration":"3.5"').otherwise('"tags":{"DURATION":"00:00:03.5"}')
    rest = ',{"index":2,"codec_type":"audio","codec_name":"aac"},{"index":3,"codec_type":"subtitle","codec_name":"ass","tags":{"title":" Signs "}},{"index":4,"codec_type":"attachment"}'
    json = F.concat(F.lit('{"streams":['), video, F.lit(',{"index":1,"codec_type":"audio","codec_name":"ac3",'), audio, F.lit("}" + rest), F.lit('],"format":{"duration":"'), size.cast("string"), F.lit('","size":"1000","tags":{"IMDB":"tt'), key.cast("string"), F.lit('"}}}'))
    rows = table(spark, folder, "part").select("p_partkey", json.alias("json"))
    info = tables.probed(rows)
    first = F.get("audios", F.lit(0))
    about = F.concat_ws(":", first["lang"], first["bit_rate"].cast("string"), first["start"].cast("string"), first["aux"].cast("string"))
    durations = F.array_join(F.transform(tables.audio_durations(F.col("json")), lambda d: d.cast("string")), ",")
    return info.select("p_partkey", "hdr", "dovi", "prim", "space", "range", "fps_str", "atts", "vidx", about.alias("audio"), durations.alias("durations"), tables.duration_of(F.col("json")).alias("container"), F.get("subs", F.lit(0))["title"].alias("title"), F.col("tags")["IMDB"].alias("imdb"))


def _simple(name: str, value: str) -> str:
    return f"'    <Simple><Name>{name}</Name><String>' || {value} || '</String></Simple>' || chr(10)"


def _tag(level: int, lines: str) -> str:
    return f"'  <Tag>' || chr(10) || '    <Targets><TargetTypeValue>{level}</TargetTypeValue></Targets>' || chr(10) || {lines} || '  </Tag>' || chr(10)"


_WHOLE = " || ".join([
    _simple("TITLE", "p_name || ' &amp; Co'"), "CASE WHEN p_size % 3 < 2 THEN " + _simple("DATE_RELEASED", "CASE p_size % 3 WHEN 0 THEN '1999' ELSE '2001' END") + " ELSE '' END", _simple("CONTENT_TYPE", "CASE WHEN ep THEN 'TV' ELSE 'Movie' END"),
    _simple("TMDB", "CASE WHEN ep THEN 'tv/' ELSE 'movie/' END || p_partkey"), "CASE WHEN p_size % 2 = 0 THEN " + _simple("IMDB", "'tt' || p_partkey") + " ELSE '' END", _simple("GENRE", "p_brand || ', ' || p_type"),
])
_PART = _simple("TITLE", "'Part &lt;' || p_size || '&gt;'") + " || " + _simple("PART_NUMBER", "p_size")


@query(f"""
SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Tags>' || chr(10) || CASE WHEN NOT ep THEN {_tag(50, _WHOLE)} ELSE {_tag(70, _WHOLE)} || CASE WHEN p_size % 5 > 0 THEN {_tag(60, _simple('PART_NUMBER', 'p_size % 5'))} ELSE '' END || CASE WHEN p_size % 7 > 0 THEN {_tag(50, _PART)} ELSE '' END END || '</Tags>' || chr(10) AS xml,
  'C' || repeat(chr(92), 2) || ':/it' || chr(92) || chr(39) || 's/' || p_partkey AS path FROM (SELECT *, p_partkey % 2 = 1 AS ep FROM part)""")
def tag_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Tag files of films and episodes with their levels, and paths escaped for filters."""
    key, size = F.col("p_partkey"), F.col("p_size")
    none, episode = F.lit(None).cast("string"), key % 2 == 1
    date = F.when(size % 3 == 0, "1999-12-31").otherwise("")
    own = lambda value: F.when(size % 7 > 0, value)
    xml = sinks.tag_document(F.concat("p_name", F.lit(" & Co")), date, F.when(size % 3 == 1, 2001), none, key, F.when(size % 2 == 0, F.concat(F.lit("tt"), key.cast("string"))), none, F.array("p_brand", "p_type"), episode, F.when(size % 5 > 0, size % 5), own(size), own(F.concat(F.lit("Part <"), size.cast("string"), F.lit(">"))), none, none)
    path = X.filter_path(F.concat(F.lit("C:\\it's/"), key.cast("string")))
    return table(spark, folder, "part").select("p_partkey", xml.alias("xml"), path.alias("path"))


@query("""
SELECT user_id, round(coalesce(sum(CASE WHEN event_type <> 'error' THEN floor(value) END), 0), 3) AS model_s, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id % 100 END), 0) AS BIGINT) AS frames, CAST(greatest(0, coalesce(max(CASE WHEN event_type = 'view' THEN event_id % 9000 END), 0)) AS DOUBLE) AS peak_vram_mb FROM events GROUP BY user_id""")
def run_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What the chunks of each user's runs report, broken reports among them."""
    kind, key = F.col("event_type"), F.col("event_id")
    body = F.format_string('{"seconds_model": %d, "frames": %d', F.floor("value").cast("long"), key % 100)
    json = F.when(kind == "error", "{not json").when(kind == "view", F.concat(body, F.format_string(', "peak_vram_mb": %d}', key % 9000))).otherwise(F.concat(body, F.lit("}")))
    found = series.run_statistics(table(spark, folder, "events").select("user_id", json.alias("m")), ["user_id"], "m")
    return found.select("user_id", F.round("model_s", 3).alias("model_s"), "frames", "peak_vram_mb")


@query("""
SELECT p_partkey, p_partkey % 4 = 1 AS needs_dv_strip, p_partkey % 4 = 0 AS dv5, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'eng' WHEN 2 THEN 'jpn_fallback' ELSE 'first_track_no_eng_no_jpn' END AS why, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS audio,
  concat_ws(';', CASE WHEN p_partkey % 4 IN (0, 2) THEN 'sdr_expanded_to_hdr10_libplacebo;sdr_hdr_saturation_1.30' END, CASE p_size % 4 WHEN 0 THEN 'no_audio_stream' WHEN 2 THEN 'audio_pick_jpn_fallback' WHEN 3 THEN 'audio_pick_first_track_no_eng_no_jpn' END) AS notes FROM part""")
def plan_rest(spark: SparkSession, folder: str) -> DataFrame:
    """The audio pick of plans, the layers of Dolby Vision, and the gain of colours when they are widened."""
    key, size = F.col("p_partkey"), F.col("p_size")
    track = lambda idx, lang: F.struct(F.lit(idx).alias("idx"), F.lit(lang).alias("lang"))
    none = F.array().cast("array<struct<idx:int,lang:string>>")
    audios = F.when(size % 4 == 1, F.array(track(0, "jpn"), track(1, "eng"))).when(size % 4 == 2, F.array(track(0, "ja"), track(1, "fre"))).when(size % 4 == 3, F.array(track(0, "fre"))).otherwise(none)
    hdr = F.get(F.array(*map(F.lit, ("dv5", "dv78", "sdr", "hdr10"))), (key % 4).cast("int"))
    crop = [F.lit(None).cast("int").alias(c) for c in ("crop_w", "crop_h", "crop_x", "crop_y")]
    items = table(spark, folder, "part").select("p_partkey", F.lit(1920).alias("w"), F.lit(1080).alias("h"), *crop, F.lit(24.0).alias("fps"), F.lit(10).alias("depth"), hdr.alias("hdr"), *[F.lit("bt709").alias(c) for c in ("prim", "space", "trc")], F.lit("tv").alias("color_range"), F.lit("high").alias("tier"), F.lit(False).alias("interlaced"), F.lit(1e9).alias("size"), F.lit(6000.0).alias("dur"), F.array().cast("array<string>").alias("notes"), audios.alias("audios"))
    found = planning.planned(items, planning.Options(to_hdr=True, tone_filter="widen", hdr_saturation=9.0, deband="off", sharpen=0.0))
    return found.select("p_partkey", "needs_dv_strip", "dv5", F.col("audio_why").alias("why"), F.col("audio.idx").alias("audio"), F.array_join("notes", ";").alias("notes"))
