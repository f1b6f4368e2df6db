"""Queries over provenance, caches, scratch space, diagnostics and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import cues, matching, planning, queue, tracks
from ..sources import sinks, tables
from ..sources.tables import table
from .catalog import query, sql_map
from .texts import _COUNTS, _SNIFF, _TOTAL, _TURNS, _scripts


@query("""
SELECT p_partkey, coalesce(CAST(o_orderkey AS VARCHAR), path) AS source, o_orderstatus FROM (SELECT p_partkey, 'Out/Film' || p_partkey || '.MKV' AS path FROM part)
LEFT JOIN (SELECT o_orderkey, o_orderstatus, 'out/film' || o_orderkey || '.mkv' AS out FROM orders WHERE o_orderstatus = 'F') ON lower(path) = lower(out)""")
def output_records(spark: SparkSession, folder: str) -> DataFrame:
    outputs = table(spark, folder, "part").select("p_partkey")
    log = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderkey", "o_orderstatus")
    path = F.concat(F.lit("Out/Film"), F.col("p_partkey").cast("string"), F.lit(".MKV"))
    return queue.with_records(outputs, log, path, F.concat(F.lit("out/film"), F.col("o_orderkey").cast("string"), F.lit(".mkv")), "key", ["o_orderstatus"]).select("p_partkey", "source", "o_orderstatus")


@query("SELECT c_custkey, coalesce(total, c_acctbal) AS total, total IS NOT NULL AS hit FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey")
def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    cache = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("total"))
    return queue.with_cached(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), cache, "c_custkey", {"total": F.col("c_acctbal")}).drop("c_acctbal")


@query("SELECT p_partkey, p_partkey % 4 = 1 AS done FROM part")
def sidecar_marks(spark: SparkSession, folder: str) -> DataFrame:
    stem = F.concat(F.lit("a.b/film "), F.col("p_partkey").cast("string"))
    items = table(spark, folder, "part").select("p_partkey", F.concat(stem, F.lit(".mkv")).alias("path"))
    listing = table(spark, folder, "part").select(F.concat(stem, F.when(F.col("p_partkey") % 4 == 1, ".info").otherwise(".txt")).alias("path"))
    return queue.with_sidecars(items, listing).select("p_partkey", "done")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber AS stage, CASE WHEN l_returnflag = 'N' THEN 'video' ELSE 'audio' END AS kind, l_suppkey % 3 AS pos, max(l_quantity) AS dur FROM lineitem GROUP BY ALL),
s AS (SELECT *, lag(stage) OVER (PARTITION BY l_orderkey ORDER BY stage) AS b FROM (SELECT DISTINCT l_orderkey, stage FROM c)),
n AS (SELECT l_orderkey, stage, kind, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY ALL)
SELECT s.l_orderkey, s.stage, p.kind, CAST(NULL AS BIGINT) AS pos, 'fewer' AS problem, p.n AS was, coalesce(q.n, 0.0) AS now FROM s JOIN n p ON p.l_orderkey = s.l_orderkey AND p.stage = s.b LEFT JOIN n q ON q.l_orderkey = s.l_orderkey AND q.stage = s.stage AND q.kind = p.kind WHERE coalesce(q.n, 0) < p.n
UNION ALL SELECT s.l_orderkey, s.stage, a.kind, CAST(a.pos AS BIGINT), 'short', a.dur, d.dur FROM s JOIN c a ON a.l_orderkey = s.l_orderkey AND a.stage = s.b JOIN c d ON d.l_orderkey = s.l_orderkey AND d.stage = s.stage AND d.kind = a.kind AND d.pos = a.pos WHERE a.dur - d.dur > 2""")
def ledger_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as stages of its tracks: what each lost against the one before."""
    kind = F.when(F.col("l_returnflag") == "N", "video").otherwise("audio")
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("stage"), kind.alias("kind"), (F.col("l_suppkey") % 3).alias("pos")).agg(F.max("l_quantity").alias("dur"))
    return tracks.ledger_problems(rows, ["l_orderkey"], "stage")


@query("SELECT user_id, min(CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END) AS worst, CAST(count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS BIGINT) AS windows, min(CASE WHEN event_id % 3 <> 0 THEN event_id % 90 END) AS first FROM events GROUP BY user_id")
def worst_score(spark: SparkSession, folder: str) -> DataFrame:
    """The least of the last scores that windows' logs name."""
    key = F.col("event_id")
    log = F.when(key % 3 == 0, "no score").otherwise(F.concat(F.lit("VMAF score: 99\nsilence_end: "), (key % 90).cast("string"), F.lit("\nsilence_end: 99\nVMAF score: "), (key % 97).cast("string"), F.lit(".0")))
    rows = table(spark, folder, "events").select("user_id", tables.last_match(log, r"VMAF score:\s*([0-9.]+)").try_cast("double").alias("score"), tables.first_match(log, r"silence_end: (\d+)").try_cast("long").alias("end"))
    return rows.groupBy("user_id").agg(F.min("score").alias("worst"), F.count("score").alias("windows"), F.min("end").alias("first"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(o_orderkey) AS BIGINT) AS freed, max(o_totalprice) AS longest FROM orders WHERE o_custkey <> 7 AND o_orderkey % 5 <> 0 AND (o_orderstatus <> 'O' OR o_totalprice >= 86400) GROUP BY o_orderstatus")
def orphan_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Scratch sessions whose process is gone, and what they free."""
    name = F.when(F.col("o_orderkey") % 5 == 0, "sx-1").otherwise(F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("-ab")))
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", name.alias("name"), F.col("o_totalprice").alias("idle"), (F.col("o_orderstatus") == "O").alias("alive"))
    return queue.orphaned(rows, 7).groupBy("o_orderstatus").agg(F.count("*").alias("sessions"), F.sum("o_orderkey").alias("freed"), F.max("idle").alias("longest"))


_MEDIA = ["nvme", "hdd", "unknown", "ssd", "scm"]


@query(f"""
SELECT s_nationkey, s_suppkey, media, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY rank DESC, s_suppkey % 26 = 4, free DESC, root) AS INT) AS place FROM (
  SELECT *, CASE media WHEN 'nvme' THEN 4 WHEN 'scm' THEN 4 WHEN 'ssd' THEN 3 WHEN 'hdd' THEN 1 ELSE 2 END AS rank FROM (
    SELECT s_nationkey, s_suppkey, chr(CAST(65 + s_suppkey % 26 AS INT)) || ':' || s_suppkey AS root, free, CASE WHEN m <> 'unknown' THEN m WHEN s_suppkey % 900 >= 400 THEN 'ssd' WHEN s_suppkey % 900 > 0 THEN 'hdd' ELSE m END AS media
    FROM (SELECT *, ({_MEDIA})[s_suppkey % 5 + 1] AS m, CAST(s_acctbal * 20000000 AS BIGINT) AS free FROM supplier)) WHERE free >= 53687091200)""")
def scratch_order(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.char(65 + key % 26), F.lit(":"), key.cast("string")).alias("root"), F.round(F.col("s_acctbal") * 20000000).cast("long").alias("free"), F.get(F.array(*map(F.lit, _MEDIA)), (key % 5).cast("int")).alias("media"), (key % 900).alias("mbps"))
    return queue.scratch_volumes(rows, ["s_nationkey"], F.lit(1), F.lit("e:/out")).select("s_nationkey", "s_suppkey", "media", "place")


@query(f"""
SELECT conv_id, CASE WHEN total < 40 THEN 'unknown' WHEN kana / total > 0.04 THEN 'jpn' WHEN han / total > 0.20 THEN CASE WHEN kana > 0 THEN 'jpn' ELSE 'chi' END {_SNIFF} ELSE 'unknown' END AS language
FROM (SELECT *, CAST({_TOTAL} AS DOUBLE) AS total FROM (SELECT conv_id, {_COUNTS} FROM (SELECT conv_id, string_agg(body, ' ') AS text FROM {_TURNS} GROUP BY conv_id)))""")
def subtitle_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of the spoken lines of subtitle texts."""
    return _scripts(spark, folder).select("conv_id", X.sniffed_language(X.script_profile(cues.spoken_text(F.col("text")))).alias("language"))


_TAGS, _HEARD = ["eng", "jpn", "ger", "und", "EN"], ["latin", "jpn", "chi", "unknown"]


@query(f"""
SELECT p_partkey, CASE WHEN bitmap OR got = 'unknown' THEN tag WHEN got = 'latin' THEN CASE WHEN tag = 'jpn' THEN 'eng' ELSE tag END WHEN got = 'jpn' THEN 'jpn' WHEN tag IN ('eng', 'EN') THEN got ELSE tag END AS subtitle,
  CASE WHEN tag = 'und' AND p_size % 2 = 0 AND got = 'jpn' THEN 'jpn' WHEN tag = 'und' AND p_size % 2 = 0 AND got = 'latin' THEN 'eng' ELSE tag END AS audio
FROM (SELECT p_partkey, p_size, ({_TAGS})[p_partkey % 5 + 1] AS tag, ({_HEARD})[p_size % 4 + 1] AS got, p_partkey % 7 = 0 AS bitmap FROM part)""")
def tag_rules(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    tag, got = pick(_TAGS, F.col("p_partkey") % 5), pick(_HEARD, F.col("p_size") % 4)
    return table(spark, folder, "part").select("p_partkey", cues.tag_decision(tag, got, F.col("p_partkey") % 7 == 0).alias("subtitle"), tracks.untagged_audio(tag, got, F.col("p_size") % 2 == 1).alias("audio"))


_LOGS = ["Required: 13.0 Found: 12.1", "The minimum required Nvidia driver for nvenc is 551.76 or newer", "No capable devices found", "Device type is unsupported", "something else", "required: 9.9 found: 9.0"]
_CODES = [0, 1, 125, 4294967294, 4294967256, 3199971767, 300, 255]


@query(f"""
SELECT p_partkey, (['version_gap', 'version_gap', 'nocard', 'nocard', 'unknown', 'version_gap'])[p_partkey % 6 + 1] AS kind, (['570.00', '551.76', NULL, NULL, NULL, NULL])[p_partkey % 6 + 1] AS needs,
  (['0 (signed 0, 0x00000000)', '1', '125 (it never started)', '4294967294 (signed -2, 0xFFFFFFFE, ENOENT: a file or codec is missing)', '4294967256 (signed -40, 0xFFFFFFD8, ENOSYS: not possible with this build, driver or encoder)',
    '3199971767 (signed -1094995529, 0xBEBBB1B7{matching.LARGE_NEGATIVE})', '300 (signed 300, 0x0000012C)', '255'])[p_size % 8 + 1] AS code FROM part""")
def failure_texts(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    found = matching.start_failure(pick(_LOGS, F.col("p_partkey") % 6))
    return table(spark, folder, "part").select("p_partkey", found["kind"].alias("kind"), found["needs"].alias("needs"), matching.exit_text(pick(_CODES, F.col("p_size") % 8)).alias("code"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '470bg' WHEN 1 THEN 'bt470bg' WHEN 2 THEN '5' ELSE '470bg' END AS spelling FROM part")
def first_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Names that a build lists, or none: the first candidate that fits."""
    key = F.col("p_partkey") % 4
    known = F.when(key == 0, F.array(F.lit("bt470bg"), F.lit("470bg"))).when(key == 1, F.array(F.lit("bt470bg"))).when(key == 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "part").select("p_partkey", planning.first_spelling(F.array(F.lit("470bg"), F.lit("bt470bg"), F.lit("5")), known).alias("spelling"))


@query("""
SELECT p_partkey, greatest(160, least(768, greatest(greatest(160, least(768, 128 * ch)), CASE WHEN rate > 0 AND NOT lossless THEN CAST(trunc(rate / sch * ch / 1000.0) AS INT) ELSE 0 END))) AS opus, rate AS stream_rate
FROM (SELECT p_partkey, CAST(p_size % 8 + 1 AS INT) AS ch, CAST(p_size % 3 + 1 AS INT) AS sch, p_partkey % 4 = 0 AS lossless, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 100 WHEN 1 THEN p_partkey * 200 ELSE 0 END AS rate FROM part)""")
def audio_rates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    tags = F.create_map(F.lit("BPS-eng"), F.when(key % 3 == 1, text(key * 200)).otherwise("0"), F.lit("title"), F.lit("x"))
    rate = tracks.stream_bitrate(F.when(key % 3 == 0, key * 100).otherwise(0), tags)
    rows = table(spark, folder, "part").select("p_partkey", "p_size", rate.alias("stream_rate"))
    return rows.select("p_partkey", tracks.opus_bitrate((F.col("p_size") % 8 + 1).cast("int"), F.col("stream_rate"), F.col("p_size") % 3 + 1, key % 4 == 0).cast("int").alias("opus"), "stream_rate")


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 10.5 WHEN 1 THEN 3723.5 WHEN 2 THEN 40.0 WHEN 3 THEN 77.25 WHEN 4 THEN 88.0 ELSE 0.0 END AS DOUBLE) AS dur, p_size % 3 < 2 AS agrees, p_partkey % 5 = 0 AS constant FROM part""")
def duration_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The five sources of a duration in order, a check of one, and of two rates."""
    key = F.col("p_partkey") % 6
    only = lambda k, value: F.when(key == k, value).otherwise(0.0)
    dur = tables.video_duration(only(0, 10.5), F.when(key <= 1, "01:02:03.5"), F.when(key == 2, 1000).otherwise(0), F.lit(25.0), only(3, 77.25), F.when(key < 5, 88.0))
    agrees = N.durations_agree(F.lit(100.0) + F.col("p_size") % 3, F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(100.0), F.lit(100.0))
    return table(spark, folder, "part").select("p_partkey", dur.alias("dur"), agrees.alias("agrees"), N.rates_agree(F.lit(24.0), F.when(F.col("p_partkey") % 5 == 0, 24.01).otherwise(25.0)).alias("constant"))


@query("""
SELECT o_orderkey, 'file    ' || o_orderkey || chr(10) || 'status  ' || o_orderstatus || chr(10) || 'size    1.00 GiB' || chr(10) || 'elapsed 45s' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'notes   a; b' ELSE '' END AS block,
  rpad('encode', 20, ' ') || rpad('6056.0', 12, ' ') || '3396.0 ' || o_custkey || '.0' AS line, '{"cq":' || o_custkey || ',"preset":"p"}' AS settings FROM orders""")
def sink_lines(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_custkey")
    notes = F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    block = sinks.report_block(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.lit(1 << 30), F.lit(45), notes)
    line = sinks.ledger_line(F.lit("encode"), F.array(F.lit(6056.0)), F.array(F.lit(3396.0), key.cast("double")))
    settings = sinks.settings_json(F.struct(key.alias("cq"), F.lit("p").alias("preset"), F.lit("secret").alias("policy")), ["cq", "preset"])
    return table(spark, folder, "orders").select("o_orderkey", block.alias("block"), line.alias("line"), settings.alias("settings"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A;B' ELSE 'B' END AS directors, 'D as x;E' AS actors, CAST(c_custkey % 100 AS DOUBLE) AS gpu, CASE WHEN c_custkey % 2 = 0 THEN CAST(55.5 AS DOUBLE) END AS watts FROM customer""")
def people_and_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Names of crew and cast, and numbers of a sample row."""
    key = F.col("c_custkey")
    person = lambda name, job, role: F.struct(name.alias("name"), F.lit(job).alias("job"), F.lit("Directing" if job == "Director" else "Art").alias("department"), F.lit(role).alias("role"))
    crew = F.array(person(F.when(key % 3 == 0, "A").otherwise(""), "Director", ""), person(F.lit("B"), "Director", ""), person(F.lit("C"), "Painter", ""))
    cast = F.array(person(F.lit("D"), "", "x"), person(F.lit("E"), "", ""), person(F.lit(None).cast("string"), "", ""))
    sample = tables.sample_row(F.concat((key % 100).cast("string"), F.lit(" , [N/A], "), F.when(key % 2 == 0, "55.5").otherwise("[Not Supported]")), ["gpu", "fan", "watts"])
    rows = table(spark, folder, "customer").select("c_custkey", F.array_join(tracks.people(crew, job="Director"), ";").alias("directors"), F.array_join(tracks.people(cast), ";").alias("actors"), sample.alias("s"))
    return rows.select("c_custkey", "directors", "actors", F.col("s")["gpu"].alias("gpu"), F.col("s")["watts"].alias("watts"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 9 AS BIGINT) END AS cq, doc_id % 4 = 0 AS aside FROM documents")
def journal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a journal: those that can be read, and the broken ones set aside."""
    key = F.col("doc_id")
    line = F.when(key % 4 == 0, '{"cq": ').otherwise(F.concat(F.lit('{"cq": '), (key % 9).cast("string"), F.lit("}")))
    good, bad = tables.readable(table(spark, folder, "documents").select("doc_id", line.alias("value")), "cq long")
    return good.select("doc_id", "cq", F.lit(False).alias("aside")).union(bad.select("doc_id", F.lit(None).cast("long"), F.lit(True)))


_KIND = sql_map({0: "subtitles", 1: "audio"}, "l_suppkey % 2", "x")


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos FROM lineitem),
t AS (SELECT l_orderkey, pos + 10 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM l WHERE {_KIND} = 'subtitles')
SELECT l.l_orderkey, CAST(pos AS BIGINT) AS idx, CAST(id AS BIGINT) AS id FROM l LEFT JOIN t ON l.l_orderkey = t.l_orderkey AND l.pos = t.k""")
def muxer_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Streams of an order, and the numbers that its subtitle tracks have elsewhere, by position."""
    from .sequences import _lines

    rows = _lines(spark, folder).withColumn("pos", F.col("pos") + 1)
    kind = F.when(F.col("l_suppkey") % 2 == 0, "subtitles").otherwise("audio")
    both = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("idx")))).alias("s"), F.array_sort(F.collect_list(F.struct("pos", kind.alias("type"), (F.col("pos") + 10).alias("id")))).alias("t"))
    return both.select("l_orderkey", F.inline(tracks.muxer_ids(F.col("s"), F.col("t"), "subtitles")))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'kept' AS part FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey UNION ALL SELECT o_custkey, min(o_orderkey), 'dropped' FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def kept_and_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Rows dealt into kept and dropped ones, each without repeats, one after the other."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "dropped").otherwise("kept").alias("part"))
    return queue.first_of_each(rows, ["o_custkey", "part"], [F.col("o_orderkey")])
