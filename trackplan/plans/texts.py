"""Queries over names, scripts, cues, tracks and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.registered import register
from ..operators import cues, matching, tracks
from ..sources import sinks, tables
from ..sources.shared import shared_place
from ..sources.tables import table
from ..streaming.watch import log_events
from .catalog import query, seconds, sql_map
from .sequences import _L, _lines, _tracks

_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS INT) AS {s}" for s, p in {**X.SCRIPTS, "latin": X.LATIN}.items())
_TOTAL = " + ".join([*X.SCRIPTS, "latin"])
_SNIFF = " ".join(f"WHEN {s} / total > {limit} THEN '{lang}'" for s, limit, lang in X.SETTLED)
# letters of other scripts stand before some texts, so that every branch is taken
_SAMPLES = ["", "これはひらがな" * 60, "漢字漢字漢字" * 80, "한국어문장" * 90, "русскийтекст" * 50]
_DOCS = "(SELECT doc_id, CASE doc_id % 40 " + " ".join(f"WHEN {k} THEN '{s}' || text" for k, s in enumerate(_SAMPLES) if s) + " ELSE text END AS text FROM documents)"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    case = F.when(F.lit(False), text)
    for k, s in enumerate(_SAMPLES):
        if s:
            case = case.when(F.col("doc_id") % 40 == k, F.concat(F.lit(s), text))
    return table(spark, folder, "documents").select("doc_id", case.otherwise(text).alias("text"))


@query(f"SELECT doc_id, {_COUNTS} FROM {_DOCS}")
def script_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", X.script_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query(f"""
SELECT doc_id, CASE WHEN total < 40 THEN 'unknown' WHEN kana / total > 0.04 THEN 'jpn' WHEN han / total > 0.20 THEN CASE WHEN kana > 0 THEN 'jpn' ELSE 'chi' END {_SNIFF} ELSE 'unknown' END AS language
FROM (SELECT *, CAST({_TOTAL} AS DOUBLE) AS total FROM (SELECT doc_id, {_COUNTS} FROM {_DOCS}))""")
def sniff_language(spark: SparkSession, folder: str) -> DataFrame:
    profiles = _documents(spark, folder).select("doc_id", X.script_profile(F.col("text")).alias("p"))
    return profiles.select("doc_id", X.sniffed_language(F.col("p")).alias("language"))


_NAMES = ["", "A 007 film", "James-Bond begins", "MARVEL's one", "a Star.Wars story", "startrekker", "Star Trek II", "stargate.sg1", "bonded", "Middleearth", "lotr/pixar", "the ghibli", "dcu x"]
_KEY = f"'_' || regexp_replace(lower(text || ' ' || ({[n.replace(chr(39), ' ') for n in _NAMES]})[doc_id % {len(_NAMES)} + 1]), '[^a-z0-9]+', '_', 'g') || '_'"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(k, '_{w}_') THEN '{label}'" for w, label in matching.FRANCHISES) + f" END AS label FROM (SELECT doc_id, {_KEY} AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def franchise_match(spark: SparkSession, folder: str) -> DataFrame:
    """Names that end whole texts, against the ordered table."""
    name = F.get(F.array(*[F.lit(n.replace("'", " ")) for n in _NAMES]), (F.col("doc_id") % len(_NAMES)).cast("int"))
    return table(spark, folder, "documents").select("doc_id", matching.franchise(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), name)).alias("label"))


@query(r"""
SELECT doc_id, trim(regexp_replace(replace(n, ' ', '_'), '_+', '_', 'g'), '_') AS name FROM (
  SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(translate(line, '<>:"/\|?*', '         '), '&', 'and'), '\p{C}', '', 'g'), '\s*[-–—]+\s*', ' ', 'g'), ',', ''), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n
  FROM (SELECT doc_id, coalesce(text, '') || ' & Co - x:y' AS line FROM documents))""")
def safe_name(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.coalesce("text", F.lit("")), F.lit(" & Co - x:y"))
    return table(spark, folder, "documents").select("doc_id", X.safe_name(line).alias("name"))


@query("""
SELECT p_partkey, 'Part_' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS title, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size % 30 END AS year, CASE WHEN p_partkey % 2 = 1 THEN p_size % 9 + 1 END AS season, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS episode,
  concat_ws('-', 'Part_' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij'), CASE WHEN p_partkey % 2 = 0 THEN printf('(%d)', 1990 + p_size % 30) END, CASE WHEN p_partkey % 2 = 1 THEN printf('S%02dE%02d', p_size % 9 + 1, p_size) END, 'AV1_1080p') AS name FROM part""")
def parsed_names(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("dir/Part."), F.translate(key.cast("string"), "0123456789", "abcdefghij"), F.when(key % 2 == 0, F.format_string(".(%d)_AV1", 1990 + size % 30)).otherwise(F.format_string(".s%02de%02d", size % 9 + 1, size)), F.lit(".mkv"))
    p = table(spark, folder, "part").select("p_partkey", X.parsed_path(path).alias("p"))
    name = X.build_name(F.col("p.title"), F.col("p.year"), F.col("p.season"), F.col("p.episode"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(1080))
    return p.select("p_partkey", X.safe_name(F.col("p.title")).alias("title"), "p.year", "p.season", "p.episode", name.alias("name"))


@query("""
SELECT page_id, nullif(regexp_extract(coalesce(url, '') || ' tt' || lpad(CAST(page_id AS VARCHAR), 7, '0'), '(tt\\d{7,9})', 1), '') AS imdb, nullif(regexp_extract(coalesce(url, ''), '(\\d+)', 1), '') AS tmdb FROM pages""")
def embedded_ids(spark: SparkSession, folder: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    tags = F.create_map(F.lit("source"), F.concat(url, F.lit(" tt"), F.lpad(F.col("page_id").cast("string"), 7, "0")), F.lit("My_TMDB"), url)
    return table(spark, folder, "pages").select("page_id", X.embedded_ids(tags).alias("i")).select("page_id", "i.imdb", "i.tmdb")


_MS = "CAST(round_even(abs(value) * 1000, 0) AS BIGINT)"


@query(f"""
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS text, round(ms / 1000.0, 3) AS again FROM (SELECT event_id, {_MS} AS ms FROM events)""")
def cue_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", X.cue_time(F.abs("value")).alias("text"))
    return rows.select("event_id", "text", F.round(X.cue_seconds(F.col("text")), 3).alias("again"))


@query("""
SELECT event_id, trimmed, CAST(CASE WHEN trimmed THEN 60.0 ELSE stop END AS DOUBLE) AS stop FROM (SELECT event_id, start, start + 5.0 AS stop, start + 5.0 > 60.0 AS trimmed FROM (SELECT event_id, CAST(event_id % 70 AS DOUBLE) AS start FROM events)) WHERE start < 60""")
def cue_clamp(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.col("event_id") % 70).cast("double")
    rows = table(spark, folder, "events").select("event_id", start.alias("start"), (start + 5.0).alias("stop"))
    return cues.clamped(rows, F.lit(60.0)).select("event_id", "trimmed", "stop")


def _scripts(spark: SparkSession, folder: str) -> DataFrame:
    """A subtitle text for each conversation: a cue for each turn, every fifth without its number."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+|-->", " ")
    turn = F.col("turn").cast("double")
    head = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.col("turn").cast("string"), F.lit("\n")))
    cue = F.concat(head, X.cue_time(turn * 2), F.lit(" --> "), X.cue_time(turn * 2 + 1.5), F.lit("\nx"), words)
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))).alias("c"))
    return rows.select("conv_id", F.array_join(F.col("c.c"), "\n\n").alias("text"))


_TURNS = r"(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, 'x' || regexp_replace(coalesce(text, ''), '\s+|-->', ' ', 'g') AS body FROM conversations)"


@query(f"SELECT conv_id, CAST(pos AS INT) AS pos, CAST(turn * 2 AS DOUBLE) AS start, CAST(turn * 2 + 1.5 AS DOUBLE) AS stop, body FROM {_TURNS}")
def parse_cues(spark: SparkSession, folder: str) -> DataFrame:
    return cues.parsed(_scripts(spark, folder), ["conv_id"]).select("conv_id", "pos", "start", "stop", F.array_join("body", "\n").alias("body"))


@query(f"SELECT conv_id, CAST(pos AS INT) AS pos, CAST(turn * 2 AS DOUBLE) AS start, CAST(turn * 2 + 1.5 AS DOUBLE) AS stop, body FROM {_TURNS}")
def sql_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Cues by a table function in SQL."""
    register(spark)
    return spark.sql("SELECT conv_id, c.pos, c.start, c.stop, c.body FROM {scripts}, LATERAL parse_cues(text) c", scripts=_scripts(spark, folder))


@query("""
SELECT doc_id, sha256(coalesce(list_reduce(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda acc, w: acc || CASE WHEN length(split_part(acc, chr(10), -1)) + 1 + length(w) <= 42 AND true THEN ' ' ELSE chr(10) END || w), '')) AS sha FROM documents WHERE NOT contains(coalesce(text, ''), chr(10))""")
def sql_wrap(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of one line, wrapped at 42 characters by a function in SQL."""
    register(spark)
    return spark.sql("SELECT doc_id, sha2(word_wrap(coalesce(text, ''), 42), 256) AS sha FROM {docs} WHERE NOT contains(coalesce(text, ''), '\\n')", docs=table(spark, folder, "documents"))


@query("SELECT n_nationkey, -(n_nationkey - 12) * 3 / 100.0 AS lag, 1500 AS samples FROM nation")
def sql_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets and a stretched timeline of arrays by functions in SQL."""
    register(spark)
    tracks = _tracks(spark, folder, 1000, (F.col("n_nationkey") - 12) * 3)
    return spark.sql("""
      SELECT n_nationkey, round(lag_offset(a, b, 100D, 2D).offset, 3) AS lag, size(warp_samples(a, 100D, array(0D, 10D), array(0D, 15D))) AS samples
      FROM (SELECT n_nationkey, transform(s, x -> x.a) AS a, transform(s, x -> x.b) AS b FROM (SELECT n_nationkey, sort_array(collect_list(struct(i, a, b))) AS s FROM {tracks} GROUP BY n_nationkey))""", tracks=tracks)


@query(f"SELECT conv_id, CAST(count(*) AS BIGINT) AS cues, CAST(sum(length(body)) AS BIGINT) AS characters FROM {_TURNS} GROUP BY conv_id HAVING count(*) >= 3 AND sum(length(body)) > 200")
def useful_cues(spark: SparkSession, folder: str) -> DataFrame:
    return cues.useful(cues.parsed(_scripts(spark, folder), ["conv_id"]), ["conv_id"], least=3)


@query(f"""
SELECT conv_id, sha256(string_agg(CAST(pos + 1 AS VARCHAR) || chr(10) || printf('%02d:%02d:%02d,%03d', turn * 2 // 3600, turn * 2 // 60 % 60, turn * 2 % 60, 0) || ' --> ' || printf('%02d:%02d:%02d,%03d', (turn * 2 + 1) // 3600, (turn * 2 + 1) // 60 % 60, (turn * 2 + 1) % 60, 500) || chr(10) || body, chr(10) || chr(10) ORDER BY pos)) AS sha FROM {_TURNS} GROUP BY conv_id""")
def rendered_cues(spark: SparkSession, folder: str) -> DataFrame:
    return cues.rendered(cues.parsed(_scripts(spark, folder), ["conv_id"]), ["conv_id"]).select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("""
SELECT conv_id, turn, batch, translated, CASE WHEN translated THEN upper(t) ELSE t END AS text FROM (
  SELECT conv_id, turn, turn // 3 AS batch, t, share > 0 AND share >= 0.5 AND turn % 3 <> 2 AS translated FROM (
    SELECT conv_id, turn, 'line ' || turn AS t, avg(CASE WHEN turn % 3 <> 2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY conv_id, turn // 3) AS share FROM conversations))""")
def translation_batches(spark: SparkSession, folder: str) -> DataFrame:
    source = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("line "), F.col("turn").cast("string")).alias("text"))
    source = cues.batches(source, ["conv_id"], "turn", 3)
    line = F.concat(F.col("turn").cast("string"), F.lit(". "), F.upper("text"))
    replies = source.where("turn % 3 <> 2").groupBy("conv_id", "batch").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("reply"))
    replies = replies.select("conv_id", "batch", F.inline(cues.numbered_reply(F.col("reply")))).select("conv_id", "batch", F.col("number").cast("long").alias("turn"), "text")
    return cues.translated(source, replies, ["conv_id", "batch"], "turn").select("conv_id", "turn", "batch", "translated", "text")


_LANG = {0: "eng", 1: "jpn", 2: "fre", 3: "und"}
_CODEC = {0: "truehd", 1: "dts", 2: "aac", 3: "flac"}
_RANKED = f"""(SELECT *, {sql_map(_LANG, 'lang', 'eng')} AS language, codec IN (0, 3) OR (codec = 1 AND rate > 1500000) AS lossless FROM (
  SELECT l_orderkey, pos, l_partkey % 4 AS lang, l_suppkey % 4 AS codec, l_linenumber AS ch, CAST(l_quantity * 100000 AS BIGINT) AS rate FROM {_L}))"""


def _audio(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda values, key: F.get(F.array(*[F.lit(v) for v in values.values()]), (key % 4).cast("int"))
    track = F.struct("pos", F.col("pos").alias("idx"), pick(_LANG, F.col("l_partkey")).alias("lang"), pick(_CODEC, F.col("l_suppkey")).alias("codec"), F.col("l_linenumber").alias("ch"), (F.col("l_quantity") * 100000).cast("long").alias("bit_rate"), F.lit(False).alias("aux"))
    return _lines(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(track)).alias("tracks"))


@query(f"""
SELECT l_orderkey, idx FROM (SELECT l_orderkey, pos AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY lossless DESC, tier DESC, ch DESC, rate DESC, pos) AS k FROM (
  SELECT *, CASE WHEN lossless THEN {sql_map({0: 3, 1: 1, 3: 2}, 'codec', 0)} ELSE 0 END AS tier, max(ch) OVER (PARTITION BY l_orderkey) AS widest FROM {_RANKED} WHERE language = 'eng') WHERE widest <= 2 OR ch > 2) WHERE k = 1""")
def best_per_group(spark: SparkSession, folder: str) -> DataFrame:
    best = tracks.best_audio(F.col("tracks"), tracks.ENGLISH)
    return _audio(spark, folder).select("l_orderkey", best["idx"].alias("idx")).where("idx is not null")


@query(f"""
SELECT l_orderkey, coalesce(min(pos) FILTER (language = 'eng'), min(pos) FILTER (language = 'jpn'), 0) AS idx,
  CASE WHEN bool_or(language = 'eng') THEN 'eng' WHEN bool_or(language = 'jpn') THEN 'jpn_fallback' ELSE 'first_track_no_eng_no_jpn' END AS reason FROM {_RANKED} GROUP BY l_orderkey""")
def picked_audio(spark: SparkSession, folder: str) -> DataFrame:
    rows = _audio(spark, folder).select("l_orderkey", tracks.picked_audio(F.col("tracks")).alias("p"))
    return rows.select("l_orderkey", F.col("p.track.idx").alias("idx"), "p.reason")


@query(f"""
WITH p AS (SELECT l_orderkey, coalesce(min(pos) FILTER (language = 'eng'), min(pos) FILTER (language = 'jpn'), 0) AS picked FROM {_RANKED} GROUP BY l_orderkey),
r AS (SELECT *, CASE language WHEN 'eng' THEN 0 WHEN 'jpn' THEN 1 ELSE 2 END AS a FROM {_RANKED} JOIN p USING (l_orderkey))
SELECT l_orderkey, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY a, a = 2 AND pos <> picked, pos) AS ids, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY a, a = 2 AND pos <> picked, pos) FILTER (language IN ('jpn', 'fre')), CAST(any_value(picked) AS VARCHAR)) AS wanted FROM r GROUP BY l_orderkey""")
def track_order(spark: SparkSession, folder: str) -> DataFrame:
    picked = tracks.picked_audio(F.col("tracks"))["track"]
    ordered = tracks.audio_in_order(F.col("tracks"), picked, [])
    wanted = tracks.audio_in_order(F.col("tracks"), picked, ["JPN", "fre"])
    ids = lambda found: F.array_join(F.transform(found, lambda t: t["idx"].cast("string")), ",")
    return _audio(spark, folder).select("l_orderkey", ids(ordered).alias("ids"), ids(wanted).alias("wanted"))


@query(f"""
SELECT l_orderkey, pos, CASE WHEN n = 1 THEN base ELSE base || ' (' || fmt || ' ' || k || ')' END AS name FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, base) AS n, row_number() OVER (PARTITION BY l_orderkey, base ORDER BY pos) AS k FROM (
    SELECT l_orderkey, pos, {sql_map({0: 'English', 1: 'Japanese', 2: 'French', 3: 'Xyz'}, 'l_partkey % 4', 'English')} || CASE WHEN l_returnflag = 'R' THEN ' (Forced)' WHEN l_returnflag = 'A' THEN ' (SDH)' ELSE '' END AS base, CASE WHEN l_suppkey % 2 = 0 THEN 'PGS' ELSE 'SRT' END AS fmt FROM {_L}))""")
def subtitle_names(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.get(F.array(*map(F.lit, ["ENG", "jpn", "fre", "XYZ"])), (F.col("l_partkey") % 4).cast("int"))
    subs = _lines(spark, folder).select("l_orderkey", "pos", lang.alias("lang"), F.when(F.col("l_suppkey") % 2 == 0, "pgssub").otherwise("subrip").alias("codec"), (F.col("l_returnflag") == "R").alias("forced"), (F.col("l_returnflag") == "A").alias("sdh"), F.lit("").alias("title"))
    return tracks.named_subtitles(subs, ["l_orderkey"]).select("l_orderkey", "pos", "name")


_GAINS = [("stereo", "pan=stereo|FL=1.000*FL|FR=1.000*FR"), ("5.1", "pan=stereo|FL=1.000*FL+0.919*FC+0.350*LFE+0.566*BL|FR=1.000*FR+0.919*FC+0.350*LFE+0.566*BR"), ("mono", "pan=stereo|FL=0.919*FC|FR=0.919*FC")]


@query("SELECT p_partkey, " + sql_map(dict(enumerate(x[1] for x in _GAINS)), "p_partkey % 4", "-") + " AS pan FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 3")
def downmix(spark: SparkSession, folder: str) -> DataFrame:
    layout = F.get(F.array(*[F.lit(x[0]) for x in _GAINS], F.lit("strange")), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, folder, "part").select("p_partkey", tracks.downmix(layout).alias("pan"))


@query(r"""
SELECT p_partkey, '<Tags><Tag><Targets><TargetTypeValue>50</TargetTypeValue></Targets><Simple><Name>TITLE</Name><String>' || p_type || ' &lt;&amp;&gt;</String></Simple></Tag>' ||
  CASE WHEN p_partkey % 2 = 0 THEN '<Tag><Targets><TargetTypeValue>50</TargetTypeValue></Targets><Simple><Name>BRAND</Name><String>' || p_brand || '</String></Simple></Tag>' ELSE '' END || '</Tags>' AS xml FROM part""")
def xml_tags(spark: SparkSession, folder: str) -> DataFrame:
    level = lambda name, value: F.struct(F.lit(50).alias("level"), F.lit(name).alias("name"), value.alias("value"))
    levels = F.array(level("TITLE", F.concat("p_type", F.lit(" <&>"))), level("BRAND", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")))
    return table(spark, folder, "part").select("p_partkey", sinks.xml_tags(levels).alias("xml"))


@query(r"""
WITH RECURSIVE w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words FROM conversations),
l AS (SELECT conv_id, turn, 1 AS i, '' AS done, coalesce(words[1], '') AS line FROM w
  UNION ALL SELECT l.conv_id, l.turn, i + 1, CASE WHEN length(line) + 1 + length(words[i + 1]) <= 64 THEN done ELSE done || line || chr(10) END, CASE WHEN length(line) + 1 + length(words[i + 1]) <= 64 THEN line || ' ' || words[i + 1] ELSE words[i + 1] END FROM l JOIN w ON l.conv_id = w.conv_id AND l.turn = w.turn WHERE i < len(words)),
e AS (SELECT conv_id, turn, arg_max(done || line, i) AS synopsis FROM l GROUP BY ALL)
SELECT conv_id, turn, sha256(concat_ws(chr(10) || chr(10), role, '[identification]' || chr(10) || 'id ' || conv_id, CASE WHEN synopsis <> '' THEN '[synopsis]' || chr(10) || synopsis END)) AS sheet FROM w JOIN e USING (conv_id, turn)""")
def info_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets of conversation turns with wrapped text, as digests."""
    rows = table(spark, folder, "conversations")
    sheet = sinks.info_sheet(F.col("role"), F.concat(F.lit("id "), F.col("conv_id").cast("string")), F.lit(None).cast("string"), F.col("text"))
    return rows.select("conv_id", "turn", F.sha2(sheet.cast("binary"), 256).alias("sheet"))


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS packets, max(CASE WHEN (d <= 180 OR pts >= d - 120) AND pts > 0 THEN pts + 1.5 END) AS last_end FROM (
  SELECT l_orderkey, l_extendedprice AS pts, max(l_extendedprice) OVER (PARTITION BY l_orderkey) + 10 AS d FROM lineitem) GROUP BY l_orderkey""")
def last_packets(spark: SparkSession, folder: str) -> DataFrame:
    duration = F.max("l_extendedprice").over(W.partitionBy("l_orderkey")) + 10
    packets = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("pts"), F.lit(1.5).alias("length"), duration.alias("d"))
    return tables.last_packet(packets, ["l_orderkey"], "d")


@query("""
SELECT l_orderkey, max(CASE WHEN (d <= 180 OR pts >= d - 120) AND pts > 0 THEN pts + 1.5 END) AS last_end FROM (
  SELECT l_orderkey, l_extendedprice AS pts, max(l_extendedprice) OVER (PARTITION BY l_orderkey) + 10 AS d FROM lineitem) GROUP BY l_orderkey""")
def last_packets_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same ends from packets stored by time: only the folders of files' last minutes are opened."""
    at = shared_place(spark, "packets")
    packets = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("pts"), F.lit(1.5).alias("length"))
    tables.store_packets(packets, at)
    durations = packets.groupBy("l_orderkey").agg((F.max("pts") + 10).alias("d"))
    return tables.last_packet_stored(spark.read.parquet(at), durations, ["l_orderkey"], "d")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 400 AS VARCHAR) || ':' || CAST(event_id % 100 AS VARCHAR) END AS crop, CAST(event_id % 7 + 1 AS INT) AS file, CAST(event_id % 100 AS DOUBLE) AS percent FROM events""")
def scraped_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The last match in a tool's output, and a log line read."""
    key = F.col("event_id")
    out = F.when(key % 3 == 0, "nothing").otherwise(F.concat(F.lit("crop=1:1\ncrop="), (key % 400).cast("string"), F.lit(":"), (key % 100).cast("string"), F.lit("\nend")))
    line = F.format_string("file %d/9 encoding %d%% speed=1.5x", key % 7 + 1, key % 100)
    rows = table(spark, folder, "events").select("event_id", tables.last_match(out, r"crop=(\d+:\d+)").alias("crop"), log_events(line).alias("e"))
    return rows.select("event_id", "crop", "e.file", "e.percent")


@query("SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event and the count of each user, kept by a stream and read from its last output."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").select("user_id", F.struct(seconds().alias("t"), "event_id").alias("k"))
    kept = stream.groupBy("user_id").agg(F.max("k").alias("k"), F.count("*").alias("n")).select("user_id", F.col("k.event_id").alias("event_id"), "n")
    at = shared_place(spark, "journal")

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    kept.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(f"{at}/out")
    return log.groupBy("user_id").agg(F.max_by(F.struct("event_id", "n"), "batch").alias("r")).select("user_id", "r.event_id", "r.n")
