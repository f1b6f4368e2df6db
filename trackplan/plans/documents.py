"""Queries over settings and documents for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settings
from ..sources import sheets
from ..sources.tables import table
from .catalog import query, sql_map

_NUMBERS = ["12", " 70 ", "-7", "0.5", "1e9", "abc", None]
_CHOICES = [" AUTO ", "off", "cuda", "copy", "", "x", "openai", None]
_FORMS = ["2160p", "720", "8:2:8", "Eng, ,JPN", "-3.9", None]
_RULES_SQL = ", ".join(str(r) for r in settings.NUMBERS)
_ALLOWED_SQL = ", ".join(f"('{k}', {allowed})" for k, allowed in settings.CHOICES)


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values: list, place):
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def _same_for_all(keys: list[str], text):
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array_repeat(text, len(keys)))


@query(rf"""
WITH g AS (SELECT c_custkey, ({_sql_list(_NUMBERS)})[c_custkey % {len(_NUMBERS)} + 1] AS t FROM customer),
r(key, kind, low, high, std) AS (VALUES {_RULES_SQL}),
n AS (SELECT *, CASE WHEN kind = 'float' AND t <> 'abc' OR kind = 'int' AND NOT contains(t, '.') AND NOT contains(t, 'e') AND t <> 'abc' THEN CAST(trim(t) AS DOUBLE) END AS x, CASE WHEN key IN ('gpu_max_pct', 'cpu_max_pct') THEN least(high, 98) ELSE high END AS most FROM g, r)
SELECT c_custkey, key, CAST(CASE WHEN x IS NULL THEN std WHEN x < low THEN low WHEN x > most THEN most ELSE x END AS DOUBLE) AS value,
  CASE WHEN t IS NULL THEN 'default' WHEN x IS NULL THEN 'unreadable' WHEN x BETWEEN low AND most THEN 'set' ELSE 'limited' END AS outcome FROM n""")
def settings_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """All settings that are numbers, for customers that give the same text to each."""
    text = _pick(_NUMBERS, F.col("c_custkey") % len(_NUMBERS))
    return settings.numbers(table(spark, folder, "customer"), ["c_custkey"], _same_for_all([r[0] for r in settings.NUMBERS], text))


@query(f"""
SELECT c_custkey, key, CASE WHEN list_contains(allowed, lower(trim(t))) THEN lower(trim(t)) ELSE allowed[1] END AS value, CASE WHEN coalesce(trim(t), '') = '' THEN 'default' WHEN list_contains(allowed, lower(trim(t))) THEN 'set' ELSE 'unknown' END AS outcome
FROM (SELECT c_custkey, ({_sql_list(_CHOICES)})[c_custkey % {len(_CHOICES)} + 1] AS t FROM customer), (VALUES {_ALLOWED_SQL}) r(key, allowed)""")
def settings_choices(spark: SparkSession, folder: str) -> DataFrame:
    text = _pick(_CHOICES, F.col("c_custkey") % len(_CHOICES))
    return settings.choices(table(spark, folder, "customer"), ["c_custkey"], _same_for_all([k for k, _ in settings.CHOICES], text))


@query(f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 2160 ELSE 1080 END AS height, CASE p_partkey % 6 WHEN 0 THEN '2160p' WHEN 1 THEN '720' WHEN 2 THEN '8:2:8' WHEN 3 THEN 'eng/jpn' WHEN 4 THEN '-3.9' END AS names,
  CASE p_partkey % 6 WHEN 2 THEN '8:2:8' ELSE '4:4:4' END AS threads, CAST(CASE p_partkey % 6 WHEN 1 THEN 720 WHEN 4 THEN 0 ELSE 420 END AS BIGINT) AS stall, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE true END AS kept, p_size % 2 = 1 AS denoise FROM part""")
def settings_forms(spark: SparkSession, folder: str) -> DataFrame:
    text = _pick(_FORMS, F.col("p_partkey") % 6)
    on = settings.switches(F.create_map(F.lit("audio_keep_all"), text, F.lit("audio_denoise"), F.when(F.col("p_size") % 2 == 1, "Yes").otherwise("OFF")), ["audio_keep_all", "audio_denoise", "subs_generate"])
    rows = table(spark, folder, "part").select("p_partkey", text.alias("t"), on.alias("on"))
    return rows.select("p_partkey", settings.target_height(F.col("t")).alias("height"), F.array_join(settings.name_list(F.col("t")), "/").alias("names"), settings.tile_threads(F.col("t")).alias("threads"), settings.stall_seconds(F.col("t")).alias("stall"), F.col("on")["audio_keep_all"].alias("kept"), F.col("on")["audio_denoise"].alias("denoise"))


@query(r"""
WITH p AS (SELECT *, p_partkey % 5 <> 0 AS found, p_partkey % 3 = 2 AS episode, p_size % 4 AS v, p_size % 2 = 0 AS even, p_partkey % 7 = 0 AS finished FROM part)
SELECT p_partkey, concat_ws(chr(10), repeat('=', 66), 'out.mkv', repeat('=', 66), chr(10) || 'IDENTIFICATION', '--------------',
  CASE WHEN NOT found THEN 'no match; the fields below describe the file only' || chr(10) || 'parsed title     : ' || p_name ELSE concat_ws(chr(10), 'title            : ' || p_name, CASE WHEN even THEN 'original title   : ' || p_brand END, 'year             : 19' || (p_size + 10),
    CASE WHEN episode THEN 'season / episode : S01E' || printf('%02d', p_size) || chr(10) || 'episode title    : Pilot' END, 'database id      : ' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'imdb id          : tt1' END, CASE WHEN p_size % 3 > 0 THEN 'runtime          : ' || p_size % 3 * 50 || ' min' END,
    CASE WHEN even THEN 'genres           : A, B' END, 'language         : en', CASE WHEN p_partkey % 4 = 0 THEN 'franchise        : X' END, 'director         : ' || p_type, CASE WHEN p_partkey % 3 = 1 THEN 'cast             : P' || chr(10) || '                   Q' END, 'studio           : S1, S2, S3',
    CASE WHEN p_size % 5 > 0 THEN 'rating           : ' || printf('%.1f', p_size % 5 * 0.5) || ' from ' || p_size || ' votes' END, CASE WHEN even THEN chr(10) || 'synopsis:' || chr(10) || '  ' || repeat('ab ', 20) || 'ab' || chr(10) || '  ' || repeat('ab ', 18) || 'ab' END) END,
  chr(10) || 'VERIFICATION', '------------', CASE WHEN found THEN 'match confidence : high' || chr(10) || 'runtime check    : agrees' END, 'visual check     : ' || (['not_checked', 'match', 'no_reference_images', 'unverified'])[v + 1],
  CASE WHEN v % 2 = 1 THEN concat_ws(chr(10), '  closest frame  : ' || CASE v WHEN 1 THEN 5 ELSE 20 END || ' of 64 bits differ (12 or fewer is a match)', '  matched on     : ' || CASE v WHEN 1 THEN 'dhash at 12s into the film' ELSE '?' END, '  compared       : 30 frames' || CASE v WHEN 1 THEN ' (one every 20s)' ELSE '' END || ' against 3 reference images', CASE v WHEN 1 THEN '  reference      : i.jpg' END) END,
  CASE v WHEN 2 THEN '  note           : no usable image for this title, so nothing' || chr(10) || '                   to compare with; not a failed match.' WHEN 3 THEN '  note           : no close match. Reference pictures need not be' || chr(10) || '                   frames of the film; this does not contradict' || chr(10) || '                   the identification.' END,
  CASE WHEN finished THEN chr(10) || 'THIS FILE AS IT STANDS' || chr(10) || '----------------------' || chr(10) || 'file             : out.mkv' || chr(10) || 'originally       : ' || p_name || chr(10) || 'note             : measured from the finished file' ELSE chr(10) || 'SOURCE' || chr(10) || '------' || chr(10) || 'file             : ' || p_name END,
  'codec            : h264 640x480 23.976 fps 8-bit', 'colour           : ' || CASE WHEN even THEN 'hdr10' ELSE 'sdr' END, CASE WHEN p_size % 3 > 0 THEN printf('duration         : %d min %02d s', p_size % 3 * 65 // 60, p_size % 3 * 65 % 60) END, 'audio tracks     : 2', 'subtitle tracks  : 0',
  chr(10) || 'PROCESSING', '----------', 'video            : AV1 sdr, cq ' || p_size, 'filters          : ' || CASE WHEN even THEN 'crop' ELSE 'none' END, CASE WHEN even THEN 'decisions        : one' || chr(10) || '                   two' END, '') AS sheet FROM p""")
def full_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets of parts in which every line is there for some and absent for others."""
    key, size = F.col("p_partkey"), F.col("p_size")
    even, verdict = size % 2 == 0, size % 4
    texts = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    named = lambda **fields: F.struct(*[(c if hasattr(c, "alias") else F.lit(c)).alias(n) for n, c in fields.items()])
    found = named(title=F.col("p_name"), original_title=F.when(even, F.col("p_brand")).otherwise(F.col("p_name")), date=F.concat(F.lit("19"), (size + 10).cast("string"), F.lit("-01-01")), id=key, imdb_id=F.when(key % 3 == 0, "tt1"), runtime=size % 3 * 50, genres=F.when(even, texts("A", "B")).otherwise(texts()), language="en", franchise=F.when(key % 4 == 0, "X"), directors=F.array("p_type"), writers=texts(), composers=F.lit(None).cast("array<string>"), cast=F.when(key % 3 == 1, texts("P", "Q")).otherwise(texts()), studios=texts("S1", "S2", "S3", "S4"), rating=size % 5 * 0.5, votes=size, synopsis=F.when(even, "ab " * 40), episode_title="Pilot", air_date=F.lit(None).cast("string"), confidence="high", runtime_note="agrees")
    seen = named(verdict=F.when(verdict == 1, "match").when(verdict == 2, "no_reference_images").otherwise("unverified"), distance=F.when(verdict == 1, 5).when(verdict == 3, 20), how=F.when(verdict == 1, "dhash"), matched_at=F.when(verdict == 1, 12), frames=30, every=F.when(verdict == 1, 20), images=3, image=F.when(verdict == 1, "i.jpg"))
    info = named(codec="h264", w=640, h=480, fps=23.976, depth=8, hdr=F.when(even, "hdr10"), dur=size % 3 * 65.0, audios=2, subs=F.lit(None).cast("int"))
    plan = named(space="sdr", cq=size, filters=F.when(even, "crop").otherwise(""), notes=F.when(even, texts("one", "two")).otherwise(texts()))
    parsed = named(title=F.col("p_name"), season=1, episode=F.when(key % 3 == 2, size))
    sheet = sheets.full_sheet(F.lit("out.mkv"), F.when(key % 5 != 0, found), parsed, F.when(verdict != 0, seen), info, plan, F.col("p_name"), key % 7 != 0)
    return table(spark, folder, "part").select("p_partkey", sheet.alias("sheet"))


_STAGES = ["probe", "encode", "elsewhere"]


@query(f"""
SELECT o_orderkey, 'failed' AS status, stage, repeat('=', 70) || chr(10) || 'failure diagnostic' || chr(10) || 'file: ' || o_orderkey || chr(10) || 'stage: ' || stage || chr(10) || 'time: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || chr(10) || 'SUGGESTED FIX: ' || {sql_map(sheets.ADVICE, "stage", "See details below.")} || chr(10)
  || CASE WHEN stage <> 'probe' THEN chr(10) || 'PROBE:' || chr(10) || '{{"w":640,"status":"' || o_orderstatus || '"}}' ELSE '' END
  || CASE WHEN stage = 'encode' THEN chr(10) || chr(10) || 'ATTEMPT cq=23 variant=a rc=1' || chr(10) || 'CMD: run' || chr(10) || '  | x' || chr(10) || '  | y' || chr(10) || chr(10) || 'ATTEMPT cq=25 variant=b rc=2' || chr(10) || 'CMD: ' ELSE '' END
  || CASE WHEN stage <> 'probe' THEN chr(10) || chr(10) || 'PROVENANCE LEDGER:' || chr(10) || '  stage               video  audio tracks' || chr(10) || '  ' || rpad('source', 14, ' ') || ' ' || lpad('10.5', 9, ' ') || 's  10.5, 9.0' || chr(10) || '  ' || rpad('encoded', 14, ' ') || ' ' || lpad('0.0', 9, ' ') || 's  none' ELSE '' END AS document
FROM (SELECT *, ({_sql_list(_STAGES)})[o_custkey % 3 + 1] AS stage FROM orders)""")
def failure_documents(spark: SparkSession, folder: str) -> DataFrame:
    stage = _pick(_STAGES, F.col("o_custkey") % 3)
    row = lambda **fields: F.struct(*[F.lit(v).alias(n) if not hasattr(v, "alias") else v.alias(n) for n, v in fields.items()])
    numbers = lambda *values: F.array(*map(F.lit, values)).cast("array<double>")
    tail = lambda *values: F.array(*map(F.lit, values)).cast("array<string>")
    attempts = F.array(row(cq=23, variant="a", rc=1, cmd="run", tail=tail("x", "y")), row(cq=25, variant="b", rc=2, cmd=F.lit(None).cast("string"), tail=tail()))
    ledger = F.array(row(stage="source", video=numbers(10.5), audio=numbers(10.5, 9.0)), row(stage="encoded", video=numbers(), audio=numbers()))
    probe = F.when(stage != "probe", row(w=640, status=F.col("o_orderstatus")))
    document = sheets.failure_document(F.col("o_orderkey").cast("string"), stage, F.date_format("o_orderdate", "yyyy-MM-dd"), {"PROBE": probe}, F.when(stage == "encode", attempts), F.when(stage != "probe", ledger))
    rows = table(spark, folder, "orders").select("o_orderkey", stage.alias("stage"), document.alias("document"))
    return sheets.failed_rows(rows, "o_orderkey", "stage", "document")
