"""Queries over queues, state, rectangles and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import matching, planning, queue, rectangles
from ..sources import tables
from ..sources.tables import table
from .catalog import query, sql_map

_CODECS = [*N.CODEC_FACTOR, "unheard"]
_TIER = "CASE WHEN q >= 0.090 THEN 'high' WHEN q >= 0.045 THEN 'mid' WHEN q >= 0.022 THEN 'low' ELSE 'awful' END"


@query(f"""
SELECT tier, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT {_TIER} AS tier FROM (SELECT l_extendedprice / greatest(1.0, l_quantity * 36000) * {sql_map({k: N.CODEC_FACTOR.get(c, N.OTHER_CODEC_FACTOR) for k, c in enumerate(_CODECS)}, f'l_partkey % {len(_CODECS)}', 1.0)} AS q FROM lineitem))
GROUP BY tier""")
def quality_tier(spark: SparkSession, folder: str) -> DataFrame:
    codec = F.get(F.array(*map(F.lit, _CODECS)), (F.col("l_partkey") % len(_CODECS)).cast("int"))
    q = N.bits_per_pixel(F.col("l_extendedprice"), F.col("l_quantity") * 36000) * N.lookup(N.CODEC_FACTOR, codec, N.OTHER_CODEC_FACTOR)
    return queue.tally(table(spark, folder, "lineitem"), N.quality_tier(q).alias("tier"))


_PATH_SQL = "'d/' || doc_id || '.' || (" + str(queue.EXTENSIONS) + ")[doc_id % 20 + 1]"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*map(F.lit, queue.EXTENSIONS))
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), F.get(names, (F.col("doc_id") % 20).cast("int"))))


@query(f"""
SELECT doc_id, path, size, container_rank FROM (
  SELECT doc_id, {_PATH_SQL} AS path, n_chars AS size, CAST({sql_map(queue.CONTAINER_RANK, f"({queue.EXTENSIONS})[doc_id % 20 + 1]", 50)} AS INT) AS container_rank FROM documents WHERE n_chars >= 500)
ORDER BY size DESC, container_rank, doc_id LIMIT 100""")
def queue_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred of the queue: a top-k."""
    files = queue.scannable(_files(spark, folder), size="n_chars", least=500).select("doc_id", "path", F.col("n_chars").alias("size"), queue.container_rank(F.col("path")).alias("container_rank"))
    return queue.ordered(files, F.col("size"), F.col("container_rank"), F.col("doc_id"), F.col("doc_id"), limit=100)


@query("""
SELECT p_partkey, CAST(count(*) OVER (PARTITION BY lower(p_type)) AS BIGINT) AS clash_size,
  CASE WHEN count(*) OVER (PARTITION BY lower(p_type)) > 1 THEN p_type || '.' || lower(p_brand) ELSE p_type END AS out_name FROM part""")
def name_clash(spark: SparkSession, folder: str) -> DataFrame:
    rows = queue.with_clashes(table(spark, folder, "part"), F.col("p_type"))
    name = F.when(F.col("clash_size") > 1, F.concat("p_type", F.lit("."), F.lower("p_brand"))).otherwise(F.col("p_type"))
    return rows.select("p_partkey", F.col("clash_size").cast("long"), name.alias("out_name"))


@query("""
SELECT user_id, value, hits, round(hits / total, 6) AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, value) AS k, CAST(sum(hits) OVER (PARTITION BY user_id) AS DOUBLE) AS total FROM (
    SELECT user_id, CAST(floor(value / 2) * 2 AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY ALL)) WHERE k = 1""")
def dominant_mode(spark: SparkSession, folder: str) -> DataFrame:
    return rectangles.mode(table(spark, folder, "events"), ["user_id"], ["value"]).withColumn("share", F.round("share", 6))


@query("""
SELECT p_brand, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (
  SELECT *, NOT ((w >= fw - 8 AND h >= fh - 8) OR w < 64 OR h < 64) AS ok FROM (
    SELECT p_brand, fw, fh, x, y, least(fw - x, CAST(floor((r - x + 1) / 2) * 2 AS BIGINT)) AS w, least(fh - y, CAST(floor((b - y + 1) / 2) * 2 AS BIGINT)) AS h FROM (
      SELECT p_brand, CASE WHEN p_brand < 'Brand#3' THEN 160 ELSE 100 END AS fw, CASE WHEN p_brand < 'Brand#2' THEN 400 ELSE 150 END AS fh, CAST(floor(min(p_size) / 2) * 2 AS BIGINT) AS x, CAST(floor(min(p_partkey % 97) / 2) * 2 AS BIGINT) AS y,
        max(p_size + 100 + p_partkey % 7) AS r, max(p_partkey % 97 + 50 + p_size) AS b FROM part GROUP BY p_brand)))""")
def union_box(spark: SparkSession, folder: str) -> DataFrame:
    key, brand = F.col("p_partkey"), F.col("p_brand")
    rects = table(spark, folder, "part").select("p_brand", F.when(brand < "Brand#3", 160).otherwise(100).alias("fw"), F.when(brand < "Brand#2", 400).otherwise(150).alias("fh"), (F.lit(100) + key % 7).alias("w"), (F.lit(50) + F.col("p_size")).alias("h"), F.col("p_size").alias("x"), (key % 97).alias("y"))
    return rectangles.bounding(rects, ["p_brand"], "fw", "fh")


@query("""
WITH r AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'A' THEN 1800 + 20 * (l_partkey % 3) END AS w, CASE WHEN l_returnflag <> 'A' THEN CASE WHEN l_suppkey % 9 = 0 THEN 40 ELSE 800 + l_suppkey % 2 END END AS h FROM lineitem),
n AS (SELECT l_orderkey, CAST(count(w) AS BIGINT) AS reads FROM r GROUP BY l_orderkey),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY hits DESC, w, h) AS k, hits / sum(hits) OVER (PARTITION BY l_orderkey) AS share FROM (SELECT l_orderkey, CAST(w // 2 * 2 AS BIGINT) AS w, CAST(h // 2 * 2 AS BIGINT) AS h, count(*) AS hits FROM r WHERE w IS NOT NULL GROUP BY ALL))
SELECT l_orderkey, reads, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h, round(share, 6) AS share FROM (
  SELECT n.l_orderkey, reads, w, h, share, coalesce(reads >= 3 AND 20 + w <= 1850 AND 100 + h <= 1080 AND w * h >= 1850 * 1080 // 4 AND NOT (1850 - w < 8 AND 1080 - h < 8), false) AS ok FROM n LEFT JOIN m ON n.l_orderkey = m.l_orderkey AND k = 1)""")
def crop_quorum(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles of an order's lines: a crop only where three or more of six windows gave one, and it is usable."""
    read = F.col("l_returnflag") != "A"
    h = F.when(F.col("l_suppkey") % 9 == 0, 40).otherwise(800 + F.col("l_suppkey") % 2)
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.lit(1850).alias("fw"), F.lit(1080).alias("fh"), F.lit(6).alias("windows"), F.when(read, 1800 + 20 * (F.col("l_partkey") % 3)).alias("w"), F.when(read, h).alias("h"), F.when(read, 20).alias("x"), F.when(read, 100).alias("y"))
    return rectangles.crop_of(rows, ["l_orderkey"], "fw", "fh", "windows").select("l_orderkey", "reads", "w", "h", F.round("share", 6).alias("share"))


@query("""
SELECT user_id, combed, determined, round(share, 3) AS share,
  CASE o WHEN 0 THEN share > 0.10 WHEN 1 THEN false ELSE share > 0.45 AND combed >= 50 AND h IN (480, 486, 540, 576, 1080) END AS interlaced,
  CASE WHEN o = 0 AND share <= 0.10 THEN 'flagged interlaced, measured progressive' WHEN o = 1 AND share > 0.30 THEN 'flagged progressive, measured combing'
    WHEN o = 2 AND NOT (share > 0.45 AND combed >= 50 AND h IN (480, 486, 540, 576, 1080)) AND share > 0.30 THEN 'combing measured, not trusted' END AS note
FROM (SELECT *, CASE WHEN determined = 0 THEN 0.0 ELSE combed / determined END AS share FROM (
  SELECT user_id, user_id % 3 AS o, CASE WHEN user_id % 2 = 0 THEN 480 ELSE 240 END AS h,
    CAST(count(*) FILTER (event_type IN ('click', 'view')) AS BIGINT) AS combed, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS determined FROM events GROUP BY user_id))""")
def interlace_share(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type").isin("click", "view"), 1)).alias("combed"), F.count(F.when(F.col("event_type") != "error", 1)).alias("determined"))
    share = F.round(F.coalesce(F.try_divide("combed", "determined"), F.lit(0.0)), 3)
    order = F.when(F.col("user_id") % 3 == 0, "tt").when(F.col("user_id") % 3 == 1, "progressive").otherwise("")
    height = F.when(F.col("user_id") % 2 == 0, 480).otherwise(240)
    found = N.interlace_decision(order, F.col("combed"), F.col("determined"), height)
    return counts.select("user_id", "combed", "determined", share.alias("share"), found["interlaced"].alias("interlaced"), found["note"].alias("note"))


_LATEST = "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


@query(_LATEST)
def journal_latest(spark: SparkSession, folder: str) -> DataFrame:
    return queue.latest(_log(spark, folder), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"""
SELECT c_custkey, CASE WHEN s = 'F' AND c_acctbal > 0 THEN 'skip_done' WHEN s = 'P' THEN 'skip_failed' ELSE 'process' END AS disposition
FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus AS s FROM ({_LATEST})) ON c_custkey = o_custkey""")
def resume_queue(spark: SparkSession, folder: str) -> DataFrame:
    last = queue.latest(_log(spark, folder), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    rows = table(spark, folder, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("planned")
    return rows.select("c_custkey", queue.disposition(status, F.col("c_acctbal") > 0).alias("disposition"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM ({_LATEST}) WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def remaining_queue(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).withColumnRenamed("o_custkey", "c_custkey")
    return queue.remaining(table(spark, folder, "customer").select("c_custkey", "c_name"), log, "c_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest FROM orders GROUP BY o_orderstatus")
def outcome_tally(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest"))


@query("""
SELECT p_partkey, cq, round(budget, 6) AS budget, CASE WHEN budget <= 0 OR cq >= 32 THEN cq ELSE least(32, greatest(cq, CAST(ceil(27 - 4.5 * ln(budget * 1e6 / (0.1157 * px)) / ln(2)) AS INT))) END AS fitted FROM (
  SELECT p_partkey, CAST(20 + p_size % 15 AS INT) AS cq, 8294400.0 * 24 AS px, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE greatest(0.5, CASE WHEN p_partkey % 3 = 0 THEN 10737418240.0 ELSE least(p_retailprice * 1e7, 10737418240.0) END * 8 / (3000 + p_partkey % 5000) / 1e6 - 2.5) END AS budget FROM part)""")
def budget_fit(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    budget = N.budget_mbps(F.col("p_retailprice") * 1e7, F.when(key % 11 == 0, 0).otherwise(F.lit(3000) + key % 5000), key % 3 != 0)
    rows = table(spark, folder, "part").select("p_partkey", (F.lit(20) + F.col("p_size") % 15).cast("int").alias("cq"), budget.alias("b"))
    return rows.select("p_partkey", "cq", F.round("b", 6).alias("budget"), N.fitting_cq(F.col("cq"), F.lit(8294400.0 * 24), F.col("b")).cast("int").alias("fitted"))


@query("SELECT p_partkey, CAST(attempt AS INT) AS attempt, CAST(10 + p_size % 15 - 2 * attempt AS INT) AS q FROM part, range(3) t(attempt) WHERE 10 + p_size % 15 - 2 * attempt >= 10")
def cq_ladder(spark: SparkSession, folder: str) -> DataFrame:
    start = (F.lit(10) + F.col("p_size") % 15).cast("int")
    return table(spark, folder, "part").select("p_partkey", F.posexplode(planning.ladder(start)).alias("attempt", "q"))


_BANDS = [(1, 9, "small"), (10, 24, "middle"), (25, 39, "large")]


@query("SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'small' WHEN p_size BETWEEN 10 AND 24 THEN 'middle' WHEN p_size BETWEEN 25 AND 39 THEN 'large' END AS label FROM part")
def range_class(spark: SparkSession, folder: str) -> DataFrame:
    return matching.in_ranges(table(spark, folder, "part").select("p_partkey", "p_size"), matching.ranges_table(spark, _BANDS), F.col("p_size"))


_BOARDS = ["NVIDIA GeForce RTX 5060 Ti", "NVIDIA GeForce RTX 4090", "NVIDIA GeForce RTX 3080", "GeForce GTX 1660", "GTX 1080 Ti", "NVIDIA RTX A4000", "NVIDIA L40S", "RTX 4000 Ada Generation", "NVIDIA A100-SXM4", "Tesla T4", "Quadro RTX 5000", "TITAN RTX", "Radeon 7900", "Board 4090", ""]
_GENERATION_SQL = " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{c}'" for a, b, c, _ in matching.GENERATIONS)


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(low, 'rtx a[0-9]{{3,4}}') THEN 'Ampere (professional RTX A series)' WHEN regexp_matches(low, '(^| )(l4|l40|l40s)($| )') OR contains(low, 'ada') THEN 'Ada Lovelace (professional)'
  WHEN regexp_matches(low, '(^| )(a100|a40|a30|a10|a16|a2)($| |-)') THEN 'Ampere (professional)' WHEN contains(low, ' t4') OR contains(low, 'titan rtx') OR contains(low, 'quadro') THEN 'Turing or older (professional)' {_GENERATION_SQL} ELSE '' END AS label,
  CASE WHEN contains(low, 'l40s') OR contains(low, 'ada') OR (n BETWEEN 4000 AND 5999 AND NOT regexp_matches(low, 'rtx a|quadro')) THEN true WHEN low IN ('radeon 7900', 'board 4090', '') THEN NULL ELSE false END AS encodes
FROM (SELECT p_partkey, low, TRY_CAST(regexp_extract(low, '(rtx|gtx) ([0-9]{{4}})', 2) AS INT) AS n FROM (SELECT p_partkey, lower(({_BOARDS})[p_partkey % {len(_BOARDS)} + 1]) AS low FROM part))""")
def board_generation(spark: SparkSession, folder: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _BOARDS)), (F.col("p_partkey") % len(_BOARDS)).cast("int"))
    return table(spark, folder, "part").select("p_partkey", matching.generation(name).alias("g")).select("p_partkey", "g.label", "g.encodes")


@query("""
SELECT o_orderkey, CASE WHEN m = 0 THEN 'runtime_unknown' WHEN abs(r - 0.96) <= 0.015 THEN 'runtime_pal_speedup' WHEN abs(r - 1.0417) <= 0.015 THEN 'runtime_pal_slowdown'
  WHEN abs(r - 1) <= 0.06 THEN 'runtime_match' ELSE 'runtime_off_by_' || CAST(trunc(abs((r - 1) * 100)) AS BIGINT) || '_pct' END AS note,
  m = 0 OR abs(r - 1) <= 0.06 AS ok
FROM (SELECT o_orderkey, o_custkey % 120 AS m, CAST(o_orderkey % 7000 + 1 AS DOUBLE) / nullif((o_custkey % 120) * 60.0, 0) AS r FROM orders)""")
def runtime_match(spark: SparkSession, folder: str) -> DataFrame:
    found = N.runtime_agrees(F.col("o_orderkey") % 7000 + 1, F.col("o_custkey") % 120)
    return table(spark, folder, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", "f.note", "f.ok")


@query("""
SELECT c_custkey, n_name AS name, score FROM (
  SELECT c_custkey, n_name, round(raw, 6) AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY round(raw, 6) DESC, n_nationkey) AS k FROM (
    SELECT c_custkey, b.n_name, b.n_nationkey, CASE WHEN g = 0 THEN 3.0 WHEN g = 1 THEN 1.0 ELSE -3.0 * g END + CASE WHEN a.n_name = b.n_name THEN 3.0 ELSE 0.0 END + least(2.0, greatest(c_acctbal, 0) / 100 / 50.0) AS raw
    FROM (SELECT c.*, n_name, n_regionkey FROM customer c JOIN nation ON c_nationkey = n_nationkey) a JOIN (SELECT * FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3) b USING (n_regionkey), LATERAL (SELECT abs(a.c_custkey % 25 - b.n_nationkey) AS g)))
WHERE k = 1""")
def candidate_score(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of a customer are the nations of its region: a few each."""
    nation = table(spark, folder, "nation")
    own = table(spark, folder, "customer").join(nation.select("n_nationkey", F.col("n_name").alias("title"), "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    found = nation.select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("position"))
    pairs = own.join(found, "n_regionkey")
    score = matching.candidate_score(F.col("c_custkey") % 25, F.col("n_nationkey"), F.col("title"), F.col("name"), F.greatest("c_acctbal", F.lit(0.0)) / 100)
    return matching.best_candidate(pairs.withColumn("score", F.round(score, 6)), ["c_custkey"], "score", "position", ["name"], first=3)


@query("""
SELECT o_orderkey, CASE WHEN NOT found THEN 'nothing matched' ELSE array_to_string(list_filter([
    CASE WHEN o_custkey % 4 = 1 THEN 'title differs' END, CASE WHEN o_custkey % 5 NOT IN (0, 4) THEN 'year differs' END, CASE WHEN o_custkey % 3 = 0 THEN 'runtime differs' END,
    CASE WHEN o_custkey % 5 = 4 AND o_custkey % 2 = 0 THEN 'no year to compare' END], lambda x: x IS NOT NULL), ';') END AS reasons
FROM (SELECT *, o_orderkey % 6 <> 0 AS found FROM orders)""")
def conflict_reasons(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_custkey")
    name = F.when(key % 4 == 1, "Other: Film").when(key % 4 == 2, "").otherwise("some film")
    year, released = F.when(key % 5 != 4, 2000), F.concat((2000 + key % 5).cast("string"), F.lit("-01-02"))
    reasons = matching.conflict_reasons(F.col("o_orderkey") % 6 != 0, F.lit("Some Film (2)"), name, year, released, F.when(key % 3 == 0, 9000).otherwise(6000), F.lit(100), key % 2 == 0)
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(reasons, ";").alias("reasons"))


_FRAMES = [(720, 480), (640, 360), (1280, 720), (1920, 1080), (1920, 1200), (3840, 2160), (3840, 2076), (3840, 1608), (4096, 2304), (1440, 1080), (1920, 800), (3840, 1080)]
_HDR, _PRIM = ["sdr", "sdr", "sdr", "hdr10", "hlg", "dv78", "sdr"], ["bt709", "", "bt470bg", "smpte170m"]
_PLAN_ITEMS = f"""SELECT p_partkey, p_size, target, w, h, CASE WHEN cropped THEN w - 16 END AS cw, CASE WHEN cropped THEN h - 2 * (p_size % 40) END AS ch0, 24.0 AS fps, CASE WHEN p_size % 3 = 1 THEN 10 ELSE 8 END AS depth,
  ({_HDR})[p_partkey // 5 % 7 + 1] AS hdr, ({_PRIM})[p_size % 4 + 1] AS prim, (['high', 'mid', 'low', 'awful'])[p_partkey // 2 % 4 + 1] AS tier, p_partkey % 9 = 4 AS woven, p_retailprice * 5e6 AS size, CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE 6000.0 END AS dur
FROM (SELECT *, ({[f[0] for f in _FRAMES]})[p_partkey % 12 + 1] AS w, ({[f[1] for f in _FRAMES]})[p_partkey % 12 + 1] AS h, p_size % 3 = 0 AS cropped FROM part, (VALUES (1080), (2160)) t(target))"""


@query(f"""
WITH a AS (SELECT *, coalesce(ch0, h) AS ch, coalesce(cw, w) AS sw, w >= 3000 AND coalesce(cw, w) * coalesce(ch0, h) >= 5500000 AS large FROM ({_PLAN_ITEMS})),
b AS (SELECT *, CASE WHEN large AND tier = 'awful' THEN 'strong' WHEN large AND tier = 'low' THEN 'weak' END AS deblock, tier IN ('low', 'awful') OR (ch <= 576 AND tier <> 'high') AS repair, large AND target = 2160 AS master,
  CASE WHEN hdr IN ('hdr10', 'dv78') THEN 'hdr10' WHEN hdr = 'hlg' THEN 'hlg' ELSE 'sdr709' END AS space, hdr = 'sdr' AND prim NOT IN ('', 'bt709') AS odd FROM a),
c AS (SELECT *, master AND ch >= 1944 AND ch < 2160 AS padded, (master AND ch > 2160) OR (NOT master AND ch > 1080) AS down, NOT master AND ch < 1080 AS up, NOT repair AND depth < 10 AS band, CASE WHEN space = 'sdr709' THEN 0 ELSE 1 END AS flag FROM b),
d AS (SELECT *, least(30, greatest(10, CASE tier WHEN 'high' THEN 21 WHEN 'mid' THEN 23 WHEN 'low' THEN 26 ELSE 28 END - CASE WHEN depth >= 10 THEN 1 ELSE 0 END - flag)) AS tiered, CASE WHEN master AND dur > 0 THEN greatest(0.5, CASE WHEN deblock IS NULL THEN least(size, 10737418240.0) ELSE 10737418240.0 END * 8 / dur / 1e6 - 2.5) ELSE 0.0 END AS budget FROM c),
e AS (SELECT *, CASE WHEN up AND ch < 720 THEN 28 - flag WHEN up OR NOT repair THEN tiered ELSE 24 - flag END AS q1,
  CASE WHEN master THEN CASE WHEN padded OR down THEN 2160 ELSE ch END WHEN up OR down THEN 1080 ELSE ch END AS out_h FROM d),
f AS (SELECT *, CASE WHEN h >= 2000 AND depth >= 10 THEN least(30, greatest(10, CAST(round_even(q1 - 6 * log2(1.3), 0) AS INT))) ELSE q1 END AS q2, CAST(round_even(sw * out_h / greatest(1, ch) / 2.0, 0) * 2 AS INT) AS out_w FROM e),
g AS (SELECT *, CASE WHEN up AND ch <= 576 THEN least(36, q2 + 8) ELSE q2 END AS q3 FROM f),
i AS (SELECT *, CASE WHEN master AND budget > 0 AND q3 < 32 THEN least(32, greatest(q3, CAST(ceil(27 - 4.5 * ln(budget * 1e6 / (0.1157 * out_w * out_h * 24)) / ln(2)) AS INT))) ELSE q3 END AS q FROM g)
SELECT p_partkey, target, CAST(q AS INT) AS cq, space AS out_space, CAST(out_w AS INT) AS out_w, CAST(out_h AS INT) AS out_h, CAST(floor(budget * 1500) AS INT) AS maxrate_kbps, ch0 IS NULL AND NOT woven AND NOT repair AND NOT up AND NOT down AND NOT odd AND space = 'sdr709' AS gate,
  array_to_string(list_filter([CASE WHEN woven THEN 'bwdif=mode=send_frame:parity=auto:deint=all' END, CASE WHEN ch0 IS NOT NULL THEN 'crop=' || cw || ':' || ch0 || ':8:' || p_size END, CASE WHEN ch <= 720 THEN 'eq=saturation=1.060' END, CASE WHEN depth < 10 THEN 'format=yuv420p10le' END,
    CASE WHEN deblock IS NOT NULL THEN 'deblock=filter=' || deblock || ':block=8' END, CASE WHEN repair THEN '{planning.DENOISE},{planning.REPAIR_DEBAND}' END,
    CASE WHEN odd THEN 'zscale=matrixin=' || CASE prim WHEN 'bt470bg' THEN '470bg' ELSE '170m' END || ':primariesin=' || CASE prim WHEN 'bt470bg' THEN 'bt470bg' ELSE '170m' END || ':transferin=' || CASE WHEN p_size % 5 = 0 THEN '601' WHEN h <= 576 THEN '601' ELSE '709' END || ':rangein=' || CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'limited' END || ':matrix=709:primaries=709:transfer=709:range=limited' END,
    CASE WHEN band THEN '{planning.DEBAND}' END, CASE WHEN padded OR up OR down THEN 'scale=-2:' || out_h || ':flags=lanczos+accurate_rnd+full_chroma_int' END, CASE WHEN up AND NOT large THEN '{planning.STABILISE}' END, CASE WHEN NOT (padded OR up OR down) THEN 'cas=strength=0.30' END, 'format=p010le'], lambda x: x IS NOT NULL), ',') AS chain,
  array_to_string(list_filter([CASE WHEN woven THEN 'deinterlaced_bwdif_same_rate' END, CASE WHEN ch <= 720 THEN 'sd_saturation_1.06' END, CASE WHEN depth < 10 THEN 'filtered_at_10bit' END, 'uhd_deblock_' || deblock || '_tier_' || tier, CASE WHEN repair THEN 'repair_chain_tier_' || tier END,
    CASE WHEN space = 'hlg' THEN 'hlg_kept_no_libplacebo' END, CASE WHEN odd THEN 'sdr_normalized_bt709' END, CASE WHEN band THEN 'deband_applied' WHEN NOT repair THEN 'deband_skipped_source_already_10bit' END, CASE WHEN padded THEN 'uhd_padded_' || ch || '_to_2160_lines' END, CASE WHEN master AND down THEN 'uhd_downscaled_to_2160_lines' END,
    CASE WHEN master AND NOT padded AND NOT down THEN 'uhd_native_' || sw || 'x' || ch END, CASE WHEN up THEN 'upscaled_to_1080_lines' END, CASE WHEN up AND NOT large THEN 'upscale_temporal_stabiliser' END, CASE WHEN down AND NOT master THEN 'downscaled_to_1080_lines' END, CASE WHEN NOT (padded OR up OR down) THEN 'cas_sharpen_0.30' END,
    CASE WHEN up AND ch >= 720 THEN 'upscale_kept_tier_cq_' || ch || 'p_source' END, CASE WHEN q1 <> q2 THEN 'hq_source_boost_30pct_cq_' || q1 || '_to_' || q2 END, CASE WHEN q2 <> q3 THEN 'lowres_' || ch || 'p_cq_' || q2 || '_to_' || q3 END, CASE WHEN master AND budget <= 0 THEN 'uhd_budget_unavailable' END, CASE WHEN q <> q3 THEN 'uhd_budget_cq_' || q3 || '_to_' || q END,
    CASE WHEN master AND budget > 0 AND 0.1157 * out_w * out_h * 24 * pow(2, (27 - q) / 4.5) / 1e6 > budget THEN printf('uhd_over_budget_%.2fGB_target_%.2fGB_at_cq_%d', 0.1157 * out_w * out_h * 24 * pow(2, (27 - q) / 4.5) * dur / 8 / 1073741824, budget * 1e6 * dur / 8 / 1073741824, CAST(q AS INT)) END], lambda x: x IS NOT NULL), ';') AS notes FROM i""")
def plan_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of pictures of many sizes, tiers, depths and colours, for both targets."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    w, h, crop = pick([f[0] for f in _FRAMES], key % 12), pick([f[1] for f in _FRAMES], key % 12), size % 3 == 0
    prim = pick(_PRIM, size % 4)
    trc = F.when(size % 5 == 0, "smpte170m").otherwise("")
    items = table(spark, folder, "part").select(
        "p_partkey", w.alias("w"), h.alias("h"), F.when(crop, w - 16).alias("crop_w"), F.when(crop, h - 2 * (size % 40)).alias("crop_h"), F.when(crop, 8).alias("crop_x"), F.when(crop, size).alias("crop_y"), F.lit(24.0).alias("fps"), F.when(size % 3 == 1, 10).otherwise(8).alias("depth"),
        pick(_HDR, F.floor(key / 5) % 7).alias("hdr"), prim.alias("prim"), prim.alias("space"), trc.alias("trc"), F.when(size % 2 == 0, "pc").otherwise("tv").alias("color_range"), pick(["high", "mid", "low", "awful"], F.floor(key / 2) % 4).alias("tier"), (key % 9 == 4).alias("interlaced"),
        (F.col("p_retailprice") * 5e6).alias("size"), F.when(key % 13 == 0, 0.0).otherwise(6000.0).alias("dur"), F.array().cast("array<string>").alias("notes"))
    both = [planning.planned(items, planning.Options(target=t)).withColumn("target", F.lit(t)) for t in (1080, 2160)]
    return both[0].union(both[1]).select("p_partkey", "target", "cq", "out_space", "out_w", "out_h", "maxrate_kbps", "gate", F.array_join("chain", ",").alias("chain"), F.array_join("notes", ";").alias("notes"))


@query("""
SELECT p_partkey, CAST(p_size * 60 AS DOUBLE) AS dur, CAST(CASE WHEN p_partkey % 3 = 0 THEN 24 ELSE 25 END AS DOUBLE) AS fps,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(1000 * p_size AS DOUBLE) ELSE 0.85 * 500000 END AS vbr, CASE WHEN p_partkey % 2 = 0 THEN 'stream' ELSE 'container' END AS vbr_basis,
  CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 8 END AS depth, CASE WHEN p_partkey % 5 = 0 THEN 'hdr10' ELSE 'sdr' END AS hdr, CAST(1 + p_partkey % 2 AS INT) AS audios, CAST(1 AS INT) AS subs, CAST(p_size * 60 AS DOUBLE) - 3.5 AS audio_dur FROM part""")
def probe_info(spark: SparkSession, folder: str) -> DataFrame:
    """Probe records made of part rows, normalised."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    clock = F.format_string("00:%02d:%02d.500000000", F.floor((size * 60 - 4) / 60), (size * 60 - 4) % 60)
    video = F.format_string('{"index":0,"codec_type":"video","codec_name":"h264","width":640,"height":480,"avg_frame_rate":"%s","r_frame_rate":"0/0","bit_rate":%s,"pix_fmt":"%s","color_transfer":"%s"}', F.when(key % 3 == 0, "0/0").otherwise("25/1"), F.when(key % 2 == 0, F.concat(F.lit('"'), text(1000 * size), F.lit('"'))).otherwise("null"), F.when(key % 4 == 0, "yuv420p10le").otherwise("yuv420p"), F.when(key % 5 == 0, "smpte2084").otherwise("bt709"))
    audio = F.concat(F.lit('{"index":1,"codec_type":"audio","codec_name":"aac","channels":2,"tags":{"language":"eng","DURATION":"'), clock, F.lit('"}}'))
    more = F.when(key % 2 == 1, ',{"index":3,"codec_type":"audio","codec_name":"dts","channels":6}').otherwise("")
    json = F.concat(F.lit('{"streams":['), video, F.lit(","), audio, F.lit(',{"index":2,"codec_type":"subtitle","codec_name":"subrip"}'), more, F.lit('],"format":{"duration":"'), text(size * 60), F.lit('","bit_rate":"500000","size":"100"}}'))
    info = tables.probed(table(spark, folder, "part").select("p_partkey", json.alias("json")))
    found = F.get(F.filter("census", lambda s: s["kind"] == "audio"), F.lit(0))["dur"]
    return info.select("p_partkey", "dur", "fps", "vbr", "vbr_basis", "depth", "hdr", F.size("audios").alias("audios"), F.size("subs").alias("subs"), found.alias("audio_dur"))


@query("""
SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 23.0 ELSE least(30.0, greatest(10.0, CAST(c_custkey % 50 AS DOUBLE))) END AS DOUBLE) AS cq, c_custkey % 3 <> 0 AS enabled, 'slow' AS preset FROM customer""")
def settings_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Settings files of customers: read, merged with flags and defaults, clamped."""
    key = F.col("c_custkey")
    lines = F.array(F.lit("# head"), F.lit("CQ = 99"), F.concat(F.lit("cq = "), F.when(key % 7 == 0, "many").otherwise((key % 50).cast("string")), F.lit(" # later wins")), F.concat(F.lit("Enabled="), F.when(key % 3 == 0, "Off").otherwise("yes")), F.lit("nonsense"), F.lit("preset = fast"))
    rows = table(spark, folder, "customer").select("c_custkey", F.posexplode(lines).alias("number", "value"))
    read = tables.settings(rows, ["c_custkey"]).groupBy("c_custkey").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    merged = read.withColumn("m", queue.with_precedence(F.create_map(F.lit("preset"), F.lit("slow")), F.col("m"), F.create_map(F.lit("cq"), F.lit("20"))))
    return merged.select("c_custkey", N.clamped(F.col("m")["cq"], 10.0, 30.0, 23.0).alias("cq"), N.truthy(F.col("m")["enabled"]).alias("enabled"), F.col("m")["preset"].alias("preset"))


@query("""
SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s // 60 % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS elapsed,
  printf('%.2f GiB', round(o_totalprice) * 20477 / 1073741824) AS size, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS tag
FROM (SELECT *, CAST(o_custkey * 7 AS BIGINT) AS s FROM orders)""")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", X.human_duration(F.col("o_custkey") * 7).alias("elapsed"), X.gib(F.round("o_totalprice") * 20477).alias("size"), X.path_tag(F.col("o_orderkey").cast("string")).alias("tag"))
