"""Queries over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import align, matching, selection, series, tracks
from ..sources.shared import shared_place, stored
from ..sources.tables import table
from ..streaming import watch
from .catalog import query, seconds

_E = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", seconds().alias("t"), "ts")


def _order():
    return [F.col("t"), F.col("event_id")]


@query(f"""
SELECT event_id, coalesce(len(w) >= 3 AND abs(value - list_sort(w)[len(w) // 2 + 1]) > 25.0, false) AS spike FROM (
  SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM {_E})""")
def spike_filter(spark: SparkSession, folder: str) -> DataFrame:
    return series.with_spikes(_events(spark, folder), ["user_id"], _order(), F.col("value"), 25.0).select("event_id", "spike")


@query(f"""
SELECT user_id, CAST(count(*) AS BIGINT) AS points, round(min(t) - 1.7e9, 3) AS head, round(1.71e9 - max(t), 3) AS tail, round(coalesce(max(nxt - t), 0), 3) AS gap FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM {_E}) GROUP BY user_id""")
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.coverage(_events(spark, folder), ["user_id"], "t", F.lit(1.71e9))
    return rows.select("user_id", "points", F.round(F.col("head") - 1.7e9, 3).alias("head"), F.round("tail", 3).alias("tail"), F.round("gap", 3).alias("gap"))


@query(f"SELECT user_id, CAST(coalesce(sum(CAST(abs(value - b) > 40 AS BIGINT)), 0) AS BIGINT) AS jumps FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM {_E}) GROUP BY user_id")
def jump_count(spark: SparkSession, folder: str) -> DataFrame:
    return series.jumps(_events(spark, folder), ["user_id"], _order(), F.col("value"), 40.0)


@query(f"SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM {_E}) WHERE b IS NULL OR b <> event_type")
def consecutive_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return series.without_consecutive_repeats(_events(spark, folder), ["user_id"], _order(), F.col("event_type")).select("event_id", "event_type")


@query(f"""
SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS expected FROM {_E}""")
def last_good_value(spark: SparkSession, folder: str) -> DataFrame:
    return series.last_good(_events(spark, folder), ["user_id"], _order(), F.col("value"), F.col("event_type") != "error", 0.0).select("event_id", "expected")


@query("""
WITH c AS (SELECT *, CAST(role = 'user' AS VARCHAR) AS v FROM conversations),
e AS (SELECT conv_id, arg_max(v, turn) AS last, count(*) AS n FROM c GROUP BY conv_id),
o AS (SELECT conv_id, coalesce(max(turn) FILTER (v <> last), -1) AS other FROM c JOIN e USING (conv_id) GROUP BY conv_id),
r AS (SELECT conv_id, count(*) AS run FROM c JOIN o USING (conv_id) WHERE turn > other GROUP BY conv_id)
SELECT conv_id, turn FROM c JOIN e USING (conv_id) JOIN o USING (conv_id) LEFT JOIN r USING (conv_id) WHERE NOT (coalesce(run, 0) >= 2 AND n >= 3 AND turn > other)""")
def trailing_repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return series.without_trailing_repeats(rows, ["conv_id"], "turn", (F.col("role") == "user").cast("string"), run=2).select("conv_id", "turn")


_DAY = "CAST(floor(t / 86400) AS BIGINT)"


@query(f"""
WITH k AS (SELECT event_type, {_DAY} * 86400.0 + 43200 AS x, avg(value) AS y FROM {_E} GROUP BY ALL),
a AS (SELECT e.event_id, e.event_type, e.t, k.x, k.y FROM {_E} e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.t >= k.x),
b AS (SELECT a.*, k.x AS x2, k.y AS y2 FROM a ASOF LEFT JOIN k ON a.event_type = k.event_type AND a.t < k.x)
SELECT event_id, round(coalesce(y + (y2 - y) * (t - x) / (x2 - x), y, y2), 6) AS value FROM b""")
def warp_interp(spark: SparkSession, folder: str) -> DataFrame:
    """Events against the daily means of their type."""
    events = _events(spark, folder)
    knots = events.groupBy("event_type", (F.floor(F.col("t") / 86400) * 86400.0 + 43200).alias("x")).agg(F.avg("value").alias("y"))
    found = series.interpolated(events.select("event_id", "event_type", "t"), knots, ["event_type"], "t", "x", "y")
    return found.select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT event_id, EXISTS (SELECT 1 FROM range(24) g(h) WHERE h % 5 = 0 AND t % 86400 >= h * 3600 AND t % 86400 < h * 3600 + 1800) AS masked FROM {_E}")
def gap_mask(spark: SparkSession, folder: str) -> DataFrame:
    gaps = spark.range(0, 24, 5, 1).select((F.col("id") * 3600).alias("g0"), (F.col("id") * 3600 + 1800).alias("g1"))
    return series.masked(_events(spark, folder), gaps, F.col("t") % 86400).select("event_id", "masked")


@query(f"""
WITH d AS (SELECT event_type, CAST({_DAY} - 19000 AS DOUBLE) AS t, avg(value) AS e FROM {_E} GROUP BY ALL),
m AS (SELECT a.event_type, quantile_cont((b.e - a.e) / (b.t - a.t), 0.5) AS m FROM d a JOIN d b ON a.event_type = b.event_type AND a.t < b.t GROUP BY a.event_type),
l AS (SELECT event_type, any_value(m) AS m, quantile_cont(e - m * t, 0.5) AS c, count(*) AS n FROM d JOIN m USING (event_type) GROUP BY event_type),
o AS (SELECT event_type, t, e, n, abs(e - m * t - c) AS dist FROM d JOIN l USING (event_type)),
s AS (SELECT event_type, quantile_cont(dist, 0.5) AS mad FROM o GROUP BY event_type),
k AS (SELECT o.*, dist <= greatest(0.05, 4 * CASE WHEN mad = 0 THEN 0.005 ELSE mad END) AS near FROM o JOIN s USING (event_type)),
f AS (SELECT * FROM (SELECT *, sum(CAST(near AS INT)) OVER (PARTITION BY event_type) AS nn FROM k) WHERE near OR nn < 3 OR n < 4)
SELECT event_type, round(regr_slope(e, t), 6) AS slope, CAST(count(*) AS BIGINT) AS kept FROM f GROUP BY event_type""")
def theil_sen(spark: SparkSession, folder: str) -> DataFrame:
    """Daily means of each event type: pairs grow with days, not with rows."""
    days = _events(spark, folder).groupBy("event_type", (F.floor(F.col("t") / 86400) - 19000).alias("day")).agg(F.avg("value").alias("e"))
    return series.robust_line(days, ["event_type"], "day", "e").select("event_type", F.round("slope", 6).alias("slope"), "kept")


@query(f"""
SELECT a.event_type, round(quantile_cont((b.value - a.value) / (b.t - a.t) * 86400, 0.5), 6) AS slope FROM {_E} a JOIN {_E} b ON a.event_type = b.event_type AND a.t < b.t GROUP BY a.event_type""")
def theil_sen_events(spark: SparkSession, folder: str) -> DataFrame:
    """Median slopes over all events of a type, without their pairs."""
    points = _events(spark, folder).select("event_type", (F.col("t") / 86400 - 19000).alias("t"), F.col("value").alias("e"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = selection.median_slopes(points, ["event_type"], "t", "e", stored, parts, slopes=31, precision=1e-9)
    return found.select("event_type", F.round("slope", 6).alias("slope"))


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.9) AS high FROM lineitem GROUP BY ALL")
def exact_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of large groups by narrowing counts."""
    lines, by = table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"]
    half, high = (selection.percentiles(lines, by, F.col("l_extendedprice"), q, stored, most=1000, name=name) for q, name in ((0.5, "median"), (0.9, "high")))
    return half.join(high, by)


@query("""
SELECT o_orderkey, CAST(i AS INT) AS i, round(CASE WHEN one THEN greatest(0, d / 2 - 2) ELSE f + (l - f) * i / (n - 1) END, 6) AS start FROM (
  SELECT o_orderkey, d, n, f, l, l <= f AS one, unnest(range(CASE WHEN l <= f THEN 1 ELSE n END)) AS i FROM (
    SELECT o_orderkey, d, CASE WHEN d < 90 THEN 4 WHEN d < 300 THEN 6 ELSE 12 END AS n, greatest(1.0, d * 0.03) AS f, d * 0.97 - 4 AS l FROM (SELECT o_orderkey, CAST(o_custkey % 700 AS DOUBLE) AS d FROM orders)))""")
def window_samples(spark: SparkSession, folder: str) -> DataFrame:
    starts = series.sample_windows((F.col("o_custkey") % 700).cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", F.posexplode(starts).alias("i", "start")).withColumn("start", F.round("start", 6))


@query("""
SELECT o_orderkey, c AS chunk, c * 240 AS start, least(240, total - c * 240) AS length FROM (
  SELECT o_orderkey, total, unnest(range(greatest(1, CAST(ceil(total / 240.0) AS BIGINT)))) AS c FROM (SELECT o_orderkey, o_orderkey % 3000 + 1 AS total FROM orders))""")
def frame_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000 + 1).alias("total"))
    return series.chunks(rows, F.col("total"), F.lit(240).cast("long")).select("o_orderkey", "chunk", "start", "length")


_L = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS pos FROM lineitem)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1
    return table(spark, folder, "lineitem").withColumn("pos", pos.cast("long"))


@query(f"""
WITH l AS {_L}, q AS (SELECT l_orderkey, unnest(range(4)) AS pos FROM l GROUP BY l_orderkey)
SELECT q.l_orderkey, q.pos, l.l_quantity IS NULL AS padded, last_value(l.l_quantity IGNORE NULLS) OVER (PARTITION BY q.l_orderkey ORDER BY q.pos) AS l_quantity FROM q LEFT JOIN l ON q.l_orderkey = l.l_orderkey AND q.pos = l.pos""")
def pad_trim(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    quotas = lines.select("l_orderkey").distinct().withColumn("quota", F.lit(4))
    return series.filled_to(lines, quotas, ["l_orderkey"], "pos", "l_quantity", "quota")


@query(f"""
WITH l AS {_L} SELECT a.l_orderkey, a.pos, CASE WHEN b.l_orderkey IS NULL THEN 'missing' ELSE 'short' END AS problem FROM l a
LEFT JOIN (SELECT l_orderkey, pos, l_quantity - l_linenumber AS now FROM l WHERE pos < 3) b ON a.l_orderkey = b.l_orderkey AND a.pos = b.pos WHERE b.l_orderkey IS NULL OR (a.l_quantity > 0 AND now > 0 AND a.l_quantity - now > 2)""")
def positional_compare(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).select("l_orderkey", "pos", F.col("l_quantity").alias("dur"), "l_linenumber")
    after = lines.where("pos < 3").withColumn("dur", F.col("dur") - F.col("l_linenumber"))
    return tracks.compared(lines, after, ["l_orderkey"], "pos", "dur").select("l_orderkey", "pos", "problem")


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS short FROM lineitem l JOIN (SELECT l_orderkey, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey) USING (l_orderkey)
WHERE l_returnflag <> 'N' AND l_quantity > 0 AND v - l_quantity > 5 GROUP BY l_orderkey""")
def short_tracks(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "video").otherwise("audio")
    return tracks.short_tracks(table(spark, folder, "lineitem"), ["l_orderkey"], kind, "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("short"))


_STALLS = """
SELECT user_id, since - 1.7e9 AS since, until - 1.7e9 AS until FROM (
  SELECT user_id, t AS until, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS since FROM (
    SELECT user_id, t, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS rose FROM (SELECT user_id, floor(epoch_us(ts) / 1e6) AS t, max(value) AS value FROM events GROUP BY ALL)) WHERE rose) WHERE until - since > 3600"""


@query(_STALLS)
def stall_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _shifted(watch.stalls(_signals(_events(spark, folder)), ["user_id"], "t", ["value"], 3600.0))


def _signals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.floor("t").cast("double").alias("t")).agg(F.max("value").alias("value"))


def _shifted(found: DataFrame) -> DataFrame:
    return found.select("user_id", (F.col("since") - 1.7e9).alias("since"), (F.col("until") - 1.7e9).alias("until"))


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read the table it wrote."""
    at = shared_place(spark, name)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(_STALLS)
def stall_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The twin of stall_windows as a stream over raw events: ties in time count one by one."""
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").select("user_id", F.floor(seconds()).cast("double").alias("t"), "value")
    return _shifted(_drained(spark, watch.stall_stream(stream, "user_id", "t", "value", 3600.0, forget=False), "stalls"))


@query(f"""
SELECT event_id, n AS done_so_far, round(100.0 * n / total, 6) AS percent FROM (SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM {_E})""")
def progress_rate(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).withColumn("total", F.count("*").over(W.partitionBy("user_id")))
    rows = series.progress(events, ["user_id"], _order(), F.lit(1), F.col("t"), F.col("total"))
    return rows.select("event_id", "done_so_far", F.round("percent", 6).alias("percent"))


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS k FROM {_E}) WHERE k <= 5")
def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last five rows of each user: a top-k."""
    return series.last_rows(_events(spark, folder), ["user_id"], [F.desc("t"), F.desc("event_id")], 5).select("event_id")


@query(f"""
SELECT user_id, block, round(avg(abs(value)), 6) AS level FROM (SELECT user_id, value, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) / 4) AS BIGINT) AS block FROM {_E}) GROUP BY ALL HAVING count(*) = 4""")
def envelope_blocks(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).withColumn("p", F.row_number().over(W.partitionBy("user_id").orderBy(*_order())) - 1)
    return series.envelope(events, ["user_id"], F.col("p"), F.col("value"), 4).withColumn("level", F.round("level", 6))


_BITS = " + ".join(f"CAST(embedding[{8 * r + c + 1}] > embedding[{8 * r + c + 2}] AS BIGINT) * {1 << (55 - 7 * r - c)}" for r in range(8) for c in range(7))
_HASHES = f"(SELECT vec_id, label, {_BITS} AS h FROM embeddings)"


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", N.difference_hash(F.col("embedding"), 8, 8).alias("h"))


@query(f"SELECT vec_id, CAST(coalesce(bit_count(xor(h, lag(h) OVER (PARTITION BY label ORDER BY vec_id))), 64) AS INT) AS distance FROM {_HASHES}")
def dhash_hamming(spark: SparkSession, folder: str) -> DataFrame:
    before = F.lag("h").over(W.partitionBy("label").orderBy("vec_id"))
    return _hashes(spark, folder).select("vec_id", N.hamming(F.col("h"), before).alias("distance"))


@query(f"""
SELECT label, distance, vec_id, reference, CASE WHEN distance <= 12 THEN 'confirmed' ELSE 'unverified' END AS verdict FROM (
  SELECT a.label, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance, a.vec_id, b.vec_id AS reference, row_number() OVER (PARTITION BY a.label ORDER BY bit_count(xor(a.h, b.h)), a.vec_id, b.vec_id) AS k
  FROM {_HASHES} a, {_HASHES} b WHERE b.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label) AND a.vec_id NOT IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) WHERE k = 1""")
def nearest_ref(spark: SparkSession, folder: str) -> DataFrame:
    """Each label's vector closest to one of the references, which are the labels' first vectors."""
    hashes = _hashes(spark, folder)
    first = hashes.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    references = hashes.join(first, ["label", "vec_id"], "left_semi")
    found = matching.nearest(hashes.join(first, ["label", "vec_id"], "left_anti"), references, ["label"], ["vec_id"], ["h"], "h", "vec_id")
    return found.select("label", "distance", "vec_id", "reference", N.verdict(F.col("distance"), F.lit(12)).alias("verdict"))


@query(f"""
SELECT vec_id, distance, reference FROM (
  SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance, b.vec_id AS reference, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.h, b.h)), b.vec_id) AS k
  FROM {_HASHES} a, {_HASHES} b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0) WHERE k = 1""")
def nearest_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Each odd vector's closest even one, by bands of their hashes."""
    hashes = stored(_hashes(spark, folder), "hashes")
    found = matching.nearest_indexed(hashes.where("vec_id % 2 = 1").withColumn("frame", F.lit(0)), hashes.where("vec_id % 2 = 0"), ["vec_id"], ["frame"], ["h"], "h", "vec_id", stored)
    return found.select("vec_id", "distance", "reference")


def _noise(place: Column) -> Column:
    """A fixed signal: a number in -1 to 1 for each place."""
    return F.pmod(F.xxhash64(place.cast("long")), F.lit(2001)) / 1000.0 - 1.0


def _tracks(spark: SparkSession, folder: str, length: int, late: Column) -> DataFrame:
    """A master and a track of each nation that plays it `late` samples late."""
    rows = table(spark, folder, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    return rows.select("n_nationkey", "i", _noise(F.col("i") - late).alias("a"), _noise(F.col("i")).alias("b"))


@query("SELECT n_nationkey, -(n_nationkey - 12) * 3 / 100.0 AS lag, true AS sure FROM nation")
def lag_correlate(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks that are early or late by up to 0.36 s: a late one has a negative offset."""
    found = align.lags_of_groups(_tracks(spark, folder, 3000, (F.col("n_nationkey") - 12) * 3), "n_nationkey", "i", "a", "b", 100.0, 2.0)
    return found.select("n_nationkey", F.round("lag", 3).alias("lag"), (F.col("confidence") > 8).alias("sure"))


@query("SELECT n_nationkey, CAST(t AS DOUBLE) AS t, CASE WHEN t >= 30 THEN -n_nationkey / 100.0 - 1.2 ELSE -n_nationkey / 100.0 END AS offset, true AS good, CASE WHEN t IN (0, 30) THEN 'wide' ELSE 'fine' END AS how FROM nation, range(0, 56, 5) r(t)")
def anchor_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of tracks that are late, and from 30 s on later by another 1.2 s: the broad search finds the latter, and each side of the step is found by the wide one."""
    late = F.col("n_nationkey") + F.when(F.col("i") >= 3000, 120).otherwise(0)
    found = align.anchors_of_groups(_tracks(spark, folder, 6000, late), "n_nationkey", "i", "a", "b", 100.0, step=5.0, window=4.0)
    return found.select("n_nationkey", "t", F.round("offset", 3).alias("offset"), "good", "how")


@query("""
WITH a AS (SELECT c_custkey, k, 60.0 + 60 * k AS t, (c_custkey % 5) * 0.01 + 0.001 * k * (c_custkey % 3) + CASE WHEN k >= 2 AND c_custkey % 2 = 0 THEN 1.2 ELSE 0 END AS o FROM customer, range(4) r(k)),
n AS (SELECT c_custkey, t, t + o AS n, 0.0 AS gap FROM a UNION ALL SELECT c_custkey, 0.0, o, 0.0 FROM a WHERE k = 0 UNION ALL SELECT c_custkey, 300.0, 300 + o, 0.0 FROM a WHERE k = 3
  UNION ALL SELECT a.c_custkey, 150.0, 150 + a.o, b.o - a.o FROM a JOIN a b USING (c_custkey) WHERE a.k = 1 AND b.k = 2 AND c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 150.000001, 150.000001 + o, 0.0 FROM a WHERE k = 2 AND c_custkey % 2 = 0)
SELECT c_custkey, round(CAST(t AS DOUBLE), 6) AS old_t, round(CAST(n AS DOUBLE), 5) AS new_t, round(CAST(gap AS DOUBLE), 5) AS gap FROM n""")
def warp_knots(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines of tracks that drift, half of them with 1.2 s missing at 150 s."""
    key, k = F.col("c_custkey"), F.col("k")
    anchors = table(spark, folder, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    offset = (key % 5) * 0.01 + 0.001 * k * (key % 3) + F.when((k >= 2) & (key % 2 == 0), 1.2).otherwise(0.0)
    anchors = anchors.select("c_custkey", (60.0 + 60 * k).alias("t"), offset.alias("offset"), F.lit(300.0).alias("duration"), F.lit(150.0).alias("step_at"))
    found = series.build_warp(anchors, ["c_custkey"], "duration", step_at="step_at")
    return found.select("c_custkey", F.round("old_t", 6).alias("old_t"), F.round("new_t", 5).alias("new_t"), F.round("gap", 5).alias("gap"))


@query("""
SELECT c_custkey, CAST(head AS DOUBLE) AS head, CAST(CASE WHEN c_custkey % 4 = 1 THEN 35.0 ELSE 0.0 END AS DOUBLE) AS total_gap, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 2 THEN 'rate' END, CASE WHEN head > 10 THEN 'head' END, CASE WHEN c_custkey % 4 = 1 THEN 'gap' END, CASE WHEN c_custkey % 4 <> 0 THEN 'length' END], lambda x: x IS NOT NULL), ';') AS problems
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 12.0 ELSE 0.5 END AS head FROM customer)""")
def warp_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines that break one limit each: silence inside, rate, silence at the head."""
    kind = F.col("c_custkey") % 4
    head = F.when(kind == 3, 12.0).otherwise(0.5)
    end = 100.0 + head + F.when(kind == 1, 35.0).when(kind == 2, 20.0).otherwise(0.0)
    gap, none = F.when(kind == 1, 35.0).otherwise(0.0), F.lit(0.0)
    places = [(0.0, head, none), (50.0, 50.0 + head, gap), (50.000001, 50.000001 + head + gap, none), (100.0, end, none)]
    knots = F.array(*[F.struct(F.lit(old).alias("old_t"), new.alias("new_t"), g.alias("gap")) for old, new, g in places])
    rows = table(spark, folder, "customer").select("c_custkey", F.inline(knots))
    found = series.warp_problems(rows, ["c_custkey"])
    return found.select("c_custkey", F.round("head", 3).alias("head"), F.round("total_gap", 3).alias("total_gap"), F.array_join("problems", ";").alias("problems"))
