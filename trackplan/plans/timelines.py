"""Queries over long series on timelines, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import timeline
from ..sources.shared import stored
from ..sources.tables import table
from .catalog import query
from .sequences import _noise, _tracks

_RATE = 100.0


def _both(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """A track's and its master's blocks."""
    rows = stored(rows, "tracks")
    return tuple(stored(timeline.blocks(rows, ["n_nationkey"], "i", v, length), "blocks") for v in "ab")


@query("SELECT n_nationkey, -(n_nationkey - 12) * 17 / 100.0 AS offset, true AS sure FROM nation")
def lag_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of 20 blocks, early or late by up to two seconds, by spectra summed over blocks."""
    a, b = _both(_tracks(spark, folder, 20_000, (F.col("n_nationkey") - 12) * 17), 1024)
    found = timeline.correlated(a, b, ["n_nationkey"], 1024, _RATE, 5.0)
    return found.select("n_nationkey", F.round("offset", 3).alias("offset"), (F.col("confidence") > 8).alias("sure"))


# Steps stand a second behind the middle of a sixteenth of 10..50 s; a probe of two seconds that begins there lies before them.
_PLACES = "(SELECT n_nationkey, k, 10 + 2.5 * ((n_nationkey + 5 * k) % 15 + 1) AS edge FROM nation, range(2) r(k))"


@query(f"SELECT n_nationkey, CAST(k AS INT) AS step, CAST(edge + 1.25 AS DOUBLE) AS place FROM {_PLACES}")
def step_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where two offsets of each nation's tracks change, all bisected together in four rounds."""
    rows = table(spark, folder, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select((F.col("n_nationkey") * 2 + F.col("k")).alias("n_nationkey"))
    key, step = F.floor(F.col("n_nationkey") / 2), F.col("n_nationkey") % 2
    edge = 10 + 2.5 * ((key + 5 * step) % 15 + 1)
    place = ((edge + 2.25) * _RATE).cast("long")
    samples = rows.select("n_nationkey", place.alias("place"), F.explode(F.sequence(F.lit(0), F.lit(5999))).alias("i"))
    late = F.when(F.col("i") >= F.col("place"), 60).otherwise(0)
    a, b = _both(samples.select("n_nationkey", "i", _noise(F.col("i") - late).alias("a"), _noise(F.col("i")).alias("b")), 512)
    steps = rows.select("n_nationkey", F.lit(0).alias("step"), F.lit(10.0).alias("t0"), F.lit(50.0).alias("t1"), F.lit(0.0).alias("before"), F.lit(-0.6).alias("after"))
    found = timeline.localised_steps(steps, a, b, ["n_nationkey"], "step", 512, _RATE, 0.5, 2.0, stored)
    return found.select(key.cast("int").alias("n_nationkey"), step.cast("int").alias("step"), F.round("at", 4).alias("place"))


_KNOTS = """
s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events),
n AS (SELECT user_id, count(*) AS n, CAST(count(*) AS DOUBLE) / 10 AS e, CAST(count(*) AS DOUBLE) / 20 AS m, CAST(user_id % 5 AS DOUBLE) * 0.3 AS d, CAST(CASE WHEN user_id % 11 = 0 THEN 31 WHEN user_id % 4 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS g FROM s GROUP BY user_id)"""


@query(f"""
WITH {_KNOTS},
o AS (SELECT *, CAST(j AS DOUBLE) / 10 AS tau FROM (SELECT *, unnest(range(CAST(round((e + d + g) * 10) AS BIGINT))) AS j FROM n WHERE g < 30)),
t AS (SELECT *, CASE WHEN tau <= d THEN 0 WHEN tau <= m + d THEN m * (tau - d) / (m + d - d) WHEN tau <= m + 1e-6 + d + g THEN m + 1e-6 * (tau - (m + d)) / (m + 1e-6 + d + g - (m + d)) WHEN tau < e + d + g THEN m + 1e-6 + (e - m - 1e-6) * (tau - (m + 1e-6 + d + g)) / (e + d + g - (m + 1e-6 + d + g)) ELSE e END * 10 AS x0 FROM o),
x AS (SELECT *, least(x0, n - 1) AS x FROM t)
SELECT x.user_id, j AS place, round(CASE WHEN g > 0 AND tau >= m + d AND tau < m + d + g THEN 0 ELSE a.v + (x - floor(x)) * (coalesce(b.v, a.v) - a.v) END, 4) AS value, NULL AS missing
FROM x JOIN s a ON a.user_id = x.user_id AND a.i = CAST(floor(x) AS BIGINT) LEFT JOIN s b ON b.user_id = x.user_id AND b.i = CAST(floor(x) AS BIGINT) + 1
UNION ALL SELECT user_id, NULL, NULL, g FROM n WHERE g >= 30""")
def conform_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as a series of ten a second, moved onto a timeline that is late and has a gap; too long gaps are refused."""
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    samples = stored(table(spark, folder, "events").select("user_id", i.cast("long").alias("i"), "value"), "samples")
    count = samples.groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    key = F.col("user_id")
    late, gap = (key % 5).cast("double") * 0.3, F.when(key % 11 == 0, 31.0).when(key % 4 == 0, 1.5).otherwise(0.0)
    middle, end, none = F.col("n") / 20, F.col("n") / 10, F.lit(0.0)
    places = [(none, late, none), (middle, middle + late, gap), (middle + 1e-6, middle + 1e-6 + late + gap, none), (end, end + late + gap, none)]
    knots = count.select("user_id", F.inline(F.array(*[F.struct(o.alias("old_t"), w.alias("new_t"), g.alias("gap")) for o, w, g in places])))
    moved, refused = timeline.conformed(stored(timeline.blocks(samples, ["user_id"], "i", "value", 16), "blocks"), knots, ["user_id"], 16, 10.0)
    moved = moved.select("user_id", "block", F.posexplode("samples").alias("at", "value"))
    moved = moved.select("user_id", (F.col("block") * 16 + F.col("at")).alias("place"), F.round("value", 4).alias("value"), F.lit(None).cast("double").alias("missing"))
    return moved.union(refused.select("user_id", F.lit(None).cast("long"), F.lit(None).cast("double"), "missing"))
