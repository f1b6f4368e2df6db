"""Queries over streams with keyed state and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.journal import Journal
from ..sources.shared import shared_place
from ..sources.tables import table
from ..streaming import keyed
from .catalog import query, seconds

# Lines of a run (a user) at each event: its type says which signal moves, its value how far.
_LINE = "CASE event_type WHEN 'view' THEN 'out_time_ms=' || CAST(floor(value * 100) AS BIGINT) * 10000 WHEN 'click' THEN 'frame=' || CAST(floor(value) AS BIGINT) WHEN 'purchase' THEN 'total_size = ' || CAST(floor(value * 1000) AS BIGINT) WHEN 'error' THEN 'out_time_ms=N/A' ELSE 'starting' END"
_LINES = f"(SELECT user_id AS run, floor(epoch_us(ts) / 1e6) AS t, event_type, value, {_LINE} AS line FROM events)"
_LIMIT = 7200.0


def _lines(events: DataFrame) -> DataFrame:
    whole = lambda c: F.floor(c).cast("long").cast("string")
    kind = F.col("event_type")
    line = F.when(kind == "view", F.concat(F.lit("out_time_ms="), (F.floor(F.col("value") * 100).cast("long") * 10000).cast("string"))).when(kind == "click", F.concat(F.lit("frame="), whole(F.col("value")))).when(kind == "purchase", F.concat(F.lit("total_size = "), whole(F.col("value") * 1000))).when(kind == "error", "out_time_ms=N/A").otherwise("starting")
    t = F.floor(seconds()).cast("double")
    return events.select(F.col("user_id").alias("run"), t.alias("t"), F.timestamp_seconds(t).alias("at"), line.alias("line"))


_RISES = f"""
WITH m AS (SELECT run, t, max(CASE WHEN event_type = 'view' THEN floor(value * 100) / 100 END) AS position, max(CASE WHEN event_type = 'click' THEN floor(value) END) AS frame, max(CASE WHEN event_type = 'purchase' THEN floor(value * 1000) END) AS size FROM {_LINES} GROUP BY run, t),
s AS (SELECT *, row_number() OVER w = 1 OR coalesce(position > coalesce(max(position) OVER b, -1) + 0.001, false) OR coalesce(frame > coalesce(max(frame) OVER b, -1), false) OR coalesce(size > coalesce(max(size) OVER b, -1), false) AS rose,
    max(position) OVER u AS p, max(frame) OVER u AS f, max(size) OVER u AS z FROM m
  WINDOW w AS (PARTITION BY run ORDER BY t), b AS (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT run, t, p, f, z, coalesce(lead(t) OVER (PARTITION BY run ORDER BY t), (SELECT max(t) FROM m)) AS next FROM s WHERE rose)
SELECT run, t AS since, CAST(p AS DOUBLE) AS position, CAST(f AS BIGINT) AS frame, CAST(z AS BIGINT) AS size FROM e WHERE next - t > {_LIMIT}"""


def _result(found: DataFrame) -> DataFrame:
    return found.select("run", "since", F.col("position").cast("double").alias("position"), "frame", "size")


@query(_RISES)
def watchdog_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of which no signal rose for two hours, those silent at the end included."""
    rows = keyed.signals(_lines(table(spark, folder, "events")), "line")
    end = rows.agg(F.max("t").alias("end"))
    return _result(keyed.watchdog(rows.join(end), "run", "at", F.col("end"), _LIMIT))


@query(_RISES)
def watchdog_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: timers report the runs that fall silent."""
    events = table(spark, folder, "events")
    rows = keyed.signals(_lines(spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")), "line")
    found = keyed.watchdog_stream(rows, "run", "at", _LIMIT)
    return _result(drained(spark, found, "watchdog"))


def drained(spark: SparkSession, stream: DataFrame, name: str, **options: str) -> DataFrame:
    """Run a stream over what is there and read the table it wrote."""
    at = shared_place(spark, name)
    with keyed.stored(spark):
        stream.writeStream.format("parquet").options(path=f"{at}/out", checkpointLocation=f"{at}/state", **options).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"""
WITH f AS (SELECT run, t, trim(split_part(line, '=', 1)) AS name, trim(split_part(line, '=', 2)) AS value FROM {_LINES} WHERE contains(line, '=')),
m AS (SELECT run, name, max((t, value)) AS m FROM f GROUP BY run, name)
SELECT run, name, m[2] AS value, m[1] AS t, CAST(count(*) OVER (PARTITION BY run) AS BIGINT) AS fields FROM m""")
def progress_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's last fields from lines that come in files one by one, the oldest last: late lines change nothing.

    Of lines with one name and time the largest stands for them.
    """
    at = shared_place(spark, "lines")
    lines = _lines(table(spark, folder, "events"))
    lines = lines.where(F.col("line").contains("=")).withColumn("name", keyed.field(F.col("line"))["name"]).groupBy("run", "t", "name").agg(F.max("line").alias("line")).drop("name")
    half = F.floor(F.col("t") / 86400) % 2
    for part in (1, 0):
        lines.where(half == part).coalesce(1).write.mode("append").parquet(f"{at}/lines")
    stream = keyed.folded(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/lines"), "run", "t", "line")
    changes = drained(spark, stream, "fold")
    last = changes.groupBy("run", "name").agg(F.max_by("value", "t").alias("value"), F.max("t").alias("t"))
    return last.join(changes.groupBy("run").agg(F.max("fields").alias("fields")), "run").select("run", "name", "value", "t", "fields")


_PARTS = "(SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) % 3 AS part, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END, (epoch_us(ts), event_id)) AS status, count(*) AS n FROM events GROUP BY ALL)"
_RECORDS = f"(SELECT key, arg_max(status, part) AS status, string_agg('n' || part || '=' || n, ',' ORDER BY part) AS counts FROM {_PARTS} GROUP BY key)"


@query(f"SELECT key, status, counts, CAST((SELECT count(*) FROM {_RECORDS} WHERE status = 'failed') AS BIGINT) AS cleared FROM {_RECORDS} WHERE status <> 'failed'")
def journal_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A journal written by a stream in three batches, with a write that fails between them, compacted, and rid of failed records."""
    at = shared_place(spark, "versions")
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), (F.floor(seconds() / 86400).cast("long") % 3).alias("part"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id").alias("k"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    rows = events.groupBy("key", "part").agg(F.max_by("status", "k").alias("status"), F.count("*").alias("n"))
    fields = F.create_map(F.lit("status"), F.col("status"), F.concat(F.lit("n"), F.col("part").cast("string")), F.col("n").cast("string"))
    rows = rows.select("key", "part", fields.alias("fields"))
    log = Journal(spark, f"{at}/journal")
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/rows")
        stream = spark.readStream.schema("key string, fields map<string,string>").option("maxFilesPerTrigger", 1).parquet(f"{at}/rows")
        log.follow(stream, "rows", f"{at}/state")
        # a writer that is lost before its version stands: its table is there, and no one reads it
        log._table(rows.select("key", F.create_map(F.lit("status"), F.lit("lost")).alias("fields"), F.lit(False).alias("gone")))
        if part == 1:
            log.compact()
    cleared = log.clear()
    counts = F.array_join(F.transform(F.array_sort(F.filter(F.map_keys("fields"), lambda k: k != "status")), lambda k: F.concat(k, F.lit("="), F.col("fields")[k])), ",")
    return log.records().select("key", F.col("fields")["status"].alias("status"), counts.alias("counts"), F.lit(cleared).cast("long").alias("cleared"))
