"""Keyed state with timers: a watchdog over runs' signals, and progress lines folded into each run's fields."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs a store of this kind.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STALL_SECONDS = 420.0
#: A position counts as risen beyond this; frames and sizes by any whole number.
LEAST_STEP = 0.001
_FIRST = (-1.0, -1, -1)


class stored:  # noqa: N801
    """The session with a state store that keeps timers, for the time of a stream."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, None

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE[0], None)
        self.spark.conf.set(*STORE)

    def __exit__(self, *exc) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE[0])
        else:
            self.spark.conf.set(STORE[0], self.before)


def field(line: Column) -> Column:
    """struct(name, value) of a `name=value` line, null for others."""
    return F.when(line.contains("="), F.struct(F.trim(F.substring_index(line, "=", 1)).alias("name"), F.trim(F.regexp_extract(line, "=(.*)$", 1)).alias("value")))


def signals(lines: DataFrame, line: str) -> DataFrame:
    """Lines with the signal each carries: position (seconds, from microseconds), frame or size; unreadable values are null."""
    f = field(F.col(line))
    number = lambda name, kind: F.when(f["name"] == name, f["value"].try_cast(kind))
    return lines.select("*", (number("out_time_ms", "long") / 1e6).alias("position"), number("frame", "long").alias("frame"), number("total_size", "long").alias("size"))


class Watchdog(StatefulProcessor):
    """Of each run the highest signals and when one last rose; silence beyond the limit is a row, at the latest when its timer ends."""

    OUT = "run bigint, since double, position double, frame bigint, size bigint"

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("signals", "position double, frame bigint, size bigint, since double, told boolean")

    def _row(self, run: int, state: tuple) -> tuple:
        seen = [None if v < 0 else v for v in state[:3]]
        return run, state[3], *seen

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (run,) = key
        state = self.state.get() if self.state.exists() else None
        before = state[3] if state else None
        found = []
        for t, position, frame, size in pd.concat(list(rows)).sort_values("t", kind="stable")[["t", "position", "frame", "size"]].itertuples(index=False):
            if state is None:
                state = (*_FIRST, float(t), False)  # a run's time starts with its first line
            now = [best if pd.isna(v) else max(best, kind(v)) for best, v, kind in zip(state[:3], (position, frame, size), (float, int, int), strict=True)]
            if position > state[0] + LEAST_STEP or frame > state[1] or size > state[2]:
                if t - state[3] > self.limit and not state[4]:
                    found.append(self._row(run, state))
                # a position within the step isn't taken over, so that slow ones add up
                state = (now[0] if position > state[0] + LEAST_STEP else state[0], now[1], now[2], float(t), False)
        self.state.update(state)
        if self.limit > 0:
            if before is not None and before != state[3]:
                self.handle.deleteTimer(self._due(before))
            if not state[4]:
                self.handle.registerTimer(self._due(state[3]))
        yield pd.DataFrame(found if self.limit > 0 else [], columns=["run", "since", "position", "frame", "size"]).astype({"frame": "Int64", "size": "Int64"})

    def _due(self, since: float) -> int:
        """The timer's millisecond: the first beyond the limit."""
        return int((since + self.limit) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        silent = not state[4] and self._due(state[3]) <= expiredTimerInfo.getExpiryTimeInMs()
        if silent:
            self.state.update((*state[:4], True))
        yield pd.DataFrame([self._row(key[0], state)] if silent else [], columns=["run", "since", "position", "frame", "size"]).astype({"frame": "Int64", "size": "Int64"})

    def close(self) -> None:
        pass


def watchdog_stream(rows: DataFrame, run: str, at: str, limit: float = STALL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Runs that fall silent, as a stream: run, since (the last rise of a signal), and the highest signals seen.

    rows: run (bigint), `at` (timestamp) and position, frame, size (null where
    a line carries none; a position may be missing for a whole run).  A row for
    each stretch beyond `limit` seconds in which none of the three rose: when
    one rises again or when the watermark passes the limit, whichever comes
    first; a limit of 0 finds none.  Start the stream within `stored(spark)`.
    """
    timed = rows.select(F.col(run).cast("bigint").alias("run"), F.col(at).alias("_at"), (F.unix_micros(F.col(at)) / 1e6).alias("t"), F.col("position").cast("double").alias("position"), F.col("frame").cast("double").alias("frame"), F.col("size").cast("double").alias("size"))
    return timed.withWatermark("_at", late).groupBy("run").transformWithStateInPandas(Watchdog(limit), Watchdog.OUT, "Append", "EventTime")


def watchdog(rows: DataFrame, run: str, at: str, until: Column, limit: float = STALL_SECONDS) -> DataFrame:
    """The batch twin of `watchdog_stream` for frames and sizes, and positions that rise by more than the step; `until` is how far time has come."""
    order = W.partitionBy("run").orderBy("t")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    timed = rows.select(F.col(run).cast("bigint").alias("run"), (F.unix_micros(F.col(at)) / 1e6).alias("t"), "position", "frame", "size", until.alias("_until"))
    timed = timed.groupBy("run", "t").agg(F.max("position").alias("position"), F.max("frame").alias("frame"), F.max("size").alias("size"), F.first("_until").alias("_until"))
    rose = lambda c, step: F.coalesce(F.col(c) > F.coalesce(F.max(c).over(before), F.lit(-1)) + step, F.lit(False))
    first = F.row_number().over(order) == 1
    so_far = W.partitionBy("run").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    seen = [F.max(c).over(so_far).alias(c) for c in ("position", "frame", "size")]
    rises = timed.withColumn("_rose", first | rose("position", LEAST_STEP) | rose("frame", 0) | rose("size", 0)).select("run", "t", "_until", "_rose", *seen).where("_rose")
    ends = rises.withColumn("_next", F.coalesce(F.lead("t").over(order), F.col("_until")))
    return ends.where((F.col("_next") - F.col("t") > limit) & F.lit(limit > 0)).select("run", F.col("t").alias("since"), F.col("position").cast("double").alias("position"), "frame", "size")


class Fold(StatefulProcessor):
    """The last value of each field of a run, by the lines' own time; later arrivals of earlier lines change nothing."""

    OUT = "run bigint, name string, value string, t double, fields bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "name string", "value string, t double")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("t", kind="stable").drop_duplicates("name", keep="last")
        n = self.count.get()[0] if self.count.exists() else 0
        changed = []
        for name, value, t in last[["name", "value", "t"]].itertuples(index=False):
            known = self.fields.containsKey((name,))
            if not known or self.fields.getValue((name,))[1] <= t:
                self.fields.updateValue((name,), (value, float(t)))
                changed.append((key[0], name, value, float(t)))
                n += not known
        self.count.update((n,))
        yield pd.DataFrame([(*c, n) for c in changed], columns=["run", "name", "value", "t", "fields"])

    def close(self) -> None:
        pass


def folded(lines: DataFrame, run: str, t: str, line: str) -> DataFrame:
    """Changes of each run's fields as a stream: run, name, value, t, and the number of fields known.

    lines: run, t (seconds) and `name=value` lines; others are passed over.
    The state is one value and its time for each field of a run.  Start the
    stream within `stored(spark)`.
    """
    pairs = lines.select(F.col(run).cast("bigint").alias("run"), F.col(t).cast("double").alias("t"), field(F.col(line)).alias("f")).where("f is not null").select("run", "t", "f.name", "f.value")
    return pairs.groupBy("run").transformWithStateInPandas(Fold(), Fold.OUT, "Append", "None")
