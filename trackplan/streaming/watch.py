"""Streams: progress lines folded into state, stalls, and a log's latest rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALL_SECONDS = 420.0


def progress_pairs(line: Column) -> Column:
    """map of a `key=value key=value` progress line."""
    return F.str_to_map(F.regexp_replace(F.trim(line), r"\s*=\s*", "="), F.lit(r"\s+"), F.lit("="))


def log_events(line: Column) -> Column:
    """struct(file, files, percent, speed, finished) of a line of a run's log."""
    number = lambda pattern, i, kind: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).try_cast(kind)
    return F.struct(number(r"file (\d+)/(\d+)", 1, "int").alias("file"), number(r"file (\d+)/(\d+)", 2, "int").alias("files"), number(r"(\d+(?:\.\d+)?)%", 1, "double").alias("percent"), number(r"speed[= ](\d+(?:\.\d+)?)x", 1, "double").alias("speed"), line.contains("run complete").alias("finished"))


def stalls(signals: DataFrame, by: list[str], t: str, values: list[str], limit: float = STALL_SECONDS) -> DataFrame:
    """Batch twin of `stall_stream`: gaps over the limit between rows at which any signal rose above all before."""
    order = W.partitionBy(*by).orderBy(t)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rose = None
    for v in values:
        one = F.col(v) > F.coalesce(F.max(v).over(before), F.lit(float("-inf")))
        rose = one if rose is None else rose | one
    advances = signals.withColumn("_rose", rose).where("_rose")
    since = F.lag(t).over(order)
    return advances.withColumn("since", since).where(F.col(t) - F.col("since") > limit).select(*by, "since", F.col(t).alias("until"))


def stall_stream(signals: DataFrame, by: str, t: str, value: str, limit: float = STALL_SECONDS, forget: bool = True) -> DataFrame:
    """Gaps over the limit as a stream, keyed by `by` (bigint); t in seconds, rows of a key come in order of batches.

    State is one (highest value, time of it) for each key; with `forget` an idle
    key's state goes after the limit of processing time, and a row without an
    end says since when it is silent (then a run over what is
    there doesn't end by itself: it waits for these times).
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, since = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]], "since": [since], "until": [float("nan")]})
            return
        best, since = state.get if state.exists else (float("-inf"), float("nan"))
        frame = pd.concat(list(batches)).sort_values(t, kind="stable")
        before = frame[value].cummax().shift(fill_value=float("-inf")).clip(lower=best)
        advances = frame[t][frame[value] > before].astype("float64")
        starts = advances.shift(fill_value=since)
        gaps = advances - starts > limit
        if len(advances):
            state.update((max(best, float(frame[value].max())), float(advances.iloc[-1])))
        elif not state.exists:
            state.update((best, since))
        if forget:
            state.setTimeoutDuration(int(limit * 1000))
        if gaps.any():
            yield pd.DataFrame({by: key[0], "since": starts[gaps], "until": advances[gaps]})

    return signals.groupBy(by).applyInPandasWithState(update, f"{by} bigint, since double, until double", "best double, since double", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def latest_stream(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of a growing log, for output mode `update` or `complete`."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def fresh(cache: DataFrame, keys: list[str], at: str, now: Column, days: int = 30) -> DataFrame:
    """Newest cache row of each key that isn't too old."""
    rest = [c for c in cache.columns if c not in keys]
    young = cache.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))
    return young.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")
