"""Joins with sides that are small or not: broadcast behind a check of the size, dealt into cells beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
MOST_BROADCAST = 10_000


def is_small(frame: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """True for at most `most` rows; no more than one beyond these is counted."""
    return frame.limit(most + 1).count() <= most


def in_intervals(rows: DataFrame, intervals: DataFrame, value: Column, low: str, high: str, closed: bool, width: float, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows with the interval that holds their value, or nulls; intervals are disjoint.

    Many intervals are dealt to all buckets of `width` that they touch, and
    meet the rows of their buckets.
    """
    keyed = rows.withColumn("_value", value)
    within = (F.col("_value") >= F.col(low)) & ((F.col("_value") <= F.col(high)) if closed else (F.col("_value") < F.col(high)))
    if is_small(intervals, most):
        return keyed.join(F.broadcast(intervals), within, "left").drop("_value")
    bucket = lambda c: F.floor(c / width)
    dealt = intervals.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return keyed.withColumn("_bucket", bucket(F.col("_value"))).join(dealt, (F.col("_bucket") == F.col("_cell")) & within, "left").drop("_value", "_bucket", "_cell")


def all_pairs(rows: DataFrame, references: DataFrame, most: int = MOST_BROADCAST, cells: int = 64) -> DataFrame:
    """Every row with every reference; many references are dealt to cells, each of which meets all rows once."""
    if is_small(references, most):
        return rows.crossJoin(F.broadcast(references))
    copies = rows.withColumn("_row_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(cells)))
    dealt = references.withColumn("_cell", F.pmod(F.xxhash64(*references.columns), F.lit(cells))).withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return copies.join(dealt, (F.col("_row_cell") == F.col("_cell")) & (F.col("_salt") == F.col("_salted"))).drop("_row_cell", "_cell", "_salt", "_salted")
