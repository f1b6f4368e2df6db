"""Rectangles (w, h, x, y) measured in several places: their mode and their bounding box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bars thinner than this are left.
MARGIN = 8


def floor_even(value: Column) -> Column:
    return (F.floor(value / 2) * 2).cast("long")


def mode(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The most frequent tuple of even-floored values in each group, the least of ties, with hits and share."""
    counts = rows.groupBy(*by, *[floor_even(F.col(v)).alias(v) for v in values]).agg(F.count("*").alias("hits"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("hits")).alias("less"), *values)).alias("best"), F.sum("hits").alias("total"))
    return best.select(*by, *[F.col(f"best.{v}").alias(v) for v in values], (-F.col("best.less")).alias("hits"), (-F.col("best.less") / F.col("total")).alias("share"))


def usable_crop(w: Column, h: Column, x: Column, y: Column, frame_w: Column, frame_h: Column) -> Column:
    """In the frame, at least a quarter of it, and cutting 8 lines or columns."""
    return (x + w <= frame_w) & (y + h <= frame_h) & (w * h >= F.floor(frame_w * frame_h / 4)) & ~((frame_w - w < MARGIN) & (frame_h - h < MARGIN))


def bounding(rows: DataFrame, by: list[str], frame_w: str, frame_h: str, margin: int = MARGIN, least: int = 64) -> DataFrame:
    """Box around w, h, x, y of each group: origin down to even, size up to even but within the frame.

    Null where it leaves less than `margin` on both sides of the frame, or is smaller than `least`.
    """
    box = rows.groupBy(*by, frame_w, frame_h).agg(floor_even(F.min("x")).alias("x"), floor_even(F.min("y")).alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    up = lambda v, limit: F.least(limit, floor_even(v + 1))
    box = box.withColumn("w", up(F.col("right") - F.col("x"), F.col(frame_w) - F.col("x"))).withColumn("h", up(F.col("bottom") - F.col("y"), F.col(frame_h) - F.col("y")))
    none = ((F.col("w") >= F.col(frame_w) - margin) & (F.col("h") >= F.col(frame_h) - margin)) | (F.col("w") < least) | (F.col("h") < least)
    return box.select(*by, *[F.when(~none, F.col(c)).alias(c) for c in ("w", "h", "x", "y")])


def crop_of(rows: DataFrame, by: list[str], frame_w: str, frame_h: str, windows: str) -> DataFrame:
    """The crop of each group: the mode of its rectangles where enough of its windows gave one and it is usable, else null.

    rows: by, frame, windows looked at, and w, h, x, y of each that gave a rectangle.
    """
    keys = [*by, frame_w, frame_h, windows]
    best = mode(rows.where("w is not null"), keys, ["w", "h", "x", "y"])
    reads = rows.groupBy(*keys).agg(F.count("w").alias("reads"))
    both = reads.join(best, keys, "left")
    w, h, x, y = (F.col(c) for c in ("w", "h", "x", "y"))
    good = (F.col("reads") >= F.greatest(F.lit(2), F.floor(F.col(windows) / 2))) & (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & usable_crop(w, h, x, y, F.col(frame_w), F.col(frame_h))
    return both.select(*by, "reads", *[F.when(good, F.col(c)).alias(c) for c in ("w", "h", "x", "y")], "share")
