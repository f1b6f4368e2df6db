"""Ordered series: gaps, spikes, repeats, interpolation, regression, partition of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import in_intervals


def last_good(rows: DataFrame, by: list[str], order: list[Column], value: Column, good: Column, start: float, name: str = "expected") -> DataFrame:
    """The last good value before each row, or the start."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.last(F.when(good, value), ignorenulls=True).over(before), F.lit(start)))


def with_spikes(rows: DataFrame, by: list[str], order: list[Column], value: Column, tolerance: float, reach: int = 2) -> DataFrame:
    """spike: the value is off the upper median of the rows around it (three or more of them)."""
    around = F.sort_array(F.collect_list(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))
    median = F.get(around, F.floor(F.size(around) / 2).cast("int"))
    return rows.withColumn("spike", F.coalesce((F.size(around) >= 3) & (F.abs(value - median) > tolerance), F.lit(False)))


def coverage(rows: DataFrame, by: list[str], t: str, duration: Column, least: int = 3) -> DataFrame:
    """head, tail, gap and the first failure (tail, head, gap, few) of the points of each group."""
    step = F.lead(t).over(W.partitionBy(*by).orderBy(t)) - F.col(t)
    out = rows.withColumn("_step", step).groupBy(*by).agg(F.count("*").alias("points"), F.min(t).alias("head"), (duration - F.max(t)).alias("tail"), F.coalesce(F.max("_step"), F.lit(0)).alias("gap"))
    limit = F.greatest(F.lit(120.0), duration * 0.05)
    return out.withColumn("problem", F.when(F.col("tail") > limit, "tail").when(F.col("head") > limit, "head").when(F.col("gap") > limit, "gap").when(F.col("points") < least, "few"))


def jumps(rows: DataFrame, by: list[str], order: list[Column], value: Column, least: float) -> DataFrame:
    """How many consecutive values of each group differ by more than `least`."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return rows.select(*by, (F.abs(value - before) > least).alias("_jump")).groupBy(*by).agg(F.coalesce(F.sum(F.col("_jump").cast("long")), F.lit(0)).alias("jumps"))


def without_consecutive_repeats(rows: DataFrame, by: list[str], order: list[Column], value: Column) -> DataFrame:
    """Rows whose value is not null and differs from the one before."""
    rows = rows.where(value.isNotNull())
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != value)).drop("_b")


def without_trailing_repeats(rows: DataFrame, by: list[str], position: str, value: Column, run: int = 3) -> DataFrame:
    """Groups without the run of equal values at their end, if it is `run` or longer and not all there is."""
    last = rows.withColumn("_v", value)
    ends = last.groupBy(*by).agg(F.max_by("_v", position).alias("_last"), F.count("*").alias("_all"), F.max(position).alias("_end"))
    other = last.join(ends, by).groupBy(*by).agg(F.max(F.when(~F.col("_v").eqNullSafe(F.col("_last")), F.col(position))).alias("_other"), F.first("_all").alias("_all"), F.sum(F.lit(0)).alias("_z"), F.first("_last").alias("_last"))
    both = rows.join(other, by)
    start = F.coalesce(F.col("_other"), F.lit(-1))
    length = F.count(F.when(F.col(position) > start, 1)).over(W.partitionBy(*by))
    both = both.withColumn("_length", length)
    drop = (F.col("_length") >= run) & (F.coalesce("_last", F.lit("")) != "") & (F.col("_all") >= run + 1) & (F.col(position) > start)
    return both.where(~drop).drop("_other", "_all", "_z", "_last", "_length")


def interpolated(probes: DataFrame, knots: DataFrame, by: list[str], t: str, x: str, y: str, name: str = "value", width: float = 86400.0) -> DataFrame:
    """y at t of each probe, linear between the knots (x, y) on its sides and level beyond them.

    Knots are few beside probes: each interval between two is dealt to the
    buckets of `width` that it touches, and probes meet it by equality on their
    bucket.  Probes are neither sorted nor gathered.  Knots share no x in a
    group; probes of groups without knots get null.
    """
    order = W.partitionBy(*by).orderBy(x)
    bucket = lambda c: F.floor(c / width).cast("long")
    k = knots.select(*by, F.col(x).cast("double").alias("_a"), F.col(y).alias("_ya"), F.lead(x).over(order).cast("double").alias("_b"), F.lead(y).over(order).alias("_yb"))
    inner = k.where("_b is not null").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b")))))
    ends = knots.groupBy(*by).agg(F.min(F.struct(x, y)).alias("_first"), F.max(F.struct(x, y)).alias("_last"))
    rows = probes.withColumn("_bucket", bucket(F.col(t))).alias("p")
    inside = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by] + [F.col("p._bucket") == F.col("k._bucket"), (F.col(f"p.{t}") >= F.col("_a")) & (F.col(f"p.{t}") < F.col("_b"))]
    both = rows.join(inner.alias("k"), inside, "left").select("p.*", "_a", "_ya", "_b", "_yb").alias("p")
    both = both.join(ends.alias("e"), [F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by], "left").select("p.*", "_first", "_last")
    line = F.col("_ya") + (F.col("_yb") - F.col("_ya")) * (F.col(t) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    beyond = F.when(F.col(t) < F.col(f"_first.{x}"), F.col(f"_first.{y}")).otherwise(F.col(f"_last.{y}"))
    return both.withColumn(name, F.coalesce(line, beyond)).drop("_bucket", "_a", "_ya", "_b", "_yb", "_first", "_last")


def masked(rows: DataFrame, gaps: DataFrame, t: Column) -> DataFrame:
    """masked: t lies in one of the disjoint half-open intervals (g0, g1) of `gaps`."""
    return in_intervals(rows, gaps.select("g0", "g1"), t, "g0", "g1", False, 3600.0).withColumn("masked", F.col("g0").isNotNull()).drop("g0", "g1")


def robust_line(points: DataFrame, by: list[str], t: str, e: str, least: int = 3) -> DataFrame:
    """slope, intercept, kept, rms of a line through the points near the Theil-Sen line of each group.

    Below four points, or with too few near, all are kept; with one point or one
    time left the slope is 0 and the intercept the median.  Pairs of points grow
    with the square of a group: give bounded groups, for instance means of fixed
    intervals.
    """
    points = points.select(*by, F.col(t).cast("double").alias("t"), F.col(e).cast("double").alias("e"))
    a, b = points.alias("a"), points.alias("b")
    pairs = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.t") < F.col("b.t")])
    slopes = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.percentile((F.col("b.e") - F.col("a.e")) / (F.col("b.t") - F.col("a.t")), F.lit(0.5)).alias("m"))
    lines = points.join(slopes, by, "left").withColumn("m", F.coalesce("m", F.lit(0.0))).withColumn("r", F.col("e") - F.col("m") * F.col("t")).groupBy(*by).agg(F.first("m").alias("m"), F.percentile("r", F.lit(0.5)).alias("c"), F.count("*").alias("n"))
    off = points.join(lines, by).withColumn("d", F.abs(F.col("e") - F.col("m") * F.col("t") - F.col("c")))
    spread = off.groupBy(*by).agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    limit = F.greatest(F.lit(0.050), 4 * F.when(F.col("mad") == 0, 0.005).otherwise(F.col("mad")))
    off = off.join(spread, by).withColumn("near", F.col("d") <= limit)
    near = F.sum(F.col("near").cast("int")).over(W.partitionBy(*by))
    kept = off.withColumn("_near", near).where(F.col("near") | (F.col("_near") < least) | (F.col("n") < 4))
    flat = F.min("t") == F.max("t")
    fit = kept.groupBy(*by).agg(F.when(flat, 0.0).otherwise(F.regr_slope("e", "t")).alias("slope"), F.when(flat, F.percentile("e", F.lit(0.5))).otherwise(F.regr_intercept("e", "t")).alias("intercept"), flat.alias("flat"), F.count("*").alias("kept"))
    rms = kept.join(fit.select(*by, "slope", "intercept", "flat"), by).groupBy(*by).agg(F.sqrt(F.avg(F.when(F.col("flat"), 0.0).otherwise(F.pow(F.col("e") - F.col("slope") * F.col("t") - F.col("intercept"), F.lit(2.0))))).alias("rms"))
    return fit.drop("flat").join(rms, by)


def envelope(samples: DataFrame, by: list[str], position: Column, value: Column, block: int) -> DataFrame:
    """Mean absolute value of each whole block of samples."""
    blocks = samples.groupBy(*by, F.floor(position / block).alias("block")).agg(F.avg(F.abs(value)).alias("level"), F.count("*").alias("n"))
    return blocks.where(F.col("n") == block).drop("n")


def chunks(rows: DataFrame, total: Column, per: Column) -> DataFrame:
    """One row per chunk of `per` out of `total`: chunk, start, length; lengths sum to the total."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(total / per).cast("long") - 1)))
    return rows.select("*", parts.alias("chunk")).withColumn("start", F.col("chunk") * per).withColumn("length", F.least(per, total - F.col("chunk") * per))


def filled_to(rows: DataFrame, quotas: DataFrame, by: list[str], position: str, value: str, quota: str) -> DataFrame:
    """Each group's first `quota` rows; short groups repeat their last value."""
    places = quotas.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col(quota).cast("long") - 1)).alias(position))
    full = places.join(rows.select(*by, position, value), [*by, position], "left")
    so_far = W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn("padded", F.col(value).isNull()).withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def sample_windows(duration: Column) -> Column:
    """Starts of 12, 6 (below 300 s) or 4 (below 90 s) windows of 4 s, evenly over the middle of a duration."""
    n = F.when(duration < 90, 4).when(duration < 300, 6).otherwise(12)
    first, last = F.greatest(F.lit(1.0), duration * 0.03), duration * 0.97 - 4
    return F.when(last <= first, F.array(F.greatest(F.lit(0.0), duration / 2 - 2))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + (last - first) * i / (n - 1)))


def progress(rows: DataFrame, by: list[str], order: list[Column], done: Column, elapsed: Column, total: Column) -> DataFrame:
    """rate, percent and seconds left after each row."""
    so_far = F.sum(done).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("done_so_far", so_far).withColumn("rate", F.try_divide(F.col("done_so_far"), F.nullif(elapsed, F.lit(0.0))))
    return rows.withColumn("percent", 100 * F.col("done_so_far") / total).withColumn("seconds_left", F.try_divide(total - F.col("done_so_far"), F.nullif("rate", F.lit(0.0))))


def last_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def build_warp(anchors: DataFrame, by: list[str], duration: str, t: str = "t", offset: str = "offset", step_at: str | None = None, floor: float = 0.1, rate: float = 0.002) -> DataFrame:
    """Knots old_t -> new_t of a new timeline from good anchors (by, t, offset, duration, step_at).

    The first and last offsets hold to the ends.  A rise of the offset beyond
    max(floor, rate * span) is missing sound: at step_at, the place found
    between the anchor and the next (else there is none, and the change is one
    of rate), the new timeline jumps, and gap says how long it is silent there.
    new_t rises strictly.
    """
    order = W.partitionBy(*by).orderBy(t)
    place = F.col(step_at) if step_at else F.lit(None).cast("double")
    rows = anchors.select(*by, F.col(duration).cast("double").alias("_end"), F.col(t).cast("double").alias("_t"), F.col(offset).cast("double").alias("_o"), place.alias("_at"))
    ends = rows.groupBy(*by).agg(F.max("_end").alias("_end"), F.min(F.struct("_t", "_o")).alias("_f"), F.max(F.struct("_t", "_o")).alias("_l"))
    head = ends.where("_f._t > 1e-6").select(*by, "_end", F.lit(0.0).alias("_t"), F.col("_f._o").alias("_o"), F.lit(None).cast("double").alias("_at"))
    tail = ends.where("_end > _l._t + 1e-6").select(*by, "_end", F.col("_end").alias("_t"), F.col("_l._o").alias("_o"), F.lit(None).cast("double").alias("_at"))
    order = W.partitionBy(*by).orderBy("_t")
    rows = rows.unionByName(head).unionByName(tail).withColumn("_t1", F.lead("_t").over(order)).withColumn("_o1", F.lead("_o").over(order))
    loss = (F.col("_o1") - F.col("_o") > F.greatest(F.lit(floor), (F.col("_t1") - F.col("_t")) * rate)) & F.col("_at").isNotNull()
    at = F.least(F.greatest(F.col("_at"), F.col("_t") + 1e-3), F.col("_t1") - 1e-3)
    knot = lambda old, new, gap: F.struct(old.alias("old_t"), new.alias("raw"), gap.alias("gap"))
    none, plain = F.lit(0.0), F.array(knot(F.col("_t"), F.col("_t") + F.col("_o"), F.lit(0.0)))
    jump = F.array(knot(at, at + F.col("_o"), F.col("_o1") - F.col("_o")), knot(at + 1e-6, at + F.col("_o1"), none))
    rows = rows.select(*by, F.inline(F.when(loss, F.concat(plain, jump)).otherwise(plain)))
    order = W.partitionBy(*by).orderBy("old_t")
    # a knot is at least a millionth after the largest before it
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.max(F.col("raw") - F.col("_k") * 1e-6).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select(*by, "old_t", (F.col("_m") + F.col("_k") * 1e-6).alias("new_t"), "gap")


def warp_problems(knots: DataFrame, by: list[str], most_rate: float = 0.02, most_head: float = 10.0, most_gap: float = 30.0, most_change: float = 10.0) -> DataFrame:
    """worst rate change, silence at the head and in between, change of length of each timeline, and the limits they break (rate, head, gap, length)."""
    order = W.partitionBy(*by).orderBy("old_t")
    d_old, d_new = F.lead("old_t").over(order) - F.col("old_t"), F.lead("new_t").over(order) - F.col("new_t")
    rows = knots.withColumn("_off", F.when(d_old > 1e-5, F.abs(1 - d_new / d_old)))
    out = rows.groupBy(*by).agg(F.coalesce(F.max("_off"), F.lit(0.0)).alias("worst_rate"), F.min_by("new_t", "old_t").alias("head"), F.sum("gap").alias("total_gap"), (F.max("new_t") - F.max("old_t")).alias("change"))
    broken = [(F.col("worst_rate") > most_rate, "rate"), (F.col("head") > most_head, "head"), (F.col("total_gap") > most_gap, "gap"), (F.abs("change") > most_change, "length")]
    return out.withColumn("problems", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in broken])))


def run_statistics(chunks: DataFrame, by: list[str], metrics: str) -> DataFrame:
    """model_s, frames and peak_vram_mb of runs from the metrics (JSON) that their chunks report; unreadable ones count as nothing."""
    m = F.from_json(F.col(metrics), "seconds_model double, frames double, peak_vram_mb double")
    sums = [F.coalesce(F.sum(m[c]), F.lit(0.0)) for c in ("seconds_model", "frames")]
    return chunks.groupBy(*by).agg(sums[0].alias("model_s"), sums[1].cast("long").alias("frames"), F.greatest(F.lit(0.0), F.coalesce(F.max(m["peak_vram_mb"]), F.lit(0.0))).alias("peak_vram_mb"))
