"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Target weights are whole parts; W is their sum.  Block k of a source with w
parts is released at slot floor(k W / w) and due by ceil((k + 1) W / w); in each
slot the released block with the earliest deadline runs.  On one processor this
meets every deadline, so after any number of slots each source has had less
than one block more or less than its weight asks for.  After W slots every
source has had exactly its parts and the schedule begins anew: nothing is
rounded, and one period of it, whose size is that of the weights, is enough.

Sources of equal weight form a class: their k-th blocks share a window and run
in the order of their numbers.  A period has at most sqrt(2 W) classes, so a
slot costs that much, however many sources there are.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import CELLS, MOST_BROADCAST, numbered
from .storage import Scratch, quoted, whole_row

BLOCK_ROWS = 32
#: Without target weights a source's parts are its rows to this power, in about PARTS parts for all (one at least for each).
TEMPER, PARTS = 0.7, 10_000
#: Parts of a period that one task schedules at most: with given weights of more digits it would have to be longer.
MOST_PARTS = 10_000_000
#: Slots of a period that are broadcast at most; beyond that blocks are joined with theirs.
BROADCAST_PARTS = 1_000_000
#: Slots that are gathered before they are put to the others.
STRETCH = 1000


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """Weights as the smallest whole numbers in the same proportion; a float is the decimal that it is written as."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("target weights are positive")
    exact = {k: Fraction(v if isinstance(v, (int, Fraction)) else str(v)) for k, v in weights.items()}
    common = lcm(*[f.denominator for f in exact.values()])
    parts = {k: int(f * common) for k, f in exact.items()}
    least = gcd(*parts.values())
    return {k: v // least for k, v in parts.items()}


def weighted(counts: DataFrame, weights: dict[str, float] | None, temper: float = TEMPER, parts: int = PARTS) -> DataFrame:
    """source, w (whole parts) for counts (source, n).  Sources that `weights` does not name weigh as the smallest that it names."""
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temper))
        total = counts.agg(F.sum(share)).first()[0] or 1.0
        return counts.select("source", F.greatest(F.lit(1), F.round(share * parts / total)).cast("long").alias("w"))
    given = whole_parts(weights)
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return counts.select("source", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(min(given.values())).cast("long")).alias("w"))


def schedule(classes: DataFrame, period: int) -> DataFrame:
    """w, m, slots: the slots of the blocks of each class (w parts, m sources) in one period, in the order in which they run.

    Block j of a class is the (j div m)-th of its source j mod m.  A fold over
    the slots of the period; its state is a number for each class.
    """
    row = classes.agg(F.sort_array(F.collect_list(F.struct(F.col("w").cast("long").alias("w"), F.col("m").cast("long").alias("m")))).alias("s")).where("size(s) > 0")
    step = f"""
      aggregate(sequence(0, {-(-period // STRETCH)} - 1), named_struct('done', transform(s, x -> 0L), 'ran', cast(array() as array<array<int>>)),
        (all, c) -> transform(array(
          aggregate(sequence(c * {STRETCH}, least((c + 1) * {STRETCH}, {period}) - 1), named_struct('done', all.done, 'ran', cast(array() as array<int>)),
            (st, t) -> transform(array(array_min(transform(s, (x, i) ->
                if(st.done[i] div x.m * {period}L div x.w <= t and st.done[i] < x.w * x.m,
                   named_struct('due', ((st.done[i] div x.m + 1) * {period}L + x.w - 1) div x.w, 'i', i), null)))),
              best -> named_struct('done', transform(st.done, (d, i) -> d + if(i = best.i, 1L, 0L)), 'ran', concat(st.ran, array(best.i))))[0])),
          part -> named_struct('done', part.done, 'ran', concat(all.ran, array(part.ran))))[0],
        all -> flatten(all.ran))"""
    ran = row.select("s", F.posexplode(F.expr(step)).alias("slot", "i")).select(F.expr("get(s, i).w").alias("w"), F.expr("get(s, i).m").alias("m"), F.col("slot").cast("int").alias("slot"))
    return ran.groupBy("w", "m").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, parts: int = PARTS) -> DataFrame:
    """Give every row of `docs` (doc_id, source) its place in the mixture.

    weights: targets in any unit; only their proportion counts.  Without them a
    source's target is a whole number of parts that follows its rows to the
    power of TEMPER, of about `parts` in all.

    Returns doc_id, source, block (of its source), slot, release, deadline (of
    the block, in slots over the whole schedule) and place (within the block).
    Reading rows by (slot, place) gives the mixture: until a source runs dry,
    each has less than one block more or less than its target at every slot;
    from then on the others go on in the proportion of their weights.  No row
    is dropped or repeated.  Rows of a source are in hash order of doc_id; rows
    that share a doc_id, or have none, follow each other in no fixed order, each
    at a place of its own.  Null sources are one source; an empty table gives an
    empty result.
    """
    with Scratch(spark, "mixing") as scratch:
        rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.monotonically_increasing_id().alias("id"))
        placed = _placed(scratch, scratch.store(rows, "ids", keep=True), weights, block_rows, parts)
        return placed.select("doc_id", "source", "block", "slot", "release", "deadline", "place")


def _placed(scratch: Scratch, rows: DataFrame, weights: dict[str, float] | None, block_rows: int, parts: int) -> DataFrame:
    """`rows` (doc_id, source, id and others) with the columns of `mix`; rows with equal ids are interchangeable."""
    sources = scratch.store(weighted(scratch.store(rows.groupBy("source").agg(F.count("*").alias("n")), "counts"), weights, parts=parts), "weights")
    classes = scratch.store(sources.groupBy("w").agg(F.count("*").alias("m")), "classes")
    period, many = classes.agg(F.sum(F.col("w") * F.col("m")), F.sum("m")).first()
    period, many = period or 1, many or 0
    if period > MOST_PARTS:
        raise ValueError(f"the weights have no common measure below 1/{MOST_PARTS}: give them with fewer digits")
    plan = scratch.store(schedule(classes, period), "period", keep=True)
    # sources of a class are numbered by hash, in cells: none sorts all of them
    hashed = sources.select("source", "w", F.xxhash64("source").alias("id"))
    hashed = scratch.store(hashed, "sources")
    own = numbered(scratch, hashed, ["w"], [F.col("id"), F.asc_nulls_first("source")], F.shiftrightunsigned("id", 64 - (CELLS.bit_length() - 1)), "nth")
    own = scratch.store(own.select(F.col("source").alias("_source"), F.col("w").alias("_w"), "nth"), "numbers", keep=True)

    columns = rows.columns
    rows = rows.withColumn("_h", F.xxhash64("doc_id"))
    cell = F.shiftrightunsigned("_h", 64 - (CELLS.bit_length() - 1))
    rows = numbered(scratch, rows, ["source"], [F.expr("_h & 4503599627370495"), F.col("doc_id")], cell, "_number")
    rows = rows.withColumn("block", F.expr(f"_number div {block_rows}")).withColumn("place", F.expr(f"cast(_number % {block_rows} as int)"))
    rows = rows.join(F.broadcast(own) if many <= MOST_BROADCAST else own, F.col("source").eqNullSafe(F.col("_source")))
    if period <= BROADCAST_PARTS:
        rows = rows.join(F.broadcast(plan), F.col("_w") == F.col("w")).withColumn("at", F.expr("slots[cast(block % w * m + nth as int)]"))
    else:
        slots = plan.select("w", "m", F.posexplode("slots").alias("j", "at"))
        rows = rows.join(plan.select(F.col("w").alias("_c"), F.col("m").alias("_m")), F.col("_w") == F.col("_c"))
        rows = rows.join(slots, (F.col("_w") == F.col("w")) & (F.expr("block % _w * _m + nth") == F.col("j")))
    slot = F.expr(f"block div w * {period} + at").alias("slot")
    return rows.select(*columns, "block", slot, F.expr(f"block * {period} div w").alias("release"), F.expr(f"((block + 1) * {period} + w - 1) div w").alias("deadline"), "place")


def in_mixture_order(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs` with its own columns, its rows range-partitioned and sorted by place in the mixture.

    Every row has a place of its own, whatever repeats or is null in it; other
    columns may have any names.  An empty table stays empty.
    """
    with Scratch(spark, "mixture") as scratch:
        # rows are told apart by all they hold (maps aside): those that can't be are interchangeable
        held = [quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
        rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(*held).alias("id"))
        placed = _placed(scratch, rows, weights, BLOCK_ROWS, PARTS)
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
