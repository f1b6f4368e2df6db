"""Sharding by a consistent-hash ring with bounded loads (DataFrame functions only).

Each shard has virtual nodes on a ring; a key belongs to the next virtual node
clockwise.  Shards take at most their capacity: arcs are served in ring order,
and the keys of an arc that its shard has no room for continue clockwise to
the next shards that have.  With no slack, capacities sum to the number of
rows, so shards differ by at most one row; with slack, fewer keys overflow.

Which keys overflow is decided on counts for each arc, a table whose size is
set by shards and virtual nodes; keys then find their shard by their rank in
their arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered
from .storage import Scratch

VIRTUAL_NODES = 64
RING_BITS = 40
#: The ring's cells: units that are counted and sorted on their own.
CELL_BITS = 12


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """arc, shard, lo, hi: positions lo <= p < hi go to virtual node `arc`; the last arc wraps to arc 0."""
    nodes = spark.range(0, shards * virtual_nodes, 1, 1).select(F.expr(f"cast(id div {virtual_nodes} as int)").alias("shard"), F.shiftrightunsigned(F.xxhash64(F.expr(f"cast(id div {virtual_nodes} as int)"), F.expr(f"cast(id % {virtual_nodes} as int)"), F.lit("node")), 64 - RING_BITS).alias("at"))
    around = W.partitionBy(F.lit(1)).orderBy("at", "shard")
    nodes = nodes.select("shard", "at", (F.row_number().over(around) - 1).alias("arc"), F.lag("at").over(around).alias("before"))
    arcs = nodes.select("arc", "shard", F.coalesce(F.col("before") + 1, F.lit(0)).alias("lo"), (F.col("at") + 1).alias("hi"))
    tail = nodes.agg(F.max("at").alias("m"), F.min_by("shard", F.struct("at", "shard")).alias("shard")).select(F.lit(0).alias("arc"), "shard", (F.col("m") + 1).alias("lo"), F.lit(1 << RING_BITS).alias("hi"))
    return arcs.union(tail).where("lo < hi")


def allocate(spark: SparkSession, counts: DataFrame, nodes: DataFrame, shards: int, virtual_nodes: int, slack: float) -> DataFrame:
    """arc, shard, lo, hi, start: keys of rank lo <= r < hi in their arc go to shard, at slots from start.

    counts: arc, n.  A fold over the arcs in ring order, each with the shards
    in the order met clockwise from it; its size is that of the ring.
    """
    order = nodes.groupBy("arc").agg(F.first("shard").alias("shard")).agg(F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard"))), lambda x: x.shard).alias("ring"))
    demand = nodes.select("arc").distinct().join(F.broadcast(counts), "arc", "left").agg(F.array_sort(F.collect_list(F.struct("arc", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("demand"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))
    row = demand.crossJoin(order)  # one row each
    room = f"rows div {shards} + if(i < rows % {shards}, 1L, 0L)" if not slack else f"cast(ceil(rows * {1 + slack} / {shards}) as bigint)"
    row = row.withColumn("room", F.expr(f"transform(sequence(0, {shards} - 1), i -> {room})"))
    row = row.withColumn("steps", F.expr("transform(demand, (d, i) -> named_struct('arc', d.arc, 'n', d.n, 'next', array_distinct(concat(slice(ring, i + 1, size(ring)), slice(ring, 1, i)))))"))
    fold = """
      aggregate(steps, named_struct('room', room, 'got', cast(array() as array<struct<arc:int,shard:int,lo:bigint,n:bigint>>)),
        (st, a) -> transform(array(aggregate(a.next, named_struct('left', a.n, 'took', cast(array() as array<struct<arc:int,shard:int,lo:bigint,n:bigint>>)),
              (w, s) -> if(w.left = 0 or st.room[s] = 0, w,
                named_struct('left', w.left - least(w.left, st.room[s]),
                  'took', concat(w.took, array(named_struct('arc', a.arc, 'shard', s, 'lo', a.n - w.left, 'n', least(w.left, st.room[s])))))))),
            w -> named_struct(
              'room', transform(st.room, (r, s) -> r - aggregate(w.took, 0L, (x, k) -> x + if(k.shard = s, k.n, 0L))),
              'got', concat(st.got, w.took)))[0],
        st -> st.got)"""
    got = row.select(F.explode(F.expr(fold)).alias("x")).select("x.arc", "x.shard", "x.lo", "x.n")
    before = W.partitionBy("shard").orderBy("arc", "lo").rowsBetween(W.unboundedPreceding, -1)
    return got.select("arc", "shard", "lo", (F.col("lo") + F.col("n")).alias("hi"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Put every row of `docs` (doc_id, text) into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 8, text_crc32 the
    CRC-32 of these bytes.  The law is `rows`: without slack, counts differ by
    one at most; with slack s, none exceeds ceil((1 + s) * rows / shards).
    slot counts 0, 1, ... within the shard; grown_shard is null, as under this
    law other rows may move too when a shard is added.  Equal texts are not
    kept together: a group of copies can exceed any shard.  Keys are doc_ids;
    null doc_ids share one ring position and repeated ones share theirs, and
    are ordered by their texts' checksum and size where few share a position.
    An empty table gives an empty result.
    """
    with Scratch(spark, "sharding") as scratch:
        at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - RING_BITS)
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), at.alias("_at"), F.monotonically_increasing_id().alias("id"))
        nodes = scratch.store(ring(spark, shards, virtual_nodes), "ring", keep=True)
        # the ring has shards * virtual_nodes + 1 arcs, cut at cells: a broadcast of bounded size
        width = 1 << (RING_BITS - CELL_BITS)
        pieces = nodes.select("arc", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("_cell"))
        rows = rows.withColumn("_cell", F.expr(f"_at div {width}")).join(F.broadcast(pieces), "_cell").where("_at >= lo and _at < hi").drop("lo", "hi")
        rows = scratch.store(rows, "keys", keep=True)
        counts = rows.groupBy("arc").agg(F.count("*").alias("n"))
        plan = scratch.store(allocate(spark, counts, nodes, shards, virtual_nodes, slack).coalesce(1), "plan", keep=True)
        # the last arc's tail comes after its head: cells rise along the ring
        rows = numbered(scratch, rows, ["arc"], [F.col("_at"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("_cell"), "_rank")
    rows = rows.join(F.broadcast(plan.withColumnRenamed("arc", "_arc")), (F.col("arc") == F.col("_arc")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("_rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
