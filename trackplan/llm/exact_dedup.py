"""Exact duplicates by exchanging Golomb-coded fingerprints.

A sender (a block of documents of one partition) sorts short fingerprints of
its texts, splits them by owner (a range of fingerprints) and sends each owner
the Golomb-coded gaps, each fingerprint once, with a bitmap of those that occur
again in the block.  Owners answer with a bitmap of the fingerprints that occur
twice or more, which becomes a bitmap of the block's rows.  The rows lie stored
with their texts in buckets of blocks: suspects are found there, and only they
are shuffled with their texts, which are then compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import bounds, grouped
from .kept import kept_rows
from .storage import Scratch, small_batches

#: Bits of a fingerprint: false suspects are about rows / 2**40 of all rows.
FINGERPRINT_BITS = 40
#: Documents of a sender: with few large blocks and owners, messages hold many fingerprints each however many rows there are.
BLOCK_ROWS = 1 << 18
#: Rows for which there is one owner more, so that what an owner holds doesn't grow with the table.
OWNER_ROWS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SENT = "kind int, block long, n int, doc_id long, sha binary, text binary, owner int, count int, shift int, quotients binary, remainders binary, again binary"
_KINDS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("owner", pa.int32()), ("count", pa.int32()), ("shift", pa.int32()), ("quotients", pa.binary()), ("remainders", pa.binary()), ("again", pa.binary())])


def golomb(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted unsigned values as gaps: (shift, unary quotients, binary remainders).

    The divisor is 2**shift, the power of two next below the mean gap.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    shift = max(0, int(values[-1]) // len(values)).bit_length() - 1 if int(values[-1]) >= len(values) else 0
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(shift, dtype=np.uint64)
    rest = (gaps[:, None] >> places[None, :]) & np.uint64(1)
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def ungolomb(count: int, shift: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The values that `golomb` coded."""
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:count]
    gaps = np.diff(zeros, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(shift)
    if shift:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=count * shift).reshape(count, shift)
        gaps |= (bits.astype(np.uint64) << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _KINDS], schema=_KINDS)


def _send(owners: int, block_rows: int):
    """Rows with their texts (kind 0), messages to owners (kind 1), and where each row of a block stands in them (kind 2)."""

    def messages(block: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        distinct, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        owner = ((distinct * np.uint64(owners)) >> np.uint64(FINGERPRINT_BITS)).astype(np.int32)
        sent, starts = np.unique(owner, return_index=True)
        ends = np.append(starts[1:], len(distinct))
        slot = (np.arange(len(distinct)) - np.repeat(starts, ends - starts)).astype(np.int32)
        coded = [golomb(distinct[a:b]) for a, b in zip(starts, ends, strict=True)]
        again = [np.packbits(times[a:b] > 1).tobytes() for a, b in zip(starts, ends, strict=True)]
        k = len(sent)
        yield _rows({"kind": [1] * k, "block": [block] * k, "owner": sent, "count": ends - starts, "shift": [c[0] for c in coded], "quotients": [c[1] for c in coded], "remainders": [c[2] for c in coded], "again": again})
        yield _rows({"kind": [2], "block": [block], "quotients": [owner[place].tobytes()], "remainders": [slot[place].tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        prints: list[int] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block_rows - len(prints))
                at += some.num_rows
                shas = [hashlib.sha256((t or b"").lower()).digest() for t in some.column(1).to_pylist()]
                k = len(shas)
                yield _rows({"kind": [0] * k, "block": [block] * k, "n": np.arange(len(prints), len(prints) + k), "doc_id": some.column(0), "sha": shas, "text": some.column(1)})
                prints += [int.from_bytes(x[:8], "big") >> (64 - FINGERPRINT_BITS) for x in shas]
                if len(prints) >= block_rows:
                    yield from messages(block, np.array(prints, dtype=np.uint64))
                    block, prints = block + 1, []
        if prints:
            yield from messages(block, np.array(prints, dtype=np.uint64))

    return run


def _suspects(places: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's bitmap of rows, from its owners' bitmaps of fingerprints."""
    if not places.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "bitmap": pa.array([], pa.list_(pa.int64()))})
    owner, slot = (np.frombuffer(places.column(c)[0].as_py(), dtype=np.int32) for c in ("owners", "slots"))
    suspect = np.zeros(-(-len(owner) // 64) * 64, dtype=np.uint8)
    for o, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
        mine = np.flatnonzero(owner == o)
        suspect[mine] = np.unpackbits(np.array(bitmap, dtype="<i8").view(np.uint8), bitorder="little")[slot[mine]]
    return pa.table({"block": places.column("block").slice(0, 1), "bitmap": pa.array([np.packbits(suspect, bitorder="little").view("<i8").tolist()], pa.list_(pa.int64()))})


def answers_of_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's bitmaps: bit k of (block, owner) says that the block's k-th fingerprint occurs elsewhere or again there."""
    for batch in grouped(batches, ["owner"]):
        blocks, owners, maps = [], [], []
        for a, b in bounds(batch, ["owner"]):
            rows = batch.slice(a, b - a).to_pylist()
            each = [ungolomb(r["count"], r["shift"], r["quotients"], r["remainders"]) for r in rows]
            values, where, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            elsewhere = np.split(times[where] > 1, np.cumsum([len(e) for e in each])[:-1])
            for r, bits in zip(rows, elsewhere, strict=True):
                bits = bits | np.unpackbits(np.frombuffer(r["again"], np.uint8), count=r["count"]).astype(bool)
                if bits.any():
                    blocks.append(r["block"])
                    owners.append(r["owner"])
                    padded = np.zeros(-(-len(bits) // 64) * 64, dtype=np.uint8)
                    padded[: len(bits)] = bits
                    maps.append(np.packbits(padded, bitorder="little").view("<i8").tolist())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(owners, pa.int32()), pa.array(maps, pa.list_(pa.int64()))], names=["block", "owner", "bitmap"])


def exact_duplicates(spark: SparkSession, docs: DataFrame, block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    keep_id is the largest doc_id of the group.  Rows of a group that repeat its
    keep_id are all kept; if all doc_ids of a group are null its keep_id is null
    and its rows are kept.  Other columns are not read; an empty table gives an
    empty result.  Owners are as many as shuffle partitions, or one for each
    `owner_rows` rows if that is more.
    """
    with Scratch(spark, "exact") as scratch:
        return _exact(scratch, docs, block_rows, owner_rows)


def _exact(scratch: Scratch, docs: DataFrame, block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    spark = scratch.spark
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(tasks, -(-docs.count() // owner_rows))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    sent = scratch.bucketed(texts.mapInArrow(_send(owners, block_rows), _SENT), "sent", ["block"], tasks, by="kind")
    messages = sent.where("kind = 1").select("owner", "block", "count", "shift", "quotients", "remainders", "again")
    answers = messages.repartition(tasks, "owner").sortWithinPartitions("owner", "block").mapInArrow(answers_of_owners, "block long, owner int, bitmap array<long>")
    places = sent.where("kind = 2").select("block", F.col("quotients").alias("owners"), F.col("remainders").alias("slots"))
    marks = places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_suspects, "block long, bitmap array<long>")
    marks = scratch.store(marks, "bitmaps")
    # a row for each block: texts stay in their buckets, and meet a table of these
    rows = sent.where("kind = 0").join(marks.hint("shuffle_hash"), "block")
    suspect = F.expr("getbit(bitmap[n div 64], n % 64) = 1")
    asked = scratch.store(rows.where(suspect).select("doc_id", "sha", "text"), "suspects", keep=True)
    suspects = asked.select("doc_id", "sha")
    alone = scratch.store(rows.where(~suspect).select("doc_id", "sha"), "others", keep=True)
    same = asked.select(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias("text"))
    same = same.groupBy("text").agg(F.lit(1).alias("one")).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    verified = same.groupBy("sha").agg(F.count("*").alias("texts"))
    groups = suspects.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).join(verified, "sha")
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    groups = scratch.store(groups.select("sha", "keep_id", checked.cast("long").alias("group_size")), "groups", keep=True)
    alone = alone.select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    both = alone.union(suspects.join(groups, "sha").select("doc_id", "sha", "keep_id", "group_size"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts of `docs`, with all its columns: that of the largest doc_id.

    Rows with null doc_ids come after all others; of rows that repeat doc_id
    and text any one stays, and neither null nor repeated doc_ids keep or drop
    rows of other texts.  Null and empty texts are equal.  Other columns may
    have any names; an empty table stays empty.
    """
    sha = lambda text: F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256))
    with Scratch(spark, "exact-rows") as scratch, Scratch(spark, "exact", brief=True) as brief:
        found = _exact(brief, docs).select("doc_id", F.unhex("text_sha256").alias("key"), F.col("kept").alias("stays"))
        return kept_rows(scratch, docs, sha, found)
