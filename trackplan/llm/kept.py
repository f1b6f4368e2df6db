"""Dropping rows of a table by decisions on (doc_id, text), where neither need be unique."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, whole_row

#: Words of 64 bits in the filter of ids that are asked for: the most rows of its broadcast.
FILTER_WORDS = 1 << 17


def marked(rows: DataFrame, at: str, ids: DataFrame) -> DataFrame:
    """`rows` with _likely: false only if the value of column `at` is not in `ids` (id, nulls equal).

    A broadcast bit map of hashes, FILTER_WORDS rows at most however large `ids`
    is; where it fills up, more rows are likely.
    """
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(8)), F.lit(64 * FILTER_WORDS))
    word, bit = lambda c: F.floor(slot(c) / 64), lambda c: (slot(c) % 64).cast("int")
    bits = ids.select(word("id").alias("_w"), bit("id").alias("_b")).selectExpr("_w", "shiftleft(1L, _b) AS _bits")
    bits = bits.groupBy("_w").agg(F.bit_or("_bits").alias("_bits"))
    held = rows.withColumn("_word", word(at)).join(F.broadcast(bits), F.col("_word") == F.col("_w"), "left")
    return held.select(*rows.columns, F.coalesce(F.getbit("_bits", bit(at)) == 1, F.lit(False)).alias("_likely"))


def kept_rows(scratch: Scratch, docs: DataFrame, key: Callable[[Column], Column], decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    key: a hash of a text.  decisions: doc_id, key, stays, one row for
    each row of `docs`.  Rows that share doc_id and key stay or go together, and
    of those that stay one does (any: they are alike in what was decided on).
    Doc_ids may be null; rows that go, and keys that repeat, are stored, and
    only their keys meet the table.
    """
    keys = decisions.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("times"))
    keys = scratch.store(keys.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "stays"), "decisions", keep=True)
    again = keys.where("stays")
    rows = marked(docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "doc_id", keys.select(F.col("_id").alias("id")))
    # most rows are known to stay by their doc_id alone: the others are hashed and shuffled
    asked = rows.where("_likely").select("row", "doc_id", key(F.col("row.text")).alias("key"))

    def meet(some: DataFrame, how: str) -> DataFrame:
        return asked.join(some, asked["doc_id"].eqNullSafe(some["_id"]) & (asked["key"] == some["_key"]), how)

    out = rows.where("not _likely").select("row").union(meet(keys, "left_anti").select("row"))
    if not again.isEmpty():
        once = meet(again, "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row"))
        out = out.union(once.select("row"))
    return out.select("row.*")
