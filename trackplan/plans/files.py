"""Queries over trees of files, which they write from the given tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queue
from ..sources import tables
from ..sources.shared import shared_place
from ..sources.tables import table
from ..sources.tree import readable, tree
from .catalog import query


def written(files: DataFrame, root: str) -> None:
    """Write files (path, content: binary; null: a link that leads nowhere) under a root, in tasks."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = root.removeprefix("file://")
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                whole = os.path.join(base, path)
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                if os.path.lexists(whole):  # a task that is run again
                    os.unlink(whole)
                if content is None:
                    os.symlink(f"{whole}-gone", whole)
                else:
                    with open(whole, "wb") as file:
                        file.write(content)
            yield pd.DataFrame({"n": [len(rows)]})

    files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()


_TREE_PATH = "'t' || doc_id % 6 || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '/s' || doc_id % 4 END || '/' || CASE WHEN doc_id % 11 = 3 THEN '._' ELSE '' END || 'doc' || doc_id || '.' || (['mkv', 'AVI', 'txt', 'mp4'])[doc_id % 4 + 1]"
_TREE = f"(SELECT *, doc_id % 13 = 5 AS lost, octet_length(encode(coalesce(text, ''))) AS bytes, {_TREE_PATH} AS path FROM documents)"
_STATE = "CASE WHEN lost THEN 'unreadable' WHEN doc_id % 4 <> 2 AND doc_id % 11 <> 3 AND bytes >= 500 THEN 'queued' ELSE 'passed over' END"


def _document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files in folders of two levels; some hidden, some links that lead nowhere."""
    root = shared_place(spark, "tree")
    key = F.col("doc_id")
    ending = F.get(F.array(*map(F.lit, ("mkv", "AVI", "txt", "mp4"))), (key % 4).cast("int"))
    parts = [F.lit("t"), (key % 6).cast("string"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("/s"), (key % 4).cast("string"))), F.lit("/"), F.when(key % 11 == 3, "._").otherwise(""), F.lit("doc"), key.cast("string"), F.lit("."), ending]
    content = F.when(key % 13 != 5, F.coalesce("text", F.lit("")).cast("binary"))
    written(table(spark, folder, "documents").select(F.concat(*parts).alias("path"), content.alias("content")), root)
    return tree(spark, root, tasks=16)


def _states(entries: DataFrame, least: int) -> DataFrame:
    """Every entry of a listing with what becomes of it."""
    read, lost = readable(entries)
    queued = queue.scannable(read, least=least).select("path", F.lit("queued").alias("state"))
    read = read.join(queued, "path", "left").select("top", "path", "size", F.coalesce("state", F.lit("passed over")).alias("state"))
    return read.union(lost.select("top", "path", F.lit(None).cast("long"), F.lit("unreadable")))


@query(f"SELECT split_part(path, '/', 1) AS top, path, CASE WHEN NOT lost THEN CAST(bytes AS BIGINT) END AS size, {_STATE} AS state FROM {_TREE}")
def tree_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of files: what is queued, passed over or can't be read."""
    return _states(_document_tree(spark, folder), 500)


@query(f"SELECT path, CAST(bytes AS BIGINT) AS size FROM {_TREE} WHERE NOT lost AND doc_id % 6 IN (1, 4)")
def tree_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Two of the first folders: no partition is planned for the others."""
    read, _ = readable(_document_tree(spark, folder).where(F.col("top").isin("t1", "t4")))
    return read.select("path", "size")


@query("""
SELECT 'g' || c_custkey % 5 || '/c' || c_custkey || '.conf' AS path, k AS key, v AS value, NULL AS error FROM (
  SELECT c_custkey, unnest(['owner', 'cq', 'enabled']) AS k, unnest([split_part(c_name, '#', 1), CAST(c_custkey % 50 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'Off' ELSE 'a = b' END]) AS v FROM customer WHERE c_custkey % 17 NOT IN (3, 4))
UNION ALL SELECT 'g' || c_custkey % 5 || '/c' || c_custkey || '.conf', NULL, NULL, CASE c_custkey % 17 WHEN 3 THEN 'not UTF-8' ELSE 'No such file or directory' END FROM customer WHERE c_custkey % 17 IN (3, 4)""")
def tree_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings files of customers: comments (names hold a #), repeated keys and broken files; other files are not opened."""
    root = shared_place(spark, "settings")
    key = F.col("c_custkey")
    text = F.concat_ws("\n", F.lit("# settings"), F.concat(F.lit("Owner = "), "c_name"), F.lit("CQ = 99"), F.lit(""), F.concat(F.lit("cq="), (key % 50).cast("string"), F.lit("  # later wins")), F.concat(F.lit("ENABLED = "), F.when(key % 3 == 0, "Off").otherwise("a = b")), F.lit("nonsense"))
    path = F.concat(F.lit("g"), (key % 5).cast("string"), F.lit("/c"), key.cast("string"), F.lit(".conf"))
    content = F.when(key % 17 == 3, F.lit(b"cq = 1\n\xff\xfe")).when(key % 17 != 4, text.cast("binary"))
    rows = table(spark, folder, "customer")
    other = rows.select(F.concat(path, F.lit(".old")).alias("path"), F.lit(b"\xff").alias("content"))
    written(rows.select(path.alias("path"), content.alias("content")).union(other), root)
    read, lost = readable(tree(spark, root, "lines", tasks=4).where(F.col("path").endswith(".conf")))
    found = tables.settings(read, ["path"]).select("path", "key", "value", F.lit(None).cast("string").alias("error"))
    return found.union(lost.select("path", F.lit(None).cast("string"), F.lit(None).cast("string"), "error"))


@query("""
SELECT 's' || s_suppkey % 3 || '/' || s_suppkey || '.json' AS path, CAST(60 * (s_suppkey % 90 + 1) AS DOUBLE) AS dur, 1920 - 8 * (s_suppkey % 4) AS w, CASE WHEN s_suppkey % 5 = 0 THEN 'hdr10' ELSE 'sdr' END AS hdr FROM supplier WHERE s_suppkey % 7 <> 0""")
def tree_records(spark: SparkSession, folder: str) -> DataFrame:
    """Probe records read from files, the unreadable ones aside."""
    root = shared_place(spark, "records")
    key = F.col("s_suppkey")
    json = F.format_string('{"streams":[{"index":0,"codec_type":"video","codec_name":"hevc","width":%d,"height":800,"avg_frame_rate":"24/1","color_transfer":"%s"}],"format":{"duration":"%d","bit_rate":"500000"}}', 1920 - 8 * (key % 4), F.when(key % 5 == 0, "smpte2084").otherwise("bt709"), 60 * (key % 90 + 1))
    path = F.concat(F.lit("s"), (key % 3).cast("string"), F.lit("/"), key.cast("string"), F.lit(".json"))
    content = F.when(key % 14 == 0, F.lit(b"{\xff")).when(key % 7 == 0, F.lit(b'{"streams": [')).otherwise(json.cast("binary"))
    written(table(spark, folder, "supplier").select(path.alias("path"), content.alias("content")), root)
    read, _ = readable(tree(spark, root, "texts", tasks=4))
    return tables.probed(read, "value").select("path", "dur", "w", "hdr")
