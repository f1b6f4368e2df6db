"""Texts of number signs, texts longer than one pass, empty tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackplan.llm import langid, sharding, toxicity, warc

FOLDER = "/root/testdata/sf0.001"


def test_language_of_signs_and_long_texts(spark, monkeypatch):
    """Number signs are no letters; a text of many passes has the language and score of its passes together."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("lang = 'de' and n_chars > 400").orderBy("doc_id").limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.repeat("text", 900).alias("text"), "lang", "source")
    signs = spark.createDataFrame([(-1, "½ ² ①"), (-2, "Ⅷ 12 ३"), (-3, "１２"), (-4, "a"), (-6, "語")], "doc_id long, text string").select("doc_id", "text", F.lit("de").alias("lang"), F.lit("s").alias("source"))
    found = {r.doc_id: r for r in langid.language_of_documents(spark, docs.select("doc_id", "text", "lang", "source").union(signs).union(some)).collect()}
    assert [found[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3
    assert all(found[d].lang_pred != "und" for d in (-4, -6))
    assert found[-5].lang_pred == "de" and 0 <= found[-5].score <= 1


def test_archives_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, pages).count() == 0


def test_rows_in_buckets_are_not_moved(spark):
    """What exact dedup rests on: texts in buckets of blocks meet a table of blocks without an exchange of their own."""
    from trackplan.llm.storage import Scratch

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark, "buckets") as scratch:
            rows = spark.range(1000).select((F.col("id") % 17).alias("block"), F.col("id").cast("string").alias("text"), (F.col("id") % 2).cast("int").alias("kind"))
            kept = scratch.bucketed(rows, "rows", ["block"], 4, by="kind").where("kind = 0")
            marks = spark.range(17).select(F.col("id").alias("block"), F.lit(1).alias("mark"))
            joined = kept.join(marks.hint("shuffle_hash"), "block")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert joined.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_at_the_edges(spark, docs, no_docs):
    """Nulls, empty and long texts, repeated rows, labels without a document; equal texts score alike; no rows, no labels."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(13)] + [(None, 1), (500, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity_of_documents(spark, docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    scores = {}
    for r, t in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        assert r.doc_id == t.doc_id
        scores.setdefault(t.text or "", set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in scores.values())
    assert toxicity.toxicity_of_documents(spark, no_docs, labels).count() == 0
    assert toxicity.toxicity_of_documents(spark, docs, labels.where("doc_id = -1")).count() == docs.count()


def walked(spark, n, shards, slack):
    """Keys of each (arc, shard) by a walk along the ring, arc by arc, to the next shards with room."""
    nodes = sorted(map(tuple, sharding.ring(spark, shards).select("arc", "shard", "lo", "hi").collect()))
    ring = [s for _, s in sorted({(a, s) for a, s, _, _ in nodes})]
    at = [r.p for r in spark.range(n).select(F.shiftrightunsigned(F.xxhash64("id"), 64 - sharding.RING_BITS).alias("p")).collect()]
    keys = Counter(next(a for a, _, lo, hi in nodes if lo <= p < hi) for p in at)
    room = [n // shards + (k < n % shards) if not slack else math.ceil((1 + slack) * n / shards) for k in range(shards)]
    out = Counter()
    for arc in range(len(ring)):
        left = keys[arc]
        for shard in ring[arc:] + ring[:arc]:
            took = min(left, room[shard])
            out[arc, shard] += took
            room[shard] -= took
            left -= took
    return nodes, at, Counter({k: v for k, v in out.items() if v})


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_shards_by_walking_the_ring(spark, slack):
    """Bounded loads: what a full shard has no room for goes on clockwise."""
    n, shards = 3000, 5
    nodes, at, expected = walked(spark, n, shards, slack)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.shard_documents(spark, rows, shards=shards, slack=slack).collect()
    assert Counter((next(a for a, _, lo, hi in nodes if lo <= at[r.doc_id] < hi), r.shard) for r in found) == expected


def test_movement_with_slack(spark):
    """One shard more takes about its share, and with slack next to nothing moves between the others."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.shard_documents(spark, rows, shards=k, slack=0.25).collect()} for k in (24, 25))
    moved = [d for d in before if before[d] != after[d]]
    assert len(moved) < 0.06 * len(before) and sum(after[d] != 24 for d in moved) < 0.005 * len(before)
