"""What near-duplicate detection does no more often than it has to: confirmations, shuffles and stored tables of narrow rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplan.llm import components, minhash, storage
from trackplan.llm.shingles import signatures


def group(sets):
    sets = [np.sort(np.array(s, dtype=np.uint64)) for s in sets]
    return signatures(sets, minhash.SIZE), np.array([len(s) for s in sets]), sets


@pytest.fixture
def confirmed(monkeypatch):
    """Numbers of links that were confirmed pair by pair."""
    calls = []
    common = minhash._common
    monkeypatch.setattr(minhash, "_common", lambda a, b: calls.append(1) or common(a, b))
    return calls


def test_component_is_met_once(confirmed):
    """Documents outside a component of 150 are linked with it by one confirmation each, and edges are between components."""
    sig, n, sets = group([range(k, 400 + k) for k in range(10)] + [range(k % 7, 400 + k % 7) for k in range(150)])
    docs = np.arange(1000, 1160)
    side, label = np.array([0] * 10 + [1] * 150), np.array([*range(1000, 1010), *[5] * 150])
    edges = minhash._link(docs, sig, n, 85, sets, side, label)
    assert edges == {(k, 5) for k in range(1000, 1010)} and len(confirmed) == 10


def test_candidates_without_links_are_confirmed_together(confirmed):
    """A few confirmations pair by pair for a document, the rest at once, with the links that all pairs have."""
    rng = np.random.default_rng(3)
    kept = [np.concatenate((rng.permutation(300)[: 300 - k % 40], 1000 * (k + 1) + np.arange(k % 40))) for k in range(120)]
    sig, n, sets = group(kept)
    edges = minhash._link(np.arange(120), sig, n, 85, sets, None, None)
    up = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert edges == {(i, r) for i, r in enumerate(up) if i != r}
    assert 0 < len(confirmed) <= minhash.FEW * 120 and len({*up}) > 10


def test_round_of_components(spark):
    """Half a round reads edges without a union, and leaves no repeats that would meet at a hub."""
    edges = spark.range(40).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    moved = components._smaller_to_smallest(edges.union(edges.where("u = 7")).localCheckpoint())
    assert moved.count() == 40 and "Union" not in moved._jdf.queryExecution().optimizedPlan().toString()
    with storage.Scratch(spark, "stars") as scratch:
        found = components.stars(scratch, edges.union(edges)).collect()
    assert sorted((r.node, r.component) for r in found) == [(k, 0) for k in range(1, 41)]


def test_components_merged_across_blocks(spark):
    """Components that only the comparison of blocks joins take their members, and centres, along."""
    base = [f"x{k}" for k in range(60)]
    rows = [(500 - k, " ".join([*base[: 59 - k % 2], f"y{k}"])) for k in range(40)] + [(k, " ".join([*base[:56], f"u{k}", "v", "w", "z"])) for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = ({r.doc_id: r.component_id for r in minhash.near_duplicates(spark, table, cap_docs=c, cap_shingles=100_000).collect()} for c in (1000, 4))
    assert whole == parts and len(parts) == 70
