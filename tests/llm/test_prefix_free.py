"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from trackplan.llm import prefix_free


def expected(rows, width):
    """By the definition; rows of one doc_id must be alike."""
    known, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            if window in known:
                gone[i : i + width] = [True] * width
            known.add(window)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, width, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, prefix_free.repeated_passages(spark, docs, width=width, **limits).collect()), key=repr)


def repetitive(rnd, n):
    """Documents of shared passages, cut anywhere, with other text between; copies, edits and runs of one letter."""
    passages = ["".join(rnd.choices("abcdé ", k=rnd.randint(20, 200))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            parts += [p[a : a + rnd.randint(1, 200)], "".join(rnd.choices("xyz", k=rnd.randint(0, 30)))]
        rows.append(((k * 7919) % 1000, "".join(parts) + rnd.choice(["", "", "q" * rnd.randint(0, 150)])))
    return rows


@pytest.mark.parametrize(("width", "limits"), [(30, {}), (7, {}), (100, {}), (30, {"block_bytes": 300}), (30, {"most_phrases": 3}), (8, {"block_bytes": 500, "most_phrases": 1})])
def test_passages(spark, width, limits):
    """Blocks of one and of several documents; triggers of many phrases are grouped window by window."""
    rows = repetitive(random.Random(width), 80)
    assert found(spark, rows, width, **limits) == expected(rows, width)


def test_every_window_is_in_one_phrase(monkeypatch):
    """In passes of any length; equal windows have equal triggers."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab", k=rnd.randint(0, 300))).encode() for _ in range(20)]
    data, starts, ends = prefix_free._edges(texts)
    for piece in (prefix_free.PIECE, 64, 7):
        monkeypatch.setattr(prefix_free, "PIECE", piece)
        first, last, trigger, hashes = prefix_free.phrases(data, starts, ends, 20)
        windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert windows.tolist() == [i for a, b in zip(starts, ends, strict=True) for i in range(a, b - 19)]
        seen = {}
        for a, b, t, h in zip(first, last, trigger, hashes, strict=True):
            for i in range(a, b + 1):
                assert 0 <= t - i <= 10
                assert seen.setdefault(data[i : i + 20].tobytes(), (t - i, h)) == (t - i, h)


def test_edges(spark, docs, no_docs):
    """Nulls, empty and long texts, clashing names; of equal rows one is whole; an empty table."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = prefix_free.repeated_passages(spark, docs).collect()
    assert len(out) == len(rows)
    alone = [r for r in rows if sum(x == r for x in rows) == 1]
    once = [r for k, r in enumerate(rows) if r not in rows[:k]]
    want = {r[0]: r for r in expected(once, 100)}
    for r in out:
        if r.doc_id in {d for d, _ in alone} and sum(d == r.doc_id for d, _ in rows) == 1:
            assert tuple(r) == want[r.doc_id]
    again = [r for r in out if r.doc_id == 0]
    assert sorted(r.n_removed for r in again) == [0] + [again[0].n_bytes] * (len(again) - 1)
    assert prefix_free.repeated_passages(spark, no_docs).count() == 0
