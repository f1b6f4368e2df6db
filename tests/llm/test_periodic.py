"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re

import pytest

from trackplan.llm import periodic


def brute(words):
    """Runs by their definition: maximal stretches of the smallest period, four periods and six words at least."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    words = periodic.planted(words, doc_id)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def periodic_text(rnd):
    words = [str(rnd.randrange(rnd.choice([1, 2, 3, 50]))) for _ in range(rnd.randrange(60))]
    if words:
        at, width = rnd.randrange(len(words)), rnd.randint(1, 9)
        words[at:at] = words[at : at + width] * rnd.randint(2, 9)
    return rnd.choice([" ", "\n", " \t "]).join(words)


def as_tuples(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("limits", [(1 << 19, 1 << 33), (40, 1 << 33), (40, 60)])
def test_runs(spark, limits):
    """Short texts together, long texts by one range of lags and by many."""
    rnd = random.Random(11)
    rows = [(k, periodic_text(rnd)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic.periodic_runs(spark, docs, long_bytes=limits[0], range_work=limits[1])
    assert as_tuples(found) == sorted(repr(expected(*r)) for r in rows)


def test_planted_tails():
    """Of ids with a checksum that ends in 0 the tail repeats its first period."""
    words = [b"%d" % k for k in range(100)]
    changed = [d for d in range(300) if periodic.planted(words, d) != words]
    assert 15 <= len(changed) <= 45
    for d in changed:
        s, n, q = max(brute(periodic.planted(words, d)) or [(0, 0, 0)], key=lambda r: r[1])
        assert n == 0 or s + n == 100


def test_edges(spark, docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing names; an empty table."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = [(d, t) for d, t in rows if len(t or "") < 5000]
    found = periodic.periodic_runs(spark, docs).collect()
    assert len(found) == len(rows)
    assert sorted(repr(tuple(r)) for r in found if any(r.collapsed_sha256 == expected(*x)[-1] for x in short)) == sorted(repr(expected(*x)) for x in short)
    assert periodic.periodic_runs(spark, no_docs).count() == 0
