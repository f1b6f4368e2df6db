"""Fingerprints against a brute-force version, and their closeness to the likeness over whole sets of pairs."""

import hashlib
import re

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from trackplan.llm import order_minhash as M

TOKEN = regex.compile(M.TOKEN.replace("Is", "Script="), flags=re.ASCII)


def chained(*values):
    """Spark's xxhash64 of values: bytes as text, (value, size) as a number, None as nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v[0] & ((1 << 8 * v[1]) - 1)).to_bytes(v[1], "little"), seed=h)
    return h


def brute_numbered(text):
    """(hash of k-mer and occurrence, position) of every k-mer."""
    h = [chained(w.encode()) for w in TOKEN.findall(text)]
    starts = range(max(min(len(h), 1), len(h) - (M.KMER - 1)))
    kmers = [chained(*[(h[i + j], 8) if i + j < len(h) else None for j in range(M.KMER)]) >> (M.POSITION_BITS + 1) for i in starts]
    seen, out = {}, []
    for i, k in enumerate(kmers):
        n = seen[k] = seen.get(k, -1) + 1
        out.append((chained((k, 8), (n, 4)) >> (M.POSITION_BITS + 1), i))
    return out


def brute_sketch(text):
    out = []
    kmers = brute_numbered(text)
    for j in range(M.SKETCHES):
        least = [None, None]
        for k, i in kmers:
            h = chained((k, 8), (j, 4))
            order = (h >> (M.POSITION_BITS + 1), i)
            if least[h & 1] is None or order < least[h & 1]:
                least[h & 1] = order
        chosen = sorted((x for x in least if x is not None), key=lambda x: x[1])
        out.append(f"{chained(*[(x[0], 8) for x in chosen]) >> 32:08x}" if chosen else "00000000")
    return "".join(out).upper()


def words(rng, n, most=400):
    return " ".join(f"w{k}" for k in rng.integers(0, most, n))


def test_against_brute_force(spark):
    """Texts of 0 to 20,000 characters, many around 200, repeats, other scripts; ids that are hashes."""
    rng = np.random.default_rng(2)
    texts = ["", None, "x", "two words", "same " * 300, "日本語のテキスト", "a" * 50, words(rng, 4000, 50)] + [words(rng, n)[:m] for n, m in zip(range(40, 60), range(190, 210), strict=True)]
    ids = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, len(texts))]
    rows = sorted(zip(ids, texts, strict=True))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in M.fingerprints(spark, table).collect()}
    share = lambda a, b: np.mean([a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)])
    for k, (d, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = found[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_sketch(text) and r.edited_fingerprint == brute_sketch(edited)
        assert r.near_edited == share(brute_sketch(text), brute_sketch(edited)) and r.near_next == share(brute_sketch(text), brute_sketch(after))


def test_likeness_is_unbiased(spark):
    """Mean likeness of many pairs of texts against the chance that two numbered k-mers, in order, are shared."""
    rng = np.random.default_rng(6)
    rows, expected = [], []
    for k in range(60):
        a = words(rng, 300, 10**6).split()
        b = a[:]
        for at in rng.integers(0, 300, 5):
            b[at] = "changed"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = ({h for h, _ in brute_numbered(t)} for _, t in rows[-2:])
        expected.append(len(x & y) * (len(x & y) - 1) / (len(x | y) * (len(x | y) - 1)))
    found = M.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 0").collect()
    assert abs(np.mean([r.near_next for r in found]) - np.mean(expected)) < 0.03


def test_successors(spark):
    """Sparse ids, dealt over many ranges."""
    rng = np.random.default_rng(1)
    ids = sorted({int(x) for x in rng.integers(-(1 << 62), 1 << 62, 5000)})
    from trackplan.llm.storage import Scratch

    with Scratch(spark, "test") as scratch:
        found = {r.id: r.next_id for r in M.successors(scratch, spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert found == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_repeated_rows(spark):
    """Rows that share a doc_id, rows that are the same, and null doc_ids are each returned."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g"), (None, "a b c d"), (None, None), (2, "x y z")]
    found = M.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(str(d) for d, _ in rows)
    assert found.where(F.col("doc_id").isNull()).count() == 2


def test_runs_without_spaces(spark):
    """A character put before a Thai text, a long path or base64 leaves its fingerprint near; a word grown beyond 16 letters too."""
    rng = np.random.default_rng(7)
    thai = "".join(chr(0x0E01 + int(k)) for k in rng.integers(0, 46, 1200))
    path = "/".join(f"dir{k}" for k in rng.integers(0, 900, 200))
    prose = words(rng, 300)
    rows = [(1, thai), (2, "x" + thai), (3, path), (4, "x" + path), (5, prose), (6, prose + " a-word-of-some-length"), (7, prose + " a-word-of-some-lengths")]
    found = {r.doc_id: r for r in M.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].near_next > 0.8 and found[3].near_next > 0.8 and found[6].near_next > 0.8 and found[2].near_next < 0.1
