"""Divergence of sources against the definition in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackplan.llm import divergence


def expected(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        total = sum((counts[lang, s] for s in sources), Counter())

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // whole for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms, 1)}
    return out


def corpus():
    rnd = random.Random(13)
    words = ["the", "The", "été", "Über", "日本", "a-b", "x1y", "naïve", "ß", "don't", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "de", "fr"]), f"s{min(rnd.randrange(12), rnd.randrange(12))}") for _ in range(500)]
    return [*rows, *rows[:5], (None, "en", "empty"), ("words here", None, "s1"), ("words", "xx", None), ("", "xx", "s0"), ("x " * 5000, "en", "s1")]


@pytest.mark.parametrize(("slice_terms", "block_groups"), [(1 << 15, 8), (5, 1), (7, 3)])
def test_divergence(spark, slice_terms, block_groups):
    """One slice and block, and many of them over all turns of the tournament."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("p", F.lit(1)).withColumn("term", F.lit("x"))
    found = divergence.divergence(spark, docs, least_docs=20, top=4, slice_terms=slice_terms, block_groups=block_groups)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in found.collect()} == expected(rows, 20, 4)


def test_local_heaps_agree_when_handed_on_early(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 10)
    found = divergence.divergence(spark, spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=20, top=3)
    assert {tuple(r) for r in found.collect()} == expected(rows, 20, 3)


@pytest.mark.parametrize("blocks", [1, 2, 3, 6, 7])
def test_every_two_blocks_meet_once(spark, blocks):
    met = Counter()
    frame = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(blocks).alias("n"))
    for turn in range(blocks + blocks % 2 - 1 if blocks > 1 else 0):
        pairs = {r.b: r.m for r in frame.select("b", divergence.partner(F.col("b"), F.col("n"), turn).alias("m")).collect()}
        assert all(m is None or pairs[m] == b for b, m in pairs.items())
        met.update((m, b) for b, m in pairs.items() if m is not None and m < b)
    assert met == Counter({(a, b): 1 for b in range(blocks) for a in range(b)})


def test_edges(spark, docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert {tuple(r) for r in divergence.divergence(spark, docs, least_docs=2).collect()} == expected(rows, 2, 50)
    assert divergence.divergence(spark, no_docs).count() == 0
