"""The pipeline's stages on nulls, ties, repeated rows, clashing names and empty tables, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplan.llm import exact_dedup, langid, minhash, mixing, ranks, shingles
from trackplan.llm.storage import Scratch

from .conftest import prose
from .test_operators import FOLDER, lowered
from .test_operators import shingles as shingle_set

#: Names that the stages might use themselves.
CLASHING = ["score", "rejected", "lang_pred", "_text", "_at", "id", "row", "kept", "slot", "place", "doc", "_id", "_cell", "token_ids", "a`b.c"]


@pytest.fixture(scope="module")
def rows(spark, docs):
    """The rows of `docs`, more that share doc_ids or have none, and columns of clashing names."""
    more = [(None, prose(9, 30), "en", "s1"), (None, prose(9, 30), "en", "s2"), (None, prose(9, 29) + " end", None, None), (7, "a text of its own that shares the number seven", "en", "s0"), (7, prose(9, 30).upper(), "en", "s0"), (None, "another text that is nowhere else", None, "s1")]
    both = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    extra = [F.lit(f"x{k}").alias(name) for k, name in enumerate(CLASHING)]
    return both.select("*", F.lit(None).cast("long").alias("n_chars"), *extra).repartition(3)


def as_counter(frame):
    return Counter(tuple(r) for r in frame.collect())


def order(doc_id, largest=True):
    return (doc_id is None, -doc_id if largest and doc_id is not None else doc_id or 0)


def test_exact_stage(spark, rows):
    out = corpus_pipeline.exact(spark, rows, FOLDER)
    assert out.columns == rows.columns
    kept, before = as_counter(out), as_counter(rows)
    assert not kept - before
    groups = defaultdict(list)
    for r in before.elements():
        groups[lowered(r[1])].append(r[0])
    assert Counter((lowered(r[1]), r[0]) for r in kept.elements()) == Counter((t, min(ids, key=order)) for t, ids in groups.items())


def test_near_stage(spark, rows):
    out = corpus_pipeline.near(spark, rows, FOLDER)
    assert out.columns == rows.columns
    kept, before = as_counter(out), list(as_counter(rows).elements())
    assert not kept - Counter(before)
    sets = [shingle_set(r[1]) for r in before]
    up = list(range(len(before)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= corpus_pipeline.SIMILARITY * len(a | b):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[find(i)].append(r[0])
    assert Counter(r[0] for r in kept.elements()) == Counter(min(ids, key=lambda d: order(d, False)) for ids in groups.values())


def test_mixing_stage(spark, rows):
    out = corpus_pipeline.mixture(spark, rows, FOLDER)
    assert out.columns == rows.columns and as_counter(out) == as_counter(rows)


def test_language_stage(spark, rows):
    train = spark.createDataFrame([(k, prose(k, 80), "en", "s") for k in range(100, 160)], "doc_id long, text string, lang string, source string")
    every = rows.select("doc_id", "text", "lang", "source").union(train).select("*", *[F.lit("x").alias(n) for n in CLASHING])
    out = corpus_pipeline.language(spark, every, FOLDER)
    assert out.columns == every.columns
    kept = as_counter(out)
    assert not kept - as_counter(every)
    assert all(r[1] and any(c.isalpha() for c in r[1]) for r in kept)
    assert sum(kept[tuple(r)] for r in every.where("doc_id >= 100").collect()) == 60


def test_encoding_stage(spark, rows):
    out = corpus_pipeline.encode(spark, _stored(spark, corpus_pipeline.mixture(spark, rows, FOLDER)), FOLDER).collect()
    assert len({r.mixture_order for r in out}) == rows.count() and {len(r.token_ids) for r in out if r.doc_id in (3, 4)} == {0}


def _stored(spark, frame):
    with Scratch(spark, "test") as scratch:
        return scratch.store(frame, "stage", keep=True)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_empty_stages(spark, no_docs, stage):
    out = stage(spark, no_docs, FOLDER)
    assert out.columns == no_docs.columns and out.count() == 0


def test_numbers_within_hot_cells(spark):
    """One key holds most rows: its cell is dealt into parts, and numbers stay gapless."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("key"), (F.col("id") % 2).cast("string").alias("source"), "id")
    with Scratch(spark, "test") as scratch:
        stored = scratch.store(rows.withColumn("h", F.xxhash64("key")), "rows", keep=True)
        found = ranks.numbered(scratch, stored, ["source"], [F.col("h")], F.shiftrightunsigned("h", 52), "number", most=100).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r.number)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(found) == 5000


def test_owners_follow_rows(spark, docs):
    """The result doesn't depend on how many owners there are, nor on the size of blocks."""
    few, many = (sorted(map(tuple, exact_dedup.exact_duplicates(spark, docs, block_rows=b, owner_rows=o).collect()), key=str) for b, o in ((1 << 16, 1 << 22), (3, 1)))
    assert few == many


def test_long_texts_and_words_in_shingles():
    """Texts above one pass, and words above the longest that is hashed in place, as sets of tuples."""
    words = [f"w{k % 977}" for k in range(260_000)]
    texts = [" ".join(words).encode(), b"x" * 9000 + b" y z", (b"Q" * (shingles.PASS_BYTES + 5)) + b" a b c d e f", b"", None]
    found = [s for some in shingles.shingle_sets(texts) for s in some]
    assert len(found[0]) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and [len(s) for s in found[1:]] == [1, 3, 0, 0]
    whole = next(shingles.shingle_sets([" ".join(words[:2000]).encode()]))[0]
    assert set(whole.tolist()) <= set(found[0].tolist())


def test_foreign_text_is_rejected(spark):
    """Another script, and letters in no language's order, are rejected; clean text of each language stays."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.labelled_sample(langid.training_rows(table)))
    rng = np.random.default_rng(4)
    noise = "".join(rng.choice(list("qxzjkvwy"), 400))
    assert model.identify(["Ψυχή και ουρανός μεγάλος " * 20, "русский текст о погоде " * 20, noise])[2] == [True, True, True]
    clean = table.where("lang is not null").select("text").limit(200).collect()
    assert np.mean(model.identify([r.text for r in clean])[2]) < 0.02


def test_kneser_ney_by_counting():
    """Probabilities of the model against counts taken one by one, and their sum over all characters."""
    texts = ["abracadabra", "cadabra abra", "banana"]
    classes = langid.character_classes(texts)
    model = langid.KneserNey(texts, classes)
    start = chr(0xE000)
    full = Counter()
    for t in texts:
        padded = start * (langid.ORDER - 1) + t
        full.update(padded[i : i + langid.ORDER] for i in range(len(t)))
    counts = {langid.ORDER: full}
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / langid.CLASSES
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        lower = probability(gram[1:])
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(gram, 0) - discount(n), 0) / total + discount(n) * len(own) / total * lower

    for gram in ["abra", "brac", "zzzz", "nana", "ana ", start * 3 + "b"]:
        key = langid.grams(langid.coded(gram, classes))
        assert model.probability(key, langid.ORDER)[0] == pytest.approx(probability(gram))
    contexts = np.array([langid.grams(langid.coded("abr" + c, classes))[0] for c in "abcdnr "])
    assert 0 < model.probability(contexts, langid.ORDER).sum() <= 1


def test_drop_near_keeps_unlinked_null_ids(spark):
    near = prose(2, 50)
    rows = [(1, near), (None, near + " x"), (7, near + " y"), (None, "quite another text"), (7, "and one more text")]
    kept = minhash.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in kept} == {rows[0], rows[3], rows[4]}


def test_mixture_places_are_one_each(spark):
    """A third of the rows have no doc_id: each still has a place of its own."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 4).cast("string").alias("source"))
    placed = mixing.mix(spark, rows, block_rows=4).collect()
    assert len({(r.slot, r.place) for r in placed}) == 900
