"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackplan.llm import bpe, exact_dedup, langid, minhash, mixing, order_minhash, queries, sharding, storage, token_counts, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.path(queries.WORD_TOKENIZER)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in lowered(text)).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("caps", [(1000, 1_000_000), (3, 400)])
def test_near_duplicates(spark, docs, caps):
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()], 85)
    found = minhash.near_duplicates(spark, docs, 85, cap_docs=caps[0], cap_shingles=caps[1]).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert all(r.kept == (r.component_id == r.doc_id) for r in found)


def test_large_group_is_chunked(spark):
    base = [f"x{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 58 - k % 3] + [f"y{k}"])) for k in range(60)] + [(100 + k, " ".join(f"z{k}_{j}" for j in range(20))) for k in range(10)]
    found = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), cap_docs=8, cap_shingles=500).collect()
    expected = brute_components(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_exact_duplicates(spark, docs):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    found = exact_dedup.exact_duplicates(spark, docs, block_rows=4).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows)
    for r in found:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None) and r.kept == (r.doc_id == r.keep_id)


def test_drop_exact_duplicates_by_row(spark):
    """Null doc_ids, one of them with a duplicate; doc_ids with two texts; a group whose ids are all null, of which any one row stays."""
    rows = [(None, "Copied"), (1, "copied"), (None, "alone"), (None, "both null"), (None, "BOTH null"), (None, None), (2, "two"), (2, "three"), (3, "TWO"), (4, "É"), (5, "é")]
    kept = exact_dedup.drop_exact_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter((d, "both null" if t == "BOTH null" else t) for d, t in kept)
    assert kept == Counter(rows) - Counter([(None, "Copied"), (2, "two"), (None, "BOTH null")])


def test_golomb():
    rng = np.random.default_rng(0)
    for n in (1, 5, 1000):
        values = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (exact_dedup.ungolomb(n, *exact_dedup.golomb(values)) == values).all()
    assert exact_dedup.ungolomb(3, *exact_dedup.golomb(np.zeros(3, np.uint64))).tolist() == [0, 0, 0]


def test_language_id(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_of_documents(spark, table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    rows = {r.doc_id: r for r in langid.language_of_documents(spark, docs).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[3].rejected


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity_of_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    high = [r.score for r in found if r.toxic == 1]
    low = [r.score for r in found if r.toxic == 0]
    assert np.mean([a > b for a in high for b in low]) > 0.85
    assert all(0 <= r.score <= 1 for r in found)


def test_toxicity_keeps_base_rate(spark):
    """One row in ten is toxic and no word is proof; the sample holds as many toxic rows as others."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(24000):
        toxic = k % 10 == 0
        words = [f"filler{j}" for j in rng.integers(0, 50, 6)] + (["badword"] if rng.random() < (0.7 if toxic else 0.3) else [])
        rows.append((k, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.toxicity_of_documents(spark, table.select("doc_id", "text"), table.select("doc_id", "toxic")).where("held_out").collect()
    assert abs(np.mean([r.score for r in found]) - 0.1) < 0.04
    assert np.mean([r.predicted for r in found]) < 0.05


def earliest_deadline_first(parts, slots):
    """The source of each slot: of the blocks released by then that of the earliest deadline; ties as the operator's classes have them."""
    whole = sum(parts.values())
    done, ran = dict.fromkeys(parts, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * whole // w), s) for s, w in parts.items() if done[s] * whole // w <= t]
        due, s = min(ready, key=lambda x: (x[0], parts[x[1]], done[x[1]]))
        assert t < due
        done[s] += 1
        ran.append(s)
    return ran


def deviations(placed, parts, end):
    """The most that any source is off its weight at any slot before `end`, in blocks."""
    whole = sum(parts.values())
    ran = np.full(end, -1)
    names = sorted(parts)
    for r in placed:
        if r.slot < end:
            ran[r.slot] = names.index(r.source)
    assert (ran >= 0).all()
    t = np.arange(1, end + 1)
    return max(np.abs(np.cumsum(ran == k) - t * parts[s] / whole).max() for k, s in enumerate(names))


def test_mixing(spark, docs):
    rows = mixing.mix(spark, docs, {"s0": 3.0, "s1": 1.0, "s2": 1.0}, block_rows=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert mixing.whole_parts({"a": 0.25, "b": 0.75}) == {"a": 1, "b": 3} and mixing.whole_parts(dict.fromkeys("abc", 1 / 3)) == dict.fromkeys("abc", 1)
    parts = {"a": 5, "b": 3, "c": 3, "d": 1, "e": 1, "f": 1}
    many = spark.createDataFrame([(k * 100 + j, s) for k, s in enumerate(parts) for j in range(4 * parts[s] * 2)], "doc_id long, source string")
    placed = mixing.mix(spark, many, parts, block_rows=4).collect()
    assert all(r.release <= r.slot < r.deadline for r in placed) and len({(r.slot, r.place) for r in placed}) == len(placed)
    # sources of equal parts take turns in either order: which of them runs is the operator's own choice
    ran = {r.slot: parts[r.source] for r in placed}
    assert [ran[t] for t in range(28)] == [parts[s] for s in earliest_deadline_first(parts, 28)]
    assert deviations(placed, parts, 28) < 1


def test_mixing_keeps_to_the_weights(spark):
    """Three thirds over 60,000 slots; weights of many digits; the rows' own weights; long periods, whose slots are joined."""
    ids = spark.range(60_000)
    thirds = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    placed = mixing.mix(spark, thirds, dict.fromkeys("012", 1 / 3), block_rows=1).collect()
    assert deviations(placed, dict.fromkeys("012", 1), 60_000) < 1
    parts = {"0": 4567, "1": 321, "2": 1112}
    for most in (mixing.BROADCAST_PARTS, 100):
        before, mixing.BROADCAST_PARTS = mixing.BROADCAST_PARTS, most
        placed = mixing.mix(spark, thirds, {s: w / 10_000 for s, w in parts.items()}, block_rows=2).collect()
        mixing.BROADCAST_PARTS = before
        end = min(max(r.slot for r in placed if r.source == s) for s in parts)
        assert all(r.release <= r.slot < r.deadline for r in placed) and deviations(placed, parts, end) < 1


def test_mixing_of_many_sources(spark):
    """5,000 sources: a heavy one, light ones and a null one."""
    n = 5000
    rows = [(k, None if k % n == 1 else f"domain{k % n}") for k in range(n)] + [(n + k, "domain0") for k in range(600)]
    placed = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1).collect()
    assert Counter((r.doc_id, r.source) for r in placed) == Counter(rows)
    assert len({(r.slot, r.place) for r in placed}) == len(rows) and all(r.release <= r.slot < r.deadline for r in placed)
    counts = Counter(s for _, s in rows)
    total = sum(c**mixing.TEMPER for c in counts.values())
    parts = {s: max(1, round(c**mixing.TEMPER * mixing.PARTS / total)) for s, c in counts.items()}
    whole = sum(parts.values())
    slots = np.sort([r.slot for r in placed if r.source == "domain0"])
    # after any slot the heavy source has had less than a block more or less than its share
    assert max(abs(k + 1 - (t + 1) * parts["domain0"] / whole) for k, t in enumerate(slots)) < 1
    assert max(abs(k - t * parts["domain0"] / whole) for k, t in enumerate(slots)) < 1


def test_pipeline_keeps_mixture_order(spark, tmp_path):
    """Many stored files of unlike size, read in another order than they were written in."""
    import corpus_pipeline

    rows = [(k, "a" * (1 + k * 37 % 500), "en", f"s{k % 3 * (k % 5)}") for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    places = {r.doc_id: (r.slot, r.place) for r in mixing.mix(spark, table).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        corpus_pipeline.mixture(spark, table, FOLDER).write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/mixture")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixture"), FOLDER).collect()
    by_order = [r.doc_id for r in sorted(found, key=lambda r: r.mixture_order)]
    assert len({r.mixture_order for r in found}) == len(rows)
    assert by_order == sorted(places, key=places.get)


def test_stored_order_reads_the_counter_only(spark, tmp_path):
    import glob
    import os

    for part in range(2):
        for c in range(2):
            spark.range(2 * part + c, 2 * part + c + 1).coalesce(1).write.parquet(f"{tmp_path}/w{part}{c}")
            os.makedirs(f"{tmp_path}/all", exist_ok=True)
            os.rename(glob.glob(f"{tmp_path}/w{part}{c}/part-*")[0], f"{tmp_path}/all/part-0000{part}-c1234567-c123-4444-8888-c12345678901-c00{c}.snappy.parquet")
    found = storage.with_stored_order(spark.read.parquet(f"{tmp_path}/all"), "o").orderBy("o").collect()
    assert [r.id for r in found] == [0, 1, 2, 3]
    assert found[0].o == 0 and found[1].o == 1 << 32


def test_sharding(spark, docs):
    rows = sharding.shard_documents(spark, docs, shards=4, virtual_nodes=8).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(4)) <= 1


def test_fingerprints(spark, docs):
    docs = docs.dropDuplicates(["doc_id"])
    ordered = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    found = {r.doc_id: r for r in order_minhash.fingerprints(spark, docs).collect()}
    for k, (d, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert found[d].n_chars == len(text) and found[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[d].near_edited <= 1 and 0 <= found[d].near_next <= 1
    assert found[4].fingerprint == found[3].fingerprint  # null counts as empty
    assert found[8].near_next > 0.8 > found[0].near_edited


def test_fingerprints_across_lengths(spark):
    """Texts around 200 code points: an edited text that falls below it, and near copies on both sides."""
    words = [f"word{k:02d}" for k in range(60)]
    near = " ".join(words)[:198]
    rows = [(1, " ".join(words)[:230]), (2, None), (3, near), (4, near + " more")]
    found = {r.doc_id: r for r in order_minhash.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].near_edited > 0.2 and found[3].near_next > 0.5


def test_fingerprints_count_repeats(spark):
    """Texts that share one word, repeated, and differ in thousands of others: most numbered k-mers agree."""
    rows = [(k, "same " * 10000 + " ".join(f"{c}{j}" for j in range(3000))) for k, c in enumerate("abcdefgh")]
    found = order_minhash.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r.near_next for r in found]) > 0.25


def fuzz():
    rng = np.random.default_rng(5)
    parts = ["a", "B", " ", "  ", "\n", "é", "Σ", "1", "23", "'s", "日本", "ß", "\x1c", "\x85", "　", "!", "...", "é", "<|endoftext|>", "😀", "the", "ing"]
    return ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)] + ["a" * 3000, " " * 500, "ab" * 999]


def test_byte_bpe():
    ranks = bpe.read_ranks(BYTES)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in fuzz():
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    data = b"internationalisationofthings"
    last = encoder.extend(data[:9], [])
    assert encoder.extend(data, last) == encoder.extend(data, [])
    for at, removed, inserted in ((3, 2, b"xyz"), (0, 0, b"q"), (len(data), 0, b"ing"), (5, 9, b"")):
        new, out = encoder.edited(data, encoder.extend(data, []), at, removed, inserted)
        assert out == encoder.extend(new, [])


def test_byte_bpe_documents(spark, docs, no_docs):
    found = {r.doc_id: r for r in bpe.encoding_digests(spark, docs, BYTES, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert found[4].n_tokens == 0 and bpe.encoding_digests(spark, no_docs, BYTES, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, docs):
    counter = token_counts.Counter(json.load(open(WORDS)))
    library = Tokenizer.from_file(WORDS)
    for text in fuzz():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        if "<|" not in text:
            for chunk in (1, 2, 7):
                assert counter.plain(text, chunk) == counter.plain(text)
    for text in ("it's we'll they'lx '' 'r 'v'e !'s x'", "a1b22.'d", "漢" * 50 + "'ll" * 9, "' " * 5):
        for chunk in range(1, 9):
            assert counter.plain(text, chunk) == len(library.encode(text, add_special_tokens=False).ids)
    assert token_counts.token_counts(spark, docs.limit(0), WORDS).collect() == []
    for r in docs.join(token_counts.token_counts(spark, docs, WORDS).withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\r\n", "same"), (3, None, ""), (4, "u", None), (5, "u", "x\r\n\r\ny" * 20000), (6, "u", "ünï"), (6, "u", "ünï"), (None, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages, segment_bytes=1000).collect())
    first = {}
    for p, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if p is None else p)
    expected = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        again = p != first[h or ""]
        expected[p, len(data), warc.digest_of(data), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert found == expected
    for n in (0, 1, 8192, 8193):
        assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n


@pytest.mark.parametrize("operator", [minhash.near_duplicates, exact_dedup.exact_duplicates, langid.language_of_documents, mixing.mix, sharding.shard_documents, order_minhash.fingerprints])
def test_empty_tables(spark, no_docs, operator):
    assert operator(spark, no_docs).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == table.columns, name
        before, rows = docs.collect(), out.collect()
        assert not Counter(rows) - Counter(before)
        if name == "exact dedup":
            best = {}
            for r in before:
                best[lowered(r.text)] = max(best.get(lowered(r.text), -1), r.doc_id)
            assert {r.doc_id for r in rows} == set(best.values())
        if name == "MinHash near-dedup":
            assert {r.doc_id for r in rows} == {c for _, c in brute_components([(r.doc_id, r.text) for r in before], corpus_pipeline.SIMILARITY).values()}
        if name == "mixing":
            assert len(rows) == len(before)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id: r.token_ids for r in final} == {d: library.encode_ordinary(t or "") for d, t in texts.items()}
