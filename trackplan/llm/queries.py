"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoding_digests
from .divergence import divergence
from .exact_dedup import exact_duplicates
from .langid import language_of_documents
from .minhash import near_duplicates
from .mixing import mix
from .order_minhash import fingerprints
from .periodic import periodic_runs
from .prefix_free import repeated_passages
from .sharding import shard_documents
from .token_counts import token_counts
from .toxicity import toxicity_of_documents
from .warc import archive_round_trip

BYTE_VOCABULARY, WORD_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(spark, table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"), shards=24)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), limit=2048)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark, table(spark, sf_dir, "documents"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_minhash_near_dedup, op2_language_id, op3_mixing, op4_sharding, op5_order_minhash, op6_toxicity, op7_exact_dedup, op8_byte_bpe, op9_token_counts, op10_warc, op11_periodic_runs, op12_repeated_passages, op13_source_divergence]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER_ASCII}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON u = doc_id"""

EXACT_DEDUP_SQL = f"""
WITH t AS (SELECT doc_id, sha256({LOWER_ASCII}) AS text_sha256, {LOWER_ASCII} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, CAST(count(*) OVER (PARTITION BY x) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, text_sha256 FROM t"""

WARC_SQL = """
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * i // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - 5 * i % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""

PERIODIC_SQL = """
WITH given AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
hashed AS (SELECT *, len(w) AS n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, CAST(4294967295 AS BIGINT))) AS h FROM given),
tails AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
texts AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM tails),
words AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM texts),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
placed AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS length FROM placed GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, length, min(q) AS q FROM stretches GROUP BY r, s, length),
lists AS (SELECT r, list({'s': s, 'n': length, 'q': q} ORDER BY s, q) AS runs FROM runs GROUP BY r),
longest AS (SELECT DISTINCT ON (r) r, s AS start, length, q AS period FROM runs ORDER BY r, length DESC, s, q),
dropped AS (SELECT r, list_distinct(flatten(list(range(s + q, s + length)))) AS gone FROM runs GROUP BY r),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY i) AS t FROM words LEFT JOIN (SELECT r, unnest(gone) AS i, true AS gone FROM dropped) g USING (r, i) WHERE gone IS NULL GROUP BY words.r)
SELECT doc_id, CAST(coalesce(len(runs), 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(array_to_string(list_transform(runs, lambda x: x.s || ',' || x.n || ',' || x.q || chr(10)), ''), '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM texts LEFT JOIN lists USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept USING (r)"""

PASSAGES_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS i, unnest(list_transform(range(n - 99), lambda i: substr(x, 2 * i + 1, 200))) AS s FROM t WHERE n >= 100),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last
  FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id"""

DIVERGENCE_SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
kept AS (SELECT lang, term, count(*) AS docs FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS own FROM counts GROUP BY lang, source),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS own FROM counts GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (own + 5 * v) AS BIGINT) AS q FROM whole JOIN sizes USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(own, 0) + 5 * v) AS BIGINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN sums t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
joined AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM joined)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op1_minhash_near_dedup": NEAR_DEDUP_SQL, "op7_exact_dedup": EXACT_DEDUP_SQL, "op10_warc": WARC_SQL, "op11_periodic_runs": PERIODIC_SQL, "op12_repeated_passages": PASSAGES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
