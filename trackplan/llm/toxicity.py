"""Toxicity by averaged subword embeddings and a linear softmax.

A word stands for its character n-grams; a text's vector is the mean of their
embeddings, a linear softmax scores it, and both are trained together by Adam
in numpy on a bounded sample of labelled rows.  The lengths of the embeddings
are penalised, so that the many n-grams of a long text that tell nothing don't
drown the few that do.  As the classifier is linear in the mean, scoring needs
one number per n-gram, and misspelt words that were never seen score by the
n-grams they share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
SIZE = 8
#: The sample: labelled rows of each class at most, and bytes of a row at most.
SAMPLE_EACH, SAMPLE_ROW_BYTES = 1500, 1 << 13
STEPS, CHECK_EVERY, BATCH, RATE = 600, 30, 128, 0.02
#: An embedding shrinks by RATE * SHRINK a step (not below 0): n-grams that tell nothing have none in the end.
SHRINK = 0.3
#: The mean is multiplied by this before the softmax: a few telling words in a long text move it little.
GAIN = 64.0
#: Words a task remembers.
CACHE_WORDS = 400_000
_OTHER = re.compile(r"[\W_]+")


def buckets(word: str) -> list[int]:
    """Buckets of a word's n-grams, its ends marked; none for a word without letters or digits."""
    word = _OTHER.sub("", word)
    if not word:
        return []
    word = f"<{word}>"
    raw = [word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1)] + [word]
    return [zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in raw]


@dataclass
class Model:
    weights: np.ndarray  # one number per bucket
    bias: float
    cache: dict[str, complex] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def _word(self, word: str) -> complex:
        found = buckets(word)
        value = complex(float(self.weights[found].sum()) if found else 0.0, len(found))
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = value
        return value

    def logit(self, text: str | None) -> float:
        """Log odds of label 1: the mean weight of the text's n-grams and the bias."""
        total = 0j
        known = self.cache.get
        for word in (text or "").lower().split():
            value = known(word)
            total += self._word(word) if value is None else value
        return total.real / total.imag + self.bias if total.imag else self.bias


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (bucket, weight), weights of a row sum to 1, and the rows' starts; a row without n-grams has weight 0."""
    index, weight, starts = [], [], [0]
    known: dict[str, list[int]] = {}
    for text in texts:
        found: list[int] = []
        for word in text.lower().split():
            if word not in known:
                known[word] = buckets(word)
            found += known[word]
        ids, n = np.unique(np.array(found or [0], dtype=np.int64), return_counts=True)
        index.append(ids)
        weight.append((n / len(found) if found else np.zeros(1)).astype(np.float32))
        starts.append(starts[-1] + len(ids))
    return np.concatenate(index), np.concatenate(weight), np.array(starts)


def fit(rows: list[tuple[int, str]], seed: int = 7, counts: dict[int, int] | None = None) -> Model:
    """A model of (label 0 or 1, text) rows; every tenth calibrates it and picks the step to stop at.

    counts: rows of each label in the whole that `rows` is a sample of.  The
    rows that calibrate weigh as these, so that a score means the same
    whatever part of each class was sampled.
    """
    labels = np.array([r[0] for r in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)))
    index, weight, starts = _features([r[1] for r in rows])
    rng = np.random.default_rng(seed)
    aside = np.arange(len(rows)) % 10 == 9
    train = np.flatnonzero(~aside) if aside.any() else np.arange(len(rows))
    check = np.flatnonzero(aside) if len(set(labels[aside].tolist())) == 2 else train
    wholes = np.array([(counts or {}).get(k) or np.count_nonzero(labels == k) for k in (0, 1)], dtype=float)
    stands_for = (wholes / np.bincount(labels[check], minlength=2))[labels[check]]
    used, local = np.unique(index, return_inverse=True)
    table = rng.normal(0, 0.1 / SIZE, (len(used), SIZE)).astype(np.float32)
    soft = rng.normal(0, 1 / SIZE, (SIZE, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]

    def means(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = starts[which + 1] - starts[which]
        first = np.concatenate(([0], np.cumsum(lengths[:-1])))
        places = np.arange(lengths.sum()) - np.repeat(first, lengths) + np.repeat(starts[which], lengths)
        at, w = local[places], weight[places]
        return np.add.reduceat(table[at] * w[:, None], first, axis=0), at, w, lengths

    best, order = None, np.empty(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate((order, rng.permutation(train)))
        which, order = order[:BATCH], order[BATCH:]
        vectors, at, w, lengths = means(which)
        vectors *= GAIN
        scores = vectors @ soft + bias
        scores -= scores.max(axis=1, keepdims=True)
        shares = np.exp(scores)
        shares /= shares.sum(axis=1, keepdims=True)
        shares[np.arange(len(which)), labels[which]] -= 1
        shares /= len(which)
        back = np.repeat(GAIN * shares @ soft.T, lengths, axis=0) * w[:, None]
        d_table = np.stack([np.bincount(at, back[:, k], len(used)) for k in range(SIZE)], axis=1).astype(np.float32)
        for p, g, (m, v) in zip((table, soft, bias), (d_table, vectors.T @ shares, shares.sum(axis=0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        length = np.sqrt(np.einsum("ij,ij->i", table, table))
        table *= np.maximum(0, 1 - RATE * SHRINK / np.maximum(length, 1e-9))[:, None]
        if step % CHECK_EVERY == 0:
            odds = (GAIN * means(check)[0] @ soft + bias) @ np.array([-1, 1], dtype=np.float32)
            slope, shift, loss = _calibrated(odds.astype(float), labels[check], stands_for / stands_for.mean())
            if best is None or loss < best[0]:
                best = (loss, slope, shift, GAIN * (table @ (soft[:, 1] - soft[:, 0])), float(bias[1] - bias[0]))
    _, slope, shift, found, base = best
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = slope * found
    return Model(weights, slope * base + shift)


def _calibrated(odds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and mean loss of the logistic calibration of rows of mean weight 1, by a few Newton steps from the identity."""
    slope, shift = 1.0, 0.0
    loss = lambda a, b: float((weight * np.logaddexp(0, -(2 * labels - 1) * (a * odds + b))).mean() + 1e-3 * (a - 1) ** 2)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -30, 30)))
        g = np.array([(weight * (p - labels) * odds).mean() + 2e-3 * (slope - 1), (weight * (p - labels)).mean()])
        q = weight * p * (1 - p)
        h = np.array([[(q * odds * odds).mean() + 2e-3, (q * odds).mean()], [(q * odds).mean(), q.mean() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        # a full step can lead too far when the shift is large: halved until the loss falls
        while np.abs(move).max() > 1e-6 and (slope - move[0] <= 0 or loss(slope - move[0], shift - move[1]) >= loss(slope, shift)):
            move = move / 2
        if np.abs(move).max() <= 1e-6:
            break
        slope, shift = slope - move[0], shift - move[1]
    return float(slope), float(shift), loss(slope, shift)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """id, toxic (0 or 1) of the labels that may be learned from."""
    return labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int"))


def class_counts(labels: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in usable_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, row_bytes: int = SAMPLE_ROW_BYTES, counts: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """Rows (label, text) chosen by a hash of doc_id: at most `each` of each label, of texts of at most `row_bytes` bytes."""
    usable = usable_labels(labels)
    counts = class_counts(labels) if counts is None else counts
    if not counts:
        return []
    chance = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * each / n)))])[F.col("toxic")]
    # a bounded number of ids: a broadcast of bounded size
    ids = usable.where(chance < share).select("id", "toxic", chance.alias("chance")).limit(4 * each)
    some = docs.where(F.octet_length("text") <= row_bytes).select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").select("toxic", "text", "chance").limit(4 * each).collect()
    out, taken = [], {0: 0, 1: 0}
    for r in sorted(some, key=lambda r: (r["chance"], r["text"])):
        taken[r["toxic"]] += 1
        if taken[r["toxic"]] <= each:
            out.append((r["toxic"], r["text"]))
    return out


def toxicity_of_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for every row of `docs` (doc_id, text).

    Whole texts are scored, with odds as of all labels however many of each
    class were sampled.  Null and empty texts and texts without letters and
    digits have the score of the bias alone.  Labels other than 0 and 1, null
    ones and those of held-out rows are not learned from; with one class or
    none left, every score is that class's or 0's base rate.  Rows with a null
    doc_id are not held out; repeated rows give repeated rows; other columns
    are not read; an empty table gives an empty result.
    """
    small_batches(spark)
    counts = class_counts(labels)
    shared = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, counts=counts), counts=counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([shared.value.logit(t) for t in batch.column(1).to_pylist()], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
