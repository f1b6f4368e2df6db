"""Language identification by interpolated Kneser-Ney character models.

One character model per language is learned from a bounded sample of labelled
rows.  The n-grams of all languages share sorted arrays of hashes, one for each
order, beside a column of log probabilities per language; texts are scored by
binary search in them.  The language with the lowest cross-entropy per
character wins; a text whose lowest cross-entropy exceeds that language's
limit, calibrated on labelled rows kept aside, is rejected.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shingles import mix
from .storage import small_batches, whole_row

ORDER = 4
#: The sample: rows at most, and bytes of a row at most (longer rows are not sampled).
SAMPLE_ROWS, SAMPLE_ROW_BYTES = 2000, 1 << 16
#: Share of the sample kept aside for calibration; a language's limit is this quantile of its rows' cross-entropies and a headroom.
ASIDE, QUANTILE, HEADROOM = 0.2, 0.995, 0.25
#: Rows kept aside that a limit of a language's own is taken from; with fewer it is that of all languages.
LEAST_ASIDE = 20
#: Characters scored in one numpy pass.
PASS_CHARS = 1 << 18
#: Bits of a character's class, and letters that have a class of their own; the rest of a script shares one for each 128 code points.
BITS = 12
CLASSES, LETTERS = 1 << BITS, 3500
DIGIT, SPACE, SYMBOL, START = range(CLASSES - 5, CLASSES - 1)
UNKNOWN = "und"
HAS_LETTER = regex.compile(r"\p{L}")
#: A private-use character that stands before each text.
_GAP = "\ue000" * (ORDER - 1)


def character_classes(texts: list[str]) -> np.ndarray:
    """A class below CLASSES for each code point: frequent letters have their own, others one by kind or block."""
    often = [c for c, _ in sorted(Counter("".join(texts).lower()).items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:LETTERS]
    classes = np.full(0x110000, SYMBOL, dtype=np.uint16)
    points = np.arange(0x110000)
    classes[0x370:] = (LETTERS + 1 + (points[0x370:] >> 7) % (DIGIT - LETTERS - 1)).astype(np.uint16)
    for p in range(0x370):
        kind = unicodedata.category(chr(p))
        classes[p] = SPACE if chr(p).isspace() else DIGIT if kind[0] == "N" else LETTERS + 1 + p % 7 if kind[0] == "L" else SYMBOL
    for p in (*range(0x2000, 0x2070), *range(0x3000, 0x3020)):
        classes[p] = SPACE if chr(p).isspace() else SYMBOL
    for k, c in enumerate(often):
        classes[ord(c)] = k
    classes[ord(_GAP[0])] = START
    return classes


def coded(text: str, classes: np.ndarray) -> np.ndarray:
    return classes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each position from order - 1 on, BITS bits for each class."""
    n = len(codes) - order + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(order):
        out = (out << np.uint64(BITS)) | codes[j : j + n].astype(np.uint64)
    return out


def hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix(keys + np.uint64(order << 56))


def _found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table, 0 for others."""
    if not len(table):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0.0)


class KneserNey:
    """One language's counts; lower orders count the distinct characters before an n-gram."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        codes = coded(_GAP + _GAP.join(texts), classes)
        keys, counts = np.unique(grams(codes), return_counts=True)
        keep = (keys & np.uint64(CLASSES - 1)) != START
        keys, counts = keys[keep], counts[keep].astype(float)
        self.orders: dict[int, tuple] = {}
        for n in range(ORDER, 0, -1):
            contexts, first = np.unique(keys >> np.uint64(BITS), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts[:0]
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            ones, twos = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.orders[n] = (keys, counts, contexts, totals, kinds, discount)
            keys, counts = np.unique(keys & np.uint64((1 << (BITS * (n - 1))) - 1), return_counts=True)
            counts = counts.astype(float)

    def backoff(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """Weight of order n - 1 after each context; 1 for unseen contexts."""
        _, _, known, totals, kinds, discount = self.orders[n]
        total = _found(known, totals, contexts)
        return np.where(total > 0, discount * _found(known, kinds, contexts) / np.maximum(total, 1), 1.0)

    def probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1 / CLASSES)
        known, counts, contexts, totals, _, discount = self.orders[n]
        above = keys >> np.uint64(BITS)
        lower = self.probability(keys & np.uint64((1 << (BITS * (n - 1))) - 1), n - 1)
        total = _found(contexts, totals, above)
        own = np.maximum(_found(known, counts, keys) - discount, 0) / np.maximum(total, 1)
        return own + self.backoff(above, n) * lower


@dataclass
class Model:
    """Sorted hashes and log probabilities of all languages together."""

    languages: list[str]
    classes: np.ndarray
    ngrams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray
    sharpness: float

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability (rows: n-grams, columns: languages) of the last character of each n-gram."""
        out = np.zeros((len(keys), len(self.languages)), dtype=np.float32)
        rest = None
        for n in range(ORDER, 0, -1):
            table, logs = self.ngrams[n]
            h = hashed(keys, n)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            if rest is None:
                out[hit] = logs[at[hit]]
                rest = np.flatnonzero(~hit)
            else:
                out[rest[hit]] += logs[at[hit]]
                rest = rest[~hit]
            if not len(rest):
                break
            keys = keys[~hit]
            table, logs = self.contexts[n]
            h = hashed(keys >> np.uint64(BITS), n)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            out[rest[hit]] += logs[at[hit]]
            keys = keys & np.uint64((1 << (BITS * (n - 1))) - 1)
        else:
            out[rest] += np.float32(np.log(1 / CLASSES))
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each non-empty text (rows) in each language."""
        out = np.empty((len(texts), len(self.languages)))
        waiting: list[int] = []
        size = 0
        lowered = [t.lower() for t in texts]
        for k, text in enumerate(lowered):
            if len(text) > PASS_CHARS:
                total = np.zeros(len(self.languages))
                for at in range(0, len(text), PASS_CHARS):
                    before = text[at - len(_GAP) : at] if at else _GAP
                    total += self._logs(grams(coded(before + text[at : at + PASS_CHARS], self.classes))).sum(axis=0, dtype=np.float64)
                out[k] = -total / len(text)
                continue
            if size + len(text) > PASS_CHARS:
                self._together(lowered, waiting, out)
                waiting, size = [], 0
            waiting.append(k)
            size += len(text) + len(_GAP)
        self._together(lowered, waiting, out)
        return out

    def _together(self, texts: list[str], which: list[int], out: np.ndarray) -> None:
        if not which:
            return
        keys = grams(coded("".join(_GAP + texts[k] for k in which), self.classes))
        lengths = np.array([len(texts[k]) for k in which])
        # position i of `keys` ends at character i + ORDER - 1; gaps are skipped
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + len(_GAP))))
        own = np.ones(len(keys), dtype=bool)
        for j in range(len(_GAP)):
            own[(starts[1:] - 1 - j)] = False
        logs = self._logs(keys[own])
        first = np.concatenate(([0], np.cumsum(lengths[:-1])))
        out[which] = -np.add.reduceat(logs, first, axis=0, dtype=np.float64) / lengths[:, None]

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, score, rejected) of each text."""
        languages, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        which = [k for k, t in enumerate(texts) if t and HAS_LETTER.search(t)] if self.languages else []
        if which:
            entropy = self.entropies([texts[k] for k in which])
            best = entropy.argmin(axis=1)
            shares = np.exp(-self.sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
            top = 1 / shares.sum(axis=1)
            high = entropy.min(axis=1) > self.limits[best]
            for k, b, s, r in zip(which, best.tolist(), top.tolist(), high.tolist(), strict=True):
                languages[k], scores[k], rejected[k] = self.languages[b], s, r
        return languages, scores, rejected


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows; those at every fifth place calibrate it."""
    every = round(1 / ASIDE)
    rows = [r for r in rows if r[1] and HAS_LETTER.search(r[1])]
    languages = sorted({r[0] for r in rows})
    by = {g: [t for x, t in rows if x == g] for g in languages}
    fitted = {g: [t.lower() for k, t in enumerate(ts) if k % every or len(ts) < every] for g, ts in by.items()}
    aside = [(languages.index(g), t) for g, ts in by.items() for k, t in enumerate(ts) if not k % every and len(ts) >= every]
    classes = character_classes([t for ts in fitted.values() for t in ts])
    models = [KneserNey(fitted[g], classes) for g in languages]
    ngrams, contexts = {}, {}
    for n in range(1, ORDER + 1) if models else ():
        keys = np.unique(np.concatenate([m.orders[n][0] for m in models]))
        order = np.argsort(hashed(keys, n))
        keys = keys[order]
        ngrams[n] = (hashed(keys, n), np.log(np.stack([m.probability(keys, n) for m in models], axis=1)).astype(np.float32))
        keys = np.unique(np.concatenate([m.orders[n][2] for m in models]))
        keys = keys[np.argsort(hashed(keys, n))]
        contexts[n] = (hashed(keys, n), np.log(np.stack([m.backoff(keys, n) for m in models], axis=1)).astype(np.float32))
    model = Model(languages, classes, ngrams, contexts, np.full(len(languages), np.inf), 1.0)
    if aside:
        entropy = model.entropies([t for _, t in aside])
        truth = np.array([g for g, _ in aside])
        losses = {}
        for sharpness in (1, 2, 4, 8, 16, 32, 64):
            shares = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
            losses[sharpness] = -np.log(np.maximum(shares[np.arange(len(truth)), truth] / shares.sum(axis=1), 1e-12)).mean()
        model.sharpness = float(min(losses, key=losses.get))
        own = entropy[np.arange(len(truth)), truth]
        for g in range(len(languages)):
            some = own[truth == g] if np.count_nonzero(truth == g) >= LEAST_ASIDE else own
            model.limits[g] = (1 + HEADROOM) * np.quantile(some, QUANTILE)
    return model


def labelled_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, row_bytes: int = SAMPLE_ROW_BYTES) -> list[tuple[str, str]]:
    """At most `rows` rows (lang, text), as many for each language as there are, chosen by a hash of doc_id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, 1.3 * each / n)))])[F.col("lang")]
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.where((chance < share) & (F.octet_length("text") <= row_bytes)).select("lang", "text", chance.alias("chance")).limit(2 * rows).collect()
    taken: Counter = Counter()
    out = []
    for r in sorted(some, key=lambda r: (r["chance"], r["text"])):
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= each:
            out.append((r["lang"], r["text"]))
    return out


def identify(spark: SparkSession, docs: DataFrame, model: Model, kept: Column) -> DataFrame:
    """kept (a column or struct of `docs`) with lang_pred, score and rejected for every row's text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(kept.alias("kept"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["kept"], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.identify(batch.column(1).to_pylist())
            columns = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["kept", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 4 is not 2, lang and text are not null."""
    return docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and rejected for every row of `docs` (doc_id, text, lang).

    lang_pred is `und`, score 0 and rejected true if text is null or has no
    letter, or if no row could be learned from.  Whole texts are scored; ties
    go to the first language in order.  Rows with a null doc_id are never
    learned from and not held out.  Repeated rows give repeated rows; other
    columns are not read; an empty table gives an empty result.
    """
    model = fit(labelled_sample(training_rows(docs)))
    found = identify(spark, docs, model, F.col("doc_id").cast("long"))
    return found.select(F.col("kept").alias("doc_id"), held_out(F.col("kept")).alias("held_out"), "lang_pred", "score", "rejected")


def drop_unidentified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns.

    Rows without text or letters go, and all rows if none could be learned
    from.  Rows are judged each for itself, whatever repeats or is null in
    them; other columns may have any names; an empty table stays empty.
    """
    model = fit(labelled_sample(training_rows(docs)))
    return identify(spark, docs, model, whole_row(docs)).where("not rejected").select("kept.*")
