"""Periodic runs of words by an all-lag vectorised scan.

A text is an array of word ids.  It is compared with itself at each shift q up
to n / MIN_EXPONENT; a stretch of equal words q apart, of at least
max(LEAST, MIN_EXPONENT * q) words with the q behind it, is a run.  Of stretches
of one extent the one of the smallest shift is the run: a stretch of four
periods whose smallest period is shorter has that one as a divisor, and ends
where that one ends.

Short texts are scanned many at a time: their ids differ from text to text, so
one comparison serves all of them.  A long text is dealt out as ranges of lags,
each a row with the text's ids, which Spark spreads over the machines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, small_batches

#: Periods and words that a run has at least.
MIN_EXPONENT, LEAST = 4, 6
#: Texts of more bytes are dealt out as ranges of lags.
LONG_BYTES = 1 << 19
#: Word comparisons of one range of lags.
RANGE_WORK = 1 << 33
#: Words of short texts that are scanned at once.
SCAN_WORDS = 1 << 18

_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that one document of ten gets by its id; a null id gets none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def word_ids(words: list[bytes], base: int = 0) -> np.ndarray:
    """Ids from `base` on, in order of first occurrence."""
    known = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def scan(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int = 1, last: int | None = None) -> list[tuple[int, int, int, int]]:
    """(text, start, length, lag) of all maximal stretches at lags first..last in texts that share no ids.

    Texts lie one behind the other in `ids`, the longest first.
    """
    found = []
    longest = int(lengths[0]) if len(lengths) else 0
    last = longest // MIN_EXPONENT if last is None else min(last, longest // MIN_EXPONENT)
    for q in range(first, last + 1):
        least = max(LEAST, MIN_EXPONENT * q)
        texts = int(np.searchsorted(-lengths, -least, side="right"))
        if not texts:
            break
        end = int(starts[texts - 1] + lengths[texts - 1])
        same = ids[q:end] == ids[: end - q]
        # a stretch of 3 q holds three multiples of q in a row: texts without such are done
        step = min(q, (least - q) // 3)
        each = same[::step]
        hits = np.flatnonzero(each[2:] & each[1:-1] & each[:-2])
        if not len(hits):
            continue
        for k in np.unique(np.searchsorted(starts[:texts], hits * step, side="right") - 1).tolist():
            a = int(starts[k])
            breaks = np.flatnonzero(~same[a : a + int(lengths[k]) - q])
            edges = np.concatenate(([-1], breaks, [int(lengths[k]) - q]))
            for j in np.flatnonzero(np.diff(edges) > least - q).tolist():
                s = int(edges[j]) + 1
                found.append((k, s, int(edges[j + 1]) - s + q, q))
    return found


def smallest(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among stretches, by start and period."""
    least: dict[tuple[int, int], int] = {}
    for s, length, q in stretches:
        least[s, length] = min(q, least.get((s, length), q))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int32)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def _result(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


_TYPES = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


def _runs_of(texts: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k][1]))
    lengths = np.array([len(texts[k][1]) for k in order], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    # a text's ids start at its place: they are fewer than its words, so no two texts share one
    ids = np.concatenate([word_ids(texts[k][1], int(a)) for k, a in zip(order, starts, strict=True)])
    stretches: list[list] = [[] for _ in texts]
    for k, *stretch in scan(ids, starts, lengths):
        stretches[order[k]].append(tuple(stretch))
    return _batch([_result(d, words, smallest(s)) for (d, words), s in zip(texts, stretches, strict=True)])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        waiting: list[tuple[int | None, list[bytes]]] = []
        size = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = planted((text.as_py() or b"").split(), doc_id)
            waiting.append((doc_id, words))
            size += len(words)
            if size >= SCAN_WORDS:
                yield _runs_of(waiting)
                waiting, size = [], 0
        if waiting:
            yield _runs_of(waiting)


def _ranges(work: int):
    """Rows key, first, last, ids: the lags of each long text in ranges of about `work` comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                ids = word_ids(planted(text.split(), doc_id))
                lags = len(ids) // MIN_EXPONENT
                each = max(1, work // max(1, len(ids)))
                for first in range(1, lags + 1, each):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "first": pa.array([first], pa.int64()), "last": pa.array([min(lags, first + each - 1)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary())})

    return run


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, first, last, ids in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            words = np.frombuffer(ids, dtype=np.int32)
            found = scan(words, np.array([0]), np.array([len(words)]), first, last)
            _, s, n, q = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(s), pa.int64()), "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int64()), "period": pa.array(q, pa.int64())})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, runs in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            stretches = [(r["start"], r["length"], r["period"]) for r in runs or []]
            yield _batch([_result(doc_id, planted(text.split(), doc_id), smallest(stretches))])


def periodic_runs(spark: SparkSession, docs: DataFrame, long_bytes: int = LONG_BYTES, range_work: int = RANGE_WORK) -> DataFrame:
    """The runs of each whole text of `docs` (doc_id, text), with the tails that `planted` gives one document of ten.

    Returns doc_id, n_runs; start, length, period and exponent_milli of the
    longest run (ties: smallest start, then period; nulls without one);
    runs_sha256 of all runs' `start,length,period` lines and collapsed_sha256
    of the words that no run repeats.  Words are runs of bytes other than space
    and 0x09-0x0D.  Null and empty texts have no words; a null doc_id has no
    planted tail; repeated rows each have a row; other columns are not read; an
    empty table gives an empty result.

    A text of more than `long_bytes` is stored once and scanned by ranges of
    lags of `range_work` comparisons; a task holds one text's ids at a time.
    """
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = F.octet_length("text")
    short = rows.where(size <= long_bytes).mapInArrow(_short, _RESULT)
    with Scratch(spark, "periodic") as scratch:
        long = scratch.store(rows.where(size > long_bytes).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "long-texts", keep=True)
        if long.isEmpty():
            return short
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = long.mapInArrow(_ranges(range_work), "key long, first long, last long, ids binary").repartition(tasks, "key", "first")
        stretches = scratch.store(dealt.mapInArrow(_scan_ranges, "key long, start long, length long, period long"), "stretches", keep=True)
        # as many runs as a text has places at most: the group is bounded by its text
        runs = stretches.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
        runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.union(long.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_finish, _RESULT))
