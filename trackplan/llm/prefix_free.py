"""Repeated passages of a corpus by prefix-free parsing.

Parsing: each window of `width` bytes has a trigger, the `gram` bytes in it of
the least rolling hash (the leftmost of equal ones).  A phrase is a maximal run
of windows with one trigger.  Phrases overlap by width - 1 bytes, so that every
window lies in exactly one of them, and equal windows have equal triggers at
equal places.  In highly repetitive text the distinct phrases, the dictionary,
are few; the parse says where each occurs first.

Corpus order: windows that start o bytes before their trigger are ordered by
the o bytes to its left, which are suffixes of dictionary phrases cut at the
trigger, and then by the text from the trigger on, which is the order of the
parse.  Both suffix arrays are sorted once for all phrases of a range of
triggers; their common prefixes give the windows that are equal, for every o.

Triggers that occur once in the corpus can't be in a repeated window: blocks of
documents send the Golomb-coded hashes of their triggers to owners and get back
bitmaps of those that occur again, so only suspect phrases are ever shuffled.
Texts are stored once, in buckets of blocks, and no later step moves them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import answers_of_owners, golomb
from .groups import grouped
from .shingles import mix, seeded
from .storage import Scratch, small_batches

WIDTH = 100
#: Bytes of documents in a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Windows that are hashed in one numpy pass, with the place of each in so many low bits.
PIECE_BITS = 18
PIECE = (1 << PIECE_BITS) - 4096
#: Bits of a trigger's hash that blocks and owners exchange.
HASH_BITS = 48
#: Triggers of an owner, at about two for each width - gram + 2 bytes.
OWNER_TRIGGERS = 1 << 22
#: Distinct phrases of one trigger that a task orders; windows of more are grouped by Spark.
MOST_PHRASES = 50_000
#: Phrases that are ordered at once.
ORDER_ROWS = 1 << 14
ROW_BITS = 20
_NO_ID = -(1 << 63)

_BYTE = seeded(256, 12)
_POWER = np.cumprod(np.full(1 << PIECE_BITS, 0xC2B2AE3D27D4EB4F, dtype=np.uint64))
_PLACE = np.uint64((1 << PIECE_BITS) - 1)


def gram_of(width: int) -> int:
    """Bytes of a trigger: a window has at most 63 places for it."""
    return max((width + 1) // 2, width - 62)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return x if k == width else np.minimum(x[:size], x[width - k : width - k + size])


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, trigger's place, its hash) of the phrases of documents data[start:end]."""
    gram = gram_of(width)
    found = []
    for at in range(0, max(0, len(data) - width + 1), PIECE):
        raw = data[at : at + PIECE + width - 1]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=total[1:])
        hashes = mix((total[gram:] - total[:-gram]) * _POWER[len(_POWER) - 1 - np.arange(len(raw) - gram + 1)])
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _least((hashes & ~_PLACE) | place, width - gram + 1)
        # windows that reach beyond their document are none
        change = np.zeros(len(least) + 1, dtype=np.int32)
        inside = (ends > at) & (starts < at + len(least))
        lo, hi = np.clip(starts[inside] - at, 0, len(least)), np.clip(ends[inside] - width + 1 - at, 0, len(least))
        np.add.at(change, lo[hi > lo], 1)
        np.add.at(change, hi[hi > lo], -1)
        windows = np.flatnonzero(np.cumsum(change[:-1]))
        if len(windows):
            trigger = (least[windows] & _PLACE).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1, [len(windows)]))
            chosen = trigger[cuts[:-1]]
            found.append((windows[cuts[:-1]] + at, windows[cuts[1:] - 1] + at, chosen + at, hashes[chosen] >> np.uint64(64 - HASH_BITS)))
    if not found:
        return (*[np.empty(0, dtype=np.int64)] * 3, np.empty(0, dtype=np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _owner(distinct: np.ndarray, owners: int) -> np.ndarray:
    return ((distinct * np.uint64(owners)) >> np.uint64(HASH_BITS)).astype(np.int32)


_SENT = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("owner", pa.int32()), ("count", pa.int32()), ("shift", pa.int32()), ("quotients", pa.binary()), ("remainders", pa.binary()), ("again", pa.binary())])
_SENT_DDL = "kind int, block long, key long, doc_id long, text binary, owner int, count int, shift int, quotients binary, remainders binary, again binary"


def _sent(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SENT], schema=_SENT)


def _edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends - np.array([len(t) for t in texts]), ends


def _send(owners: int, width: int, block_bytes: int):
    """Blocks of documents (kind 0), and of each the hashes of its triggers for their owners (kind 1)."""

    def block(number: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        for a in range(0, n, 500):
            b = min(n, a + 500)
            yield _sent(kind=[0] * (b - a), block=[number] * (b - a), key=[number << ROW_BITS | k for k in range(a, b)], doc_id=ids[a:b], text=texts[a:b])
        *_, hashes = phrases(*_edges(texts), width)
        distinct, times = np.unique(hashes, return_counts=True)
        starts = np.searchsorted(_owner(distinct, owners), np.arange(owners + 1))
        sent = [(o, starts[o], starts[o + 1]) for o in range(owners) if starts[o + 1] > starts[o]]
        coded = [golomb(distinct[a:b]) for _, a, b in sent]
        again = [np.packbits(times[a:b] > 1).tobytes() for _, a, b in sent]
        if sent:
            yield _sent(kind=[1] * len(sent), block=[number] * len(sent), owner=[o for o, _, _ in sent], count=[b - a for _, a, b in sent], shift=[c[0] for c in coded], quotients=[c[1] for c in coded], remainders=[c[2] for c in coded], again=again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if ids and (size + len(text) > block_bytes or len(ids) >= 1 << (ROW_BITS - 1)):
                    yield from block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield from block(number, ids, texts)

    return run


class _Block:
    """The documents of a block in corpus order, and which of their phrases have a trigger that occurs again."""

    def __init__(self, documents: pa.Table, answers: pa.Table, owners: int, width: int):
        self.documents = documents.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        self.keys, self.ids = self.documents.column("key").to_pylist(), self.documents.column("doc_id").to_pylist()
        self.texts = [t.as_py() for t in self.documents.column("text")]
        self.data, self.starts, self.ends = _edges(self.texts)
        bits = {o: b for o, b in zip(answers.column("owner").to_pylist(), answers.column("bitmap"), strict=True) if o is not None}
        if not bits:
            self.first = self.last = self.trigger = np.empty(0, dtype=np.int64)
            self.hash = np.empty(0, dtype=np.uint64)
            return
        self.first, self.last, self.trigger, self.hash = phrases(self.data, self.starts, self.ends, width)
        distinct, place = np.unique(self.hash, return_inverse=True)
        owner = _owner(distinct, owners)
        begin = np.searchsorted(owner, np.arange(owners + 1))
        again = np.zeros(len(distinct), dtype=bool)
        for o, bitmap in bits.items():
            a, b = begin[o], begin[o + 1]
            again[a:b] = np.unpackbits(np.array(bitmap.as_py(), dtype="<i8").view(np.uint8), bitorder="little", count=b - a)
        suspect = again[place]
        self.first, self.last, self.trigger, self.hash = self.first[suspect], self.last[suspect], self.trigger[suspect], self.hash[suspect]


_PHRASES = "h long, at int, windows int, phrase binary, doc_id long, key long, trigger int"


def _suspects(owners: int, width: int):
    """The distinct suspect phrases of a block, each where it is first in the block."""

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        if documents.num_rows and answers.num_rows:
            block = _Block(documents, answers, owners, width)
            data = block.data.tobytes()
            row = np.searchsorted(block.ends, block.first, side="right")
            seen = set()
            for s, e, t, h, r in zip(block.first.tolist(), block.last.tolist(), block.trigger.tolist(), block.hash.tolist(), row.tolist(), strict=True):
                phrase = data[s : e + width]
                if (phrase, t - s) not in seen:
                    seen.add((phrase, t - s))
                    for column, x in zip(columns, (h, t - s, e - s + 1, phrase, block.ids[r], block.keys[r], t - int(block.starts[r])), strict=True):
                        column.append(x)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _PHRASES.split(", ")])

    return run


def _common(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of bytes, common prefix of each with the one before)."""
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel(), kind="stable")
    rows = strings[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, np.concatenate(([-1], same))


def first_windows(at: np.ndarray, windows: np.ndarray, blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Of each phrase the windows without an equal one before, as bits: bit o is the window that starts o bytes before the trigger.

    Phrases blob[start:end] have their trigger at `at` and come in corpus order.
    """
    most = width - gram_of(width)
    k = len(at)
    back = starts[:, None] + at[:, None] - 1 - np.arange(most)
    left = np.where(back >= starts[:, None], blob[np.maximum(back, 0)], 0).astype(np.uint8)
    on = starts[:, None] + at[:, None] + np.arange(width)
    right = np.where(on < ends[:, None], blob[np.minimum(on, len(blob) - 1)], 0).astype(np.uint8)
    bits = np.zeros(k, dtype=np.int64)
    dictionary, left_common = _common(left)
    parse, right_common = _common(right)
    left_id, right_id = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
    for o in range(most + 1):
        some = np.flatnonzero((o <= at) & (o > at - windows))
        if len(some):
            left_id[dictionary] = np.cumsum(left_common < o)
            right_id[parse] = np.cumsum(right_common < width - o)
            _, first = np.unique(left_id[some] * (k + 1) + right_id[some], return_index=True)
            bits[some[first]] |= np.int64(1 << o)
    return bits


_FIRST = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("trigger", pa.int32()), ("bits", pa.int64())])
_FIRST_DDL = "block long, key long, trigger int, bits long"


def _combine(width: int):
    """The first windows of phrases, which come sorted by their triggers' hashes."""

    def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, at, windows, ids, keys, trigger = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "at", "windows", "doc_id", "key", "trigger"))
        bits = (((np.int64(1) << windows.astype(np.int64)) - 1) << (at - windows + 1).astype(np.int64)).astype(np.int64)
        # a trigger with one distinct phrase: all its windows are first there
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[which] > 1)
        several = several[np.lexsort((trigger[several], keys[several], ids[several]))]
        if len(several):
            texts = batch.column("phrase").take(pa.array(several)).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            bits[several] = first_windows(at[several].astype(np.int64), windows[several].astype(np.int64), np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, width)
        some = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array(keys[some] >> ROW_BITS), pa.array(keys[some]), pa.array(trigger[some].astype(np.int32)), pa.array(bits[some])], schema=_FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in grouped(batches, ["h"]):
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ORDER_ROWS:
                yield ordered(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                waiting = []
        if waiting:
            yield ordered(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return run


def _windows_of(width: int):
    """The windows of phrases one by one, with 128 bits that name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, windows, phrase, doc_id, key, trigger in zip(*[batch.column(c).to_pylist() for c in ("at", "windows", "phrase", "doc_id", "key", "trigger")], strict=True):
                names = [hashlib.blake2b(phrase[k : k + width], digest_size=16).digest() for k in range(windows)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "doc_id": pa.array([doc_id] * n, pa.int64()), "key": pa.array([key] * n, pa.int64()), "start": pa.array(range(trigger - at, trigger - at + n), pa.int32())})

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(owners: int, width: int):
    """Documents without their repeated bytes: every suspect window goes but those that are first."""

    def run(documents: pa.Table, marks: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if documents.num_rows:
            block = _Block(documents, marks, owners, width)
            gone = np.zeros(len(block.data) + 1, dtype=bool)
            change = np.zeros(len(block.data) + 1, dtype=np.int32)
            np.add.at(change, block.first, 1)
            np.add.at(change, block.last + 1, -1)
            gone[:-1] = np.cumsum(change[:-1]) > 0
            begin = dict(zip(block.keys, block.starts.tolist(), strict=True))
            first = [(begin[k] + t, b) for k, t, b in zip(*[marks.column(c).to_pylist() for c in ("key", "trigger", "bits")], strict=True) if k is not None]
            if first:
                place, bits = (np.array(c, dtype=np.int64) for c in zip(*first, strict=True))
                for o in range(width - gram_of(width) + 1):
                    gone[place[(bits >> o) & 1 == 1] - o] = False
            seen = np.concatenate((np.zeros(width, dtype=np.int64), np.cumsum(gone)))
            covered = seen[width:-1] > seen[: -width - 1] if len(gone) > 1 else gone[:-1]
            for doc_id, text, a, b in zip(block.ids, block.texts, block.starts.tolist(), block.ends.tolist(), strict=True):
                cover = covered[a:b]
                removed = int(np.count_nonzero(cover))
                spans = int(np.count_nonzero(np.diff(cover.view(np.int8), prepend=0) == 1)) if removed else 0
                kept = block.data[a:b][~cover].tobytes() if removed else text
                for column, x in zip(out, (None if doc_id == _NO_ID else doc_id, b - a, removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
        return pa.table([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, most_phrases: int = MOST_PHRASES, owner_triggers: int = OWNER_TRIGGERS) -> DataFrame:
    """Remove from each whole text of `docs` (doc_id, text) the bytes covered by a `width`-byte string that starts earlier too.

    Earlier is at a smaller doc_id, or in the same document further left;
    strings overlap and are judged on the input.  Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256 of the rest.
    Texts are UTF-8; null counts as empty; texts of fewer bytes than `width`
    stay whole.  Rows without a doc_id come before all others; rows that share
    one follow each other in the order they are read in, so of equal rows one
    is whole.  Other columns are not read; an empty table gives an empty result.
    """
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = min(1 << 16, max(tasks, 2 * size // ((width - gram_of(width) + 2) * owner_triggers)))
    with Scratch(spark, "prefix-free") as scratch:
        sent = scratch.bucketed(texts.mapInArrow(_send(owners, width, block_bytes), _SENT_DDL), "texts", ["block"], tasks, by="kind")
        documents = sent.where("kind = 0").select("block", "key", "doc_id", "text").groupBy("block")
        messages = sent.where("kind = 1").select("owner", "block", "count", "shift", "quotients", "remainders", "again")
        answers = messages.repartition(tasks, "owner").sortWithinPartitions("owner", "block").mapInArrow(answers_of_owners, "block long, owner int, bitmap array<long>")
        answers = scratch.store(answers, "bitmaps")
        suspects = documents.cogroup(answers.groupBy("block")).applyInArrow(_suspects(owners, width), _PHRASES)
        place = F.min(F.struct("doc_id", "key", "trigger")).alias("place")
        dictionary = suspects.groupBy("h", "at", "windows", "phrase").agg(place).select("h", "at", "windows", "phrase", "place.*")
        dictionary = scratch.store(dictionary, "dictionary")
        hot = scratch.store(dictionary.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most_phrases).select("h"), "hot-triggers")
        few = hot.isEmpty()
        cold = dictionary if few else dictionary.join(hot, "h", "left_anti")
        first = cold.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(_combine(width), _FIRST_DDL)
        if not few:
            windows = dictionary.join(hot, "h", "left_semi").mapInArrow(_windows_of(width), "name binary, doc_id long, key long, start int")
            windows = windows.groupBy("name").agg(F.min(F.struct("doc_id", "key", "start")).alias("w"))
            first = first.union(windows.select(F.shiftright("w.key", ROW_BITS), "w.key", "w.start", F.lit(1).cast("long")))
        first = scratch.store(first, "first-windows")
        none = lambda kind: F.lit(None).cast(kind)
        marks = answers.select("block", "owner", "bitmap", none("long").alias("key"), none("int").alias("trigger"), none("long").alias("bits"))
        marks = marks.union(first.select("block", none("int"), none("array<long>"), "key", "trigger", "bits"))
        result = documents.cogroup(marks.groupBy("block")).applyInArrow(_removed(owners, width), _RESULT)
        return scratch.store(result, "result", keep=True)
