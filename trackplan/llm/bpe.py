"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one valid last token: the token that ends it and
fits the last token of what is before.  These last tokens are all that is
stored; the encoding is read off backwards.  Appending extends them and leaves
the earlier ones as they are; after an edit they are computed anew only until
they agree with the old ones over the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merges import from_ranks
from .storage import small_batches

#: Chunks and pieces a task remembers, and the longest it remembers.
CACHE, CACHE_CHARS = 400_000, 48
#: The characters that `\s` stands for in patterns of this kind: Unicode's White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64(token) rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Memo(dict):
    """Remembers a function's values for short keys; starts anew when full."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts by ranks; `pattern` cuts a text into pieces that are encoded on their own.

    With `by_words`, texts are first cut before single spaces between other
    characters, where the pattern is known to cut too, so that whole words are
    remembered; this holds for patterns that attach one space to what follows.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_words: bool = True):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.by_words = by_words
        self.merges, made = from_ranks({t.decode("latin-1"): r for t, r in ranks.items()})
        self.longest = max(map(len, ranks), default=0)
        #: ends of tokens: the token, or -1 if only longer tokens end so
        self.ends: dict[bytes, int] = {}
        for token, rank in ranks.items():
            for start in range(len(token)):
                self.ends.setdefault(token[start:], -1)
            if rank in made:
                self.ends[token] = rank
        self._pieces = _Memo(self._piece)
        self._words = _Memo(lambda word: self._plain(" " + word))

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Append to `last`, the last tokens of the prefixes of `data`, those of the longer prefixes."""
        ends, fits = self.ends, self.merges.fits
        for end in range(len(last) + 1, (len(data) if until is None else until) + 1):
            start, found = end, -1
            while start:
                start -= 1
                token = ends.get(data[start:end])
                if token is None:
                    break
                if token >= 0 and (start == 0 or fits(last[start - 1], token)):
                    found = token
                    break
            if found < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(found)
        return last

    def edited(self, data: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int]]:
        """Data with `removed` bytes at `at` replaced, and its last tokens."""
        new = data[:at] + inserted + data[at + removed :]
        out, shift = last[:at], len(inserted) - removed
        agreed = 0
        while len(out) < len(new):
            self.extend(new, out, len(out) + 1)
            beyond = len(out) > at + len(inserted)
            agreed = agreed + 1 if beyond and out[-1] == last[len(out) - 1 - shift] else 0
            if agreed >= self.longest:
                out += last[len(out) - shift :]
        return new, out

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding behind the last tokens of all prefixes."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tokens(self.extend(data, []))

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_words or "  " in text or any(" " + c in text or c + " " in text for c in WHITE_SPACE if c != " " and c in text) or text[:1] == " " or text[-1:] == " ":
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self._words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(shared, digest: str, pattern: str) -> Encoder:
    """A Python worker's encoder: tables are built once in each."""
    key = (pattern, digest)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` (text and others) and the token ids (array<int>) of every whole text.

    Null and empty texts have no ids.  Repeated rows give repeated rows; an
    empty table gives an empty result.  The vocabulary is read by the driver
    and broadcast: its size doesn't depend on the data.
    """
    return _encoded(spark, docs, vocabulary, pattern, keep, "token_ids array<int>", lambda encoder, ids: [pa.array([np.frombuffer(i, dtype="<i4") for i in ids], pa.list_(pa.int32()))])


def encoding_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs` (doc_id, text): encoded and decoded again.

    Null counts as the empty text, which has no tokens; null doc_ids and
    repeated rows are ordinary rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def digests(encoder: Encoder, ids: list[bytes]) -> list[pa.Array]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i) for i in ids], pa.string()), pa.array([sha(encoder.decode(i)) for i in ids], pa.string())]

    return _encoded(spark, docs, vocabulary, pattern, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _encoded(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], schema: str, made) -> DataFrame:
    small_batches(spark)
    ranks = read_ranks(vocabulary)
    shared, digest = spark.sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = [*keep, *[c.split()[0] for c in schema.split(", ")]]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, digest, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made(encoder, ids)], names=names)

    return kept.mapInArrow(run, fields)
