"""Word shingles of UTF-8 texts as sets of 64-bit hashes, for many texts at once.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A text's set holds its distinct runs of `width` words; a text of fewer words
has one shingle, the whole sequence; a text without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one numpy pass; memory is about fifty times that.
PASS_BYTES = 1 << 20
#: Words of more bytes are hashed by blake2b, so that no pass has to hold one whole.
LONG_WORD = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * ODD)


_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = seeded(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_POWER = np.cumprod(np.full(PASS_BYTES + 1, 0xD6E8FEB86659FD93, dtype=np.uint64))
_PLACE = seeded(64, 2) | np.uint64(1)


def _long(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little")


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in at most PASS_BYTES bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.ones(len(raw) + 2, dtype=np.int8)
    gap[1:-1] = _BREAK[raw]
    step = np.diff(gap)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _POWER[PASS_BYTES - starts])
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[k] = _long(data[starts[k] : ends[k]])
    return hashes, starts


def _cut(data: bytes) -> Iterator[bytes]:
    """Parts of a long text: at most PASS_BYTES each and cut at a gap, or one long word."""
    at = 0
    while at < len(data):
        end = min(at + PASS_BYTES, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_BREAK[np.frombuffer(data, np.uint8, end - at, at)])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and not _BREAK[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def _words_of_long(data: bytes) -> np.ndarray:
    parts = [_words(p)[0] if len(p) <= PASS_BYTES else np.array([_long(p)], dtype=np.uint64) for p in _cut(data)]
    return np.concatenate(parts)


def _sets(words: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> list[np.ndarray]:
    if len(words) >= width:
        windows = words[: len(words) - width + 1] * _PLACE[0]
        for j in range(1, width):
            windows = windows + words[j : len(words) - width + 1 + j] * _PLACE[j]
        windows = mix(windows)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + _PLACE[width : width + 1] * np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[list[np.ndarray]]:
    """The sorted shingle sets of `texts` in order, as lists for a few texts at a time."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if size + len(text) + 1 > PASS_BYTES and waiting:
            yield _joined(waiting, width)
            waiting, size = [], 0
        if len(text) + 1 > PASS_BYTES:
            words = _words_of_long(text)
            yield _sets(words, np.array([0]), np.array([len(words)]), width)
        else:
            waiting.append(text)
            size += len(text) + 1
    if waiting:
        yield _joined(waiting, width)


def _joined(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, starts = _words(b" ".join(texts))
    lengths = np.array([len(t) + 1 for t in texts])
    edges = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return _sets(words, edges[:-1], edges[1:], width)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures (len(sets), size) of non-empty sets, as uint32."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    if not sets:
        return out
    together = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    factors, shifts = seeded(size, 3) | np.uint64(1), seeded(size, 4)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(together * factors[k] + shifts[k], starts) >> np.uint64(32)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
