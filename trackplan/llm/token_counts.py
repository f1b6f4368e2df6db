"""Token counts by a finite-state transducer compiled from a tokenizer.

The transducer reads the symbols of words.  Its state knows, for every place
from which a token could still be running, how much of a token has been read
since, the last token before it, and how many tokens that prefix had; so the
one valid last token of the next prefix follows, and the transition carries the
change in the count.  States are made when they are first reached
(deterministic, exact); at a word's last symbol it is back in its start state.

Words are cut into pieces by a small automaton over characters, which knows the
kind of the open piece, the transducer's state, and the characters that cannot
be fed to it yet because a piece's last symbol is marked.

Long texts are read in chunks.  A chunk's map takes an entry state to an exit
state and a count.  From the first white space on it is constant: the exit
state reached from the start of the last word, and the count until there.
Before, it is given by the characters it reads.  Maps compose, without reading
again what is behind a known state, and are composed by a scan in pairs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE, _Memo
from .merges import Merges
from .storage import small_batches

#: States that are kept before compiling anew, and characters of a chunk.
STATES, CHUNK = 40_000, 1 << 16
_ROOT = 0
_WHITE = regex.compile(r"\p{White_Space}+")
#: Fixed value: the pieces that the automaton knows.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT_ENDINGS, _LONG_ENDINGS = {"s", "t", "m", "d"}, {"r": "e", "v": "e", "l": "l"}


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: its own if it is visible, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of words given as symbols: bytes, and 256 + byte for the last."""

    def __init__(self, tokens: dict[str, int], merges: Merges):
        self.merges = merges
        self.children: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        for token, number in tokens.items():
            node = _ROOT
            for symbol in token:
                self.inner.add(node)
                node = self.children.setdefault((node, ord(symbol)), len(self.children) + 1)
            self.token_at[node] = number
        self._reset()

    def _reset(self) -> None:
        start = ((_ROOT, -1, 0),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change in the count), entered in the table."""
        running, emitted, last = [], None, -1
        for node, before, count in self.states[state]:
            child = self.children.get((node, symbol))
            if child is None:
                continue
            token = self.token_at.get(child)
            if token is not None and (before < 0 or self.merges.fits(before, token)):
                emitted, last = count + 1, token
            if child in self.inner:
                running.append((child, before, count))
        if emitted is None:
            raise ValueError("the vocabulary lacks a symbol of the text")
        if symbol >= 256:
            target = 0
        else:
            key = (*((node, before, count - emitted) for node, before, count in running), (_ROOT, last, 0))
            target = self.number.get(key)
            if target is None:
                target = self.number[key] = len(self.states)
                self.states.append(key)
                self.next.append({})
        self.next[state][symbol] = target, emitted
        return target, emitted

    def step(self, state: tuple, symbols: Iterable[int]) -> tuple[tuple, int]:
        """(next state, tokens) from a state given by what it knows, so that it outlasts the table."""
        number, total = self.number.get(state), 0
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        for symbol in symbols:
            step = self.next[number].get(symbol) or self._compile(number, symbol)
            number = step[0]
            total += step[1]
        return self.states[number], total

    def count(self, word: bytes) -> int:
        """Tokens of a word that ends with its last byte."""
        if len(self.states) > STATES:
            self._reset()
        state, total = 0, 0
        table = self.next
        for symbol in (*word[:-1], word[-1] + 256):
            step = table[state].get(symbol)
            if step is None:
                step = self._compile(state, symbol)
            state = step[0]
            total += step[1]
        return total


_LETTERS, _DIGIT, _OTHER, _QUOTE, _NONE = range(5)
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_START = ((_ROOT, -1, 0),)


class State(NamedTuple):
    """Where the automaton is in a word: kind of the open piece, the transducer's state, characters not fed to it yet."""

    kind: int = _NONE
    inner: tuple = _START
    pending: str = ""


@dataclass
class Part:
    """The map of a chunk: from any state it reads `head`; if white space follows, `count` tokens and the state `end` do (None: no white space)."""

    head: str
    count: int = 0
    end: State | None = None


class Counter:
    """Counts a text's tokens as the tokenizer described by `spec` does, special tokens in the text included."""

    def __init__(self, spec: dict):
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or split["pattern"]["Regex"] != PIECES:
            raise ValueError("this tokenizer's form is not supported")
        bytes_of = byte_characters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            plain = "".join(chr(bytes_of[c]) for c in (token[: -len(suffix)] if ends else token))
            return plain[:-1] + chr(ord(plain[-1]) + 256) if ends else plain

        vocab = {t: i for t, i in model["vocab"].items() if all(c in bytes_of for c in t.removesuffix(suffix))}
        # merges are tried in their own order: tokens are renumbered by it, symbols first
        rank = {t: k for k, t in enumerate(t for t in vocab if len(symbols(t)) == 1)}
        merges, first = Merges(), len(rank)
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            rank.setdefault(left + right, first + k)
            merges.add(first + k, rank[left], rank[right])
        self.transducer = Transducer({symbols(t): k for t, k in rank.items()}, merges)
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.piece = _Memo(lambda p: self.transducer.count(p.encode("utf-8", "replace")))
        self.kind = _Memo(self._kind)
        self.word = _Memo(lambda w: sum(map(self.piece.__getitem__, self.pieces.findall(w))))

    def _kind(self, char: str) -> int:
        return _LETTERS if _LETTER.match(char) else _DIGIT if _NUMBER.match(char) else _QUOTE if char == "'" else _OTHER

    def _opened(self, char: str) -> tuple[State, int]:
        kind = self.kind[char]
        return (State(), self.piece[char]) if kind == _DIGIT else (State(kind, _START, char), 0)

    def closed(self, state: State) -> int:
        """Tokens that the end of the word adds."""
        kind, inner, pending = state
        if kind == _NONE:
            return 0
        if kind == _QUOTE:
            return sum(map(self.piece.__getitem__, pending))
        last = pending.encode("utf-8", "replace")
        return self.transducer.step(inner, (*last[:-1], last[-1] + 256))[1]

    def _next(self, state: State, char: str) -> tuple[State, int]:
        kind, inner, pending = state
        sort = self.kind[char]
        if kind == _QUOTE and len(pending) == 2:
            if _LONG_ENDINGS[pending[1]] == char:
                return State(), self.piece[pending + char]
            after, more = self._next(State(_LETTERS, _START, pending[1]), char)
            return after, self.piece["'"] + more
        if kind == _QUOTE and char in _SHORT_ENDINGS:
            return State(), self.piece[pending + char]
        if kind == _QUOTE and char in _LONG_ENDINGS:
            return State(_QUOTE, _START, pending + char), 0
        if (kind == sort == _LETTERS) or (kind in (_OTHER, _QUOTE) and sort in (_OTHER, _QUOTE)):
            inner, tokens = self.transducer.step(inner, pending.encode("utf-8", "replace"))
            return State(sort if sort == _LETTERS else _OTHER, inner, char), tokens
        after, more = self._opened(char)
        return after, self.closed(state) + more

    def read(self, state: State, text: str) -> tuple[State, int]:
        """(state, tokens) after reading characters of one word."""
        total = 0
        for char in text:
            state, tokens = self._next(state, char)
            total += tokens
        return state, total

    def part(self, text: str) -> Part:
        """The map of a chunk of normalised text."""
        # str.split also cuts at four control characters that are not white space
        words = _WHITE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if text[:1] in WHITE_SPACE:
            words.insert(0, "") if words[:1] != [""] else None
        if text[-1:] in WHITE_SPACE:
            words.append("") if words[-1:] != [""] or len(words) == 1 else None
        if len(words) == 1:
            return Part(words[0])
        end, tokens = self.read(State(), words[-1])
        return Part(words[0], sum(map(self.word.__getitem__, words[1:-1])) + tokens, end)

    def compose(self, a: Part, b: Part) -> Part:
        """The map of one chunk after the other."""
        if a.end is None:
            return Part(a.head + b.head, b.count, b.end)
        end, tokens = self.read(a.end, b.head)
        if b.end is None:
            return Part(a.head, a.count + tokens, end)
        return Part(a.head, a.count + tokens + self.closed(end) + b.count, b.end)

    def plain(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text without special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # sigma is lowered alike everywhere
        if len(self.transducer.states) > STATES:
            self.transducer._reset()
        text = f" {text} "  # the first map is constant, the last ends between words
        parts = [self.part(text[at : at + chunk]) for at in range(0, len(text), chunk)]
        while len(parts) > 1:
            parts = [self.compose(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].count + self.closed(parts[0].end)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self.plain, between))


_COUNTERS: dict[int, Counter] = {}


def _counter(shared) -> Counter:
    text = shared.value
    if hash(text) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[hash(text)] = Counter(json.loads(text))
    return _COUNTERS[hash(text)]


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of `docs` (doc_id, text).

    Whole texts are counted; null counts as the empty text, which has no
    tokens.  Strings of special tokens in a text count as one token each.  Null
    doc_ids and repeated rows are ordinary rows; other columns are not read; an
    empty table gives an empty result.  The tokenizer file is read by the
    driver and broadcast: its size doesn't depend on the data.
    """
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
