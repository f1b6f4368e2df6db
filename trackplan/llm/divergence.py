"""How far the sources of a language are from each other, by systolic rotation.

Every (lang, source) group is a vector of shares over the terms that its
language keeps.  Vectors are cut into slices of terms and groups into blocks;
the blocks stay where they are (a bucketed table that no join moves) while
compressed copies of their peers circulate: in each round of a round-robin
tournament every block meets one other, the later of the two travels to the
earlier, and a meeting gives both directions.  Partial sums of the slices are
added at the end.  The terms that set a group apart from its language are
ranked by local heaps in each task before they are shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Scratch, small_batches

#: Documents of a language that a kept term occurs in at least.
LEAST_DOCS = 30
#: Terms of a slice on average; a vector of one slice is what a meeting holds dense.
SLICE_TERMS = 1 << 15
#: Groups of a block on average: at least, and at most where a language has many sources.
BLOCK_GROUPS, MOST_GROUPS, ROUNDS = 8, 256, 64
#: Terms that are ranked for each group.
TOP = 50
#: Counts and heap entries that a task holds before it hands them on.
MOST_ENTRIES = 400_000

# Bytes below 0x80 that are no letters end a term; A-Z are lower-cased.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, added up as far as memory allows."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            within = docs[lang, source]
            terms = list(own)
            for a in range(0, len(terms), 10_000):
                some = terms[a : a + 10_000]
                k = len(some)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k, pa.string()), "source": pa.array([source] * k, pa.string()), "term": pa.array(some, pa.binary()).cast(pa.string()), "n": pa.array([own[t] for t in some], pa.int64()), "docs": pa.array([within[t] for t in some], pa.int64())})
        counts.clear()
        docs.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = terms_of(text.as_py())
            own = counts[lang, source]
            size -= len(own)
            own.update(terms)
            size += len(own)
            docs[lang, source].update(set(terms))
        if size > MOST_ENTRIES:
            yield from handed()
            size = 0
    yield from handed()


def share(n: Column, whole: Column) -> Column:
    """1 + floor(1e9 (n + 5) / whole) in exact integers."""
    scaled = (n + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    rest = scaled % whole.cast("decimal(19,0)")
    return ((scaled - rest) / whole.cast("decimal(19,0)")).cast("long") + 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors as compressed bytes: term numbers, then shares."""
    for batch in batches:
        cells = batch.column(batch.num_columns - 1)
        packed = []
        for cell in cells:
            numbers = np.array([x["number"].as_py() for x in cell.values] if cell.is_valid else [], dtype=np.int32)
            shares = np.array([x["p"].as_py() for x in cell.values] if cell.is_valid else [], dtype=np.int64)
            packed.append(zlib.compress(numbers.tobytes() + shares.tobytes(), 1))
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(packed, pa.binary())], names=[*names, "packed"])


def unpacked(packed: bytes, size: int, rest: int) -> np.ndarray:
    """A slice of a vector, with `rest` where a group has no occurrences."""
    raw = zlib.decompress(packed)
    k = len(raw) // 12
    out = np.full(size, rest, dtype=np.int64)
    out[np.frombuffer(raw, np.int32, k)] = np.frombuffer(raw, np.int64, k, 4 * k)
    return out


def _vectors(table: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    for source, size, rest, packed in zip(*[table.column(c).to_pylist() for c in ("source", "size", "rest", "packed")], strict=True):
        yield source, unpacked(packed, size, rest)


def _pairs(lang: str, pairs: list[tuple[str, str, int]]) -> pa.Table:
    both = [*pairs, *[(b, a, v) for a, b, v in pairs]]
    a, b, v = zip(*both, strict=True) if both else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})


def _at_home(table: pa.Table) -> pa.Table:
    """The pairs within a block."""
    own = list(_vectors(table))
    found = [(a, b, int(np.abs(x - y).sum())) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :]]
    return _pairs(table.column("lang")[0].as_py(), found)


def _meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    """The pairs of a block with the one that visits it."""
    if not home.num_rows or not guests.num_rows:
        return _pairs("", [])
    own = list(_vectors(home))
    found = [(a, b, int(np.abs(x - y).sum())) for b, y in _vectors(guests) for a, x in own]
    return _pairs(home.column("lang")[0].as_py(), found)


def partner(block: Column, blocks: Column, turn: int) -> Column:
    """The block that `block` of 0..blocks-1 meets in a turn (0, 1, ...) of a round-robin tournament; null if it rests.

    With an odd number one more seat is added; seats i and j below the last
    meet when i + j = turn modulo the others, and the one that would meet
    itself meets the last seat.
    """
    seats = blocks + blocks % 2
    ring = F.nullif(seats - 1, F.lit(0))
    facing = F.pmod(F.lit(turn) - block, ring)
    half = F.pmod(F.lit(turn) * (seats / 2).cast("int"), ring)
    met = F.when(block == seats - 1, half).when(facing == block, seats - 1).otherwise(facing)
    return F.when((F.lit(turn) < ring) & (met < blocks), met)


def _heaps(top: int):
    """The best `top` rows of each group among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = defaultdict(list)
        held = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), rows in best.items():
                rows = heapq.nsmallest(top, rows)
                k = len(rows)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k, pa.string()), "source": pa.array([source] * k, pa.string()), "item": pa.array([t for _, t in rows], pa.binary()).cast(pa.string()), "value": pa.array([-v for v, _ in rows], pa.int64())})
            best.clear()

        for batch in batches:
            for lang, source, term, value in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                rows = best[lang, source]
                rows.append((-value, term.encode()))
                held += 1
                if len(rows) >= 20 * top:
                    held -= len(rows) - top
                    rows[:] = heapq.nsmallest(top, rows)
            if held > MOST_ENTRIES:
                yield from handed()
                held = 0
        yield from handed()

    return run


def divergence(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """Distances between the sources of each language of `docs` (text, lang, source), and each source's own terms.

    Returns lang, source, part, item, value, rank.  A term is a run of letters
    a-z and characters beyond ASCII, A-Z lower-cased; a language keeps those in
    `least_docs` documents.  A group's share of a term is
    p = 1 + floor(1e9 (count + 5) / (N + 5 V)).  `pair`: |p - q| summed over
    kept terms, for each other source of the language.  `term`: p - q against
    the whole language, the `top` terms with occurrences and p > q.  Ranks go by
    value descending, then item.  Nulls count as ''; groups without terms take
    part; repeated rows count each; other columns are not read; an empty table
    gives an empty result.
    """
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "divergence") as scratch:
        filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        rows = docs.select(*filled, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        counts = rows.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = scratch.store(counts, "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        kept = scratch.store(kept, "kept")
        groups = rows.select("lang", "source").distinct()
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left").na.fill(0, ["v", "all"])
        each = F.least(F.greatest(F.lit(block_groups), F.ceil(F.col("sources") / ROUNDS)), F.lit(max(block_groups, MOST_GROUPS)))
        langs = scratch.store(langs.select("*", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int").alias("slices"), F.ceil(F.col("sources") / each).cast("int").alias("blocks")), "langs")
        kept = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).drop("slices")
        # a slice holds about `slice_terms` terms, whatever the vocabulary
        kept = kept.withColumn("number", F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1)
        counted = scratch.store(counts.join(kept, ["lang", "term"]).drop("docs"), "counted")
        sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["own"]).join(langs, "lang")
        groups = scratch.store(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")

        whole = lambda n: F.col(n) + 5 * F.col("v")
        shared = counted.join(groups.select("lang", "source", "own", "all", "v"), ["lang", "source"]).select("lang", "source", "slice", "number", "term", share(F.col("n"), whole("own")).alias("p"), share(F.col("total"), whole("all")).alias("q"))
        apart = shared.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
        best = apart.mapInArrow(_heaps(top), "lang string, source string, item string, value long")

        cells = shared.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("number", "p")).alias("cell"))
        sizes = counted.select("lang", "slice", "number").groupBy("lang", "slice").agg((F.max("number") + 1).alias("size"))
        # a language without kept terms has no share at all: its vectors are empty
        rest = F.when(F.col("v") > 0, share(F.lit(0), whole("own"))).otherwise(0).cast("long")
        frames = groups.select("lang", "source", F.col("block").alias("home"), "blocks", rest.alias("rest"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        frames = frames.join(sizes, ["lang", "slice"], "left").join(cells, ["lang", "source", "slice"], "left")
        schema = "lang string, slice int, home int, source string, blocks int, size int, rest long, packed binary"
        vectors = frames.select("lang", "slice", "home", "source", "blocks", F.coalesce("size", F.lit(0)).alias("size"), "rest", "cell").mapInArrow(_pack, schema)
        at = ["lang", "slice", "home"]
        residents = scratch.bucketed(vectors, "vectors", at, tasks)
        out = "lang string, source string, item string, value long"
        found = [scratch.store(residents.groupBy(*at).applyInArrow(_at_home, out), "at-home", keep=True)]
        blocks = langs.agg(F.max("blocks")).first()[0] or 0
        for turn in range(blocks + blocks % 2 - 1 if blocks > 1 else 0):
            met = partner(F.col("home"), F.col("blocks"), turn)
            guests = residents.withColumn("met", met).where(F.col("met") < F.col("home")).select("lang", "slice", F.col("met").alias("home"), "source", "size", "rest", "packed")
            found.append(scratch.store(residents.groupBy(*at).cogroup(guests.groupBy(*at)).applyInArrow(_meeting, out), "turn", keep=True))
        best = scratch.store(best, "terms", keep=True)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(best.select("lang", "source", F.lit("term"), "item", "value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
