"""Order statistics of large groups without gathering a group: ranks are found by counts that narrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import is_small

#: Values of a group that are sorted at once; larger groups are narrowed first.
MOST = 10_000
#: Bins of one narrowing.
BINS = 4096
#: Slopes tried at once in a round of `median_slopes`, and rounds at most.
SLOPES, ROUNDS = 8, 60
#: Pairs of an interval that are listed, points of a block, and points of one bin that meet those of another.
FEW, BLOCK, MOST_MET = 100_000, 1 << 17, 1 << 17
#: Points of a block that bins are bounded by, at least, and the others for each of them.
SOME, SPARSE = 64, 2048


def percentiles(rows: DataFrame, by: list[str], value: Column, q: float, cut: Callable[[DataFrame, str], DataFrame], most: int = MOST, bins: int = BINS, name: str = "value") -> DataFrame:
    """The exact q-quantile of each group, between its two neighbours, as `percentile` gives it; nulls are left out.

    The range that holds a wanted rank is cut into bins between its least and
    largest value, counted, and replaced by the bin with the rank, until it
    holds `most` values or one.  A task's state is the bins of its groups.
    """
    rows = rows.select(*by, value.cast("double").alias("x")).where("x is not null")
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = (F.col("n") - 1) * q
    ranks = F.explode(F.array(F.floor(at).cast("long"), F.ceil(at).cast("long")))
    ranges = whole.select(*by, at.alias("at"), ranks.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n").distinct()
    ranges = cut(ranges, "ranges")
    wide = (F.col("n") > most) & (F.col("lo") < F.col("hi"))
    while not (open_ranges := ranges.where(wide)).isEmpty():
        bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        inside = rows.join(open_ranges, by).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        counts = inside.groupBy(*by, "at", "rank", "below", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # at most `bins` rows for each rank
        before = F.coalesce(F.sum("n").over(W.partitionBy(*by, "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("below", F.col("below") + before).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        ranges = cut(ranges.where(~wide).unionByName(counts.select(*by, "at", "rank", "lo", "hi", "below", "n")), "ranges")
    one = ranges.where("lo = hi").select(*by, "at", "rank", F.col("lo").alias("x"))
    few = rows.join(ranges.where("lo < hi"), by).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    few = few.groupBy(*by, "at", "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("all"))
    found = one.unionByName(few.select(*by, "at", "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
    ends = found.groupBy(*by, "at").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    return ends.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias(name))


def falling(t: np.ndarray, r: np.ndarray) -> int:
    """Pairs t_i < t_j with r_i >= r_j: inversions of the ranks, counted bit by bit as these are sorted from the highest bit on."""
    if (t[1:] < t[:-1]).any():
        order = np.argsort(t, kind="stable")
        t, r = t[order], r[order]
    n = len(t)
    rank = np.empty(n, dtype=np.int64)
    rank[n - 1 - np.argsort(r[::-1], kind="stable")] = np.arange(n)  # of equal values the earlier one ranks higher
    later = t[1:] > t[:-1]
    if not later.all():  # ranks rise within one time, which so makes no pair
        rank = np.sort(np.concatenate(([0], np.cumsum(later))) * n + rank) % n
    width = 1 << max(n - 1, 0).bit_length()
    rank = np.concatenate((rank, np.arange(n, width))).astype(np.int64 if width > 1 << 30 else np.int32)
    total = 0
    while width > 1:
        half = width // 2
        high = (rank & half) != 0
        low = np.flatnonzero(~high)
        # a low rank makes a pair with each high one before it in its run, which holds as many low as high ones
        total += int((low & (width - 1)).sum()) - len(rank) // width * (half * (half - 1) // 2)
        rank = np.concatenate((rank[low].reshape(-1, half), rank[high].reshape(-1, half)), axis=1).ravel()
        width = half
    return total


def median_slopes(points: DataFrame, by: list[str], t: str, e: str, cut: Callable[[DataFrame, str], DataFrame], parts: int, slopes: int = SLOPES, rounds: int = ROUNDS, precision: float = 1e-14, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """by, slope: the median of the slopes between all two points of each group at different times, without making all pairs.

    A slope is at most m if its points are in falling order of e - m t.  Such
    pairs are counted for several m at once (`_counted`).  The interval with
    the median starts from the slopes between a few points of the group and is
    widened until the counts say that it holds the rank; then most m lie close
    to where the rank is by its counts, so that of N pairs about sqrt(N) are
    left, and the others part it evenly.  Once an interval holds `few` pairs
    (and 16 a point) they are listed (`_listed`), and the slope is exact; where points lie so
    close that this isn't cheap, it narrows down to `precision` of its place or
    of the slope across the group, or for `rounds`.  An even number of pairs
    has two medians, whose mean is given.  `slopes` are tried in a round, in
    groups beyond 2**17 points no more than SLOPES.  One time lies in one block.
    """
    points = points.select(*by, F.col(t).cast("double").alias("t"), F.col(e).cast("double").alias("e")).dropna(subset=[*by, "t", "e"])
    n = points.count()
    size = max(1, -(-n // block), min(parts, -(-n // (block >> 4))))
    dealt = points.repartitionByRange(size, *by, "t").withColumn("block", F.spark_partition_id()).sortWithinPartitions(*by, "t")
    blocks = cut(dealt.mapInArrow(_packed(by), f"{_kinds(points, by)}, block int, n long, t binary, e binary, some_t array<double>, some_e array<double>"), "blocks")
    times = points.groupBy(*by, "t").agg(F.count("*").alias("c"), F.max("e").alias("e1"), F.min("e").alias("e0"))
    about = times.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("same"), F.max("e1").alias("e1"), F.min("e0").alias("e0"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    about = about.withColumn("pairs", F.expr("n * (n - 1) div 2") - F.col("same")).where("pairs > 0")
    some = cut(blocks.groupBy(*by).agg(F.collect_list(F.struct("block", "some_t", "some_e")).alias("some")), "some")
    starts = some.mapInArrow(_starts(by), f"{_kinds(points, by)}, lo double, hi double")
    flat = about.where("e0 = e1").select(*by, F.lit(0.0).alias("slope"))
    about = about.where("e0 < e1")
    wanted = F.explode(F.array_distinct(F.array(F.expr("(pairs + 1) div 2"), F.expr("pairs div 2 + 1"))))
    step = F.greatest((F.col("e1") - F.col("e0")) / (F.col("t1") - F.col("t0")), F.lit(1e-300))
    tried = F.when(F.col("n") > 1 << 17, min(slopes, SLOPES)).otherwise(slopes)
    state = about.join(starts, by).select(*by, wanted.alias("rank"), ((F.col("pairs") + 1) / 2).alias("middle"), step.alias("scale"), (F.col("t1") - F.col("t0")).alias("span"), tried.alias("tried"), F.least(F.lit(few), 16 * F.col("n")).alias("few"), F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    # a little room, so that the slopes it was made from lie inside
    room = (F.col("hi") - F.col("lo")) / 64 + F.greatest(F.abs("lo"), F.abs("hi"), "scale") * 1e-12
    state = cut(state.withColumn("room", room).withColumns({"lo": F.col("lo") - F.col("room"), "hi": F.col("hi") + F.col("room"), "below": F.lit(None).cast("long"), "upto": F.lit(None).cast("long")}).drop("room"), "state")
    state = _narrowed(blocks, some, state, by, cut, rounds, precision)
    short = F.coalesce(F.col("upto") - F.col("below") <= F.col("few"), F.lit(False))
    listed = _listed(blocks, some, state.where(short).select(*by, "lo", "hi", "span").distinct(), by)
    state = cut(state.join(listed, [*by, "lo", "hi"], "left"), "listed")
    whole = F.coalesce(short & (F.size("found") == F.col("upto") - F.col("below")), F.lit(False))
    exact = state.where(whole).select(*by, "rank", F.get("found", (F.col("rank") - F.col("below") - 1).cast("int")).alias("slope"))
    rest = state.where(~whole).drop("found").withColumn("few", F.lit(0).cast("long"))
    if not rest.isEmpty():
        near = _narrowed(blocks, some, rest, by, cut, rounds, precision)
        # values that repeat have level pairs, often half of all
        exact = exact.unionByName(near.select(*by, "rank", F.when(F.abs("hi") <= F.col("scale") * precision, 0.0).otherwise(F.col("hi")).alias("slope")))
    return exact.unionByName(flat.withColumn("rank", F.lit(0).cast("long"))).groupBy(*by).agg(F.avg("slope").alias("slope"))


def _kinds(frame: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)


def _packed(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over a sorted block: a row for each group, with its points as arrays and some of them drawn at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        changes = np.zeros(table.num_rows - 1, dtype=bool)
        for c in by:
            column = table.column(c).combine_chunks()
            changes |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.flatnonzero(changes) + 1))
        t, e = (table.column(c).to_numpy() for c in ("t", "e"))
        block = table.column("block")[0].as_py()
        rng = np.random.default_rng(block)
        for lot in np.array_split(np.arange(len(first)), -(-len(first) // 1000)):
            ends = np.append(first, len(t))
            spans = [slice(ends[k], ends[k + 1]) for k in lot]
            drawn = [np.arange(x.start, x.stop) if x.stop - x.start <= SOME else rng.integers(x.start, x.stop, max(SOME, (x.stop - x.start) // SPARSE)) for x in spans]
            columns = [table.column(c).combine_chunks().take(pa.array(first[lot])) for c in by]
            columns += [pa.array(np.full(len(lot), block, dtype=np.int32)), pa.array([x.stop - x.start for x in spans], pa.int64()), *[pa.array([v[x].tobytes() for x in spans], pa.binary()) for v in (t, e)], *[pa.array([v[x] for x in drawn], pa.list_(pa.float64())) for v in (t, e)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "block", "n", "t", "e", "some_t", "some_e"])

    return run


def _starts(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over groups: an interval that probably holds the median, from the slopes between some points; where counting begins, no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for some in batch.column("some").to_pylist():
                t, e = (np.concatenate([s[c] for s in some]) for c in ("some_t", "some_e"))
                if len(t) > 2048:
                    drawn = np.random.default_rng(0).permutation(len(t))[:2048]
                    t, e = t[drawn], e[drawn]
                i, j = np.nonzero(t[:, None] < t)
                apart = min(0.5, 1.5 / np.sqrt(len(t)))
                ends.append(np.quantile((e[j] - e[i]) / (t[j] - t[i]), (0.5 - apart, 0.5 + apart)) if len(i) else (0.0, 0.0))
            lo, hi = np.asarray(ends, dtype=float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(lo), pa.array(hi)], names=[*by, "lo", "hi"])

    return run


def _narrowed(blocks: DataFrame, some: DataFrame, state: DataFrame, by: list[str], cut: Callable[[DataFrame, str], DataFrame], rounds: int, precision: float) -> DataFrame:
    """The state when every interval holds its rank and is short or has few pairs, or after `rounds`.

    A row is a rank of a group; below and upto: pairs with slopes of at most lo and hi, if lo is below the rank and hi is not.
    """
    held = F.col("below").isNotNull() & F.col("upto").isNotNull()
    width, middle = F.col("hi") - F.col("lo"), (F.col("lo") + F.col("hi")) / 2
    ended = held & ((width <= F.greatest(F.abs(middle), F.col("scale")) * precision) | (F.col("upto") - F.col("below") <= F.col("few")))
    inside = (F.col("upto") - F.col("below")).cast("double")
    place = F.col("lo") + width * (F.col("middle") - F.col("below") - 0.5) / inside
    near = F.least(F.lit(0.125), 3 / F.sqrt(inside))
    evenly = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: F.col("lo") + width * i / (k + 1))
    close = F.array(*[place + width * near * sign * F.pow(0.125 / near, F.lit(power)) for sign in (-1.0, 1.0) for power in (0.0, 0.5, 1.0)])
    beyond = F.array(*[middle + width / 2 * x for x in (-64.0, -1.0, -0.25, 0.0, 0.25, 1.0, 64.0)])
    tries = F.when(~held, beyond).when((inside < 64) | (F.col("tried") < 7), evenly(F.col("tried"))).otherwise(F.concat(close, evenly(F.greatest(F.col("tried") - 6, F.lit(1)))))
    tries = F.filter(tries, lambda m: ~held | ((m > F.col("lo")) & (m < F.col("hi"))))
    for _ in range(rounds):
        open_state = state.where(~ended)
        if open_state.isEmpty():
            break
        asked = open_state.select(*by, F.explode(tries).alias("m")).groupBy(*by).agg(F.sort_array(F.collect_set("m")).alias("ms"))
        found = open_state.join(_counted(blocks, some, asked, by).groupBy(*by).agg(F.collect_list(F.struct("m", "pairs")).alias("of")), by, "left")
        under, over = F.array_max(F.filter("of", lambda x: x["pairs"] < F.col("rank"))), F.array_min(F.filter("of", lambda x: x["pairs"] >= F.col("rank")))
        new = {"lo": F.when(F.col("below").isNotNull(), F.col("lo")), "hi": F.when(F.col("upto").isNotNull(), F.col("hi"))}
        lo, hi = F.coalesce(under["m"], new["lo"], middle - width * 2048), F.coalesce(over["m"], new["hi"], middle + width * 2048)
        found = found.withColumns({"lo": lo, "hi": hi, "below": F.coalesce(under["pairs"], "below"), "upto": F.coalesce(over["pairs"], "upto")}).drop("of")
        state = cut(state.where(ended).unionByName(found), "state")
    return state


class _Points:
    """Points of a group in one block, and some of the group's; about one of these, so that rounding is that of their range."""

    def __init__(self, row: dict) -> None:
        some = row["some"]
        t, e = (np.concatenate([s[c] for s in some]) for c in ("some_t", "some_e"))
        self.size, self.block, self.of = len(some), row["block"], np.concatenate([np.full(len(s["some_t"]), s["block"]) for s in some])
        self.some_t, self.some_e = t - t[0], e - e[0]
        self.t, self.e = np.frombuffer(row["t"]) - t[0], np.frombuffer(row["e"]) - e[0]

    def bins(self, m: float, r: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Upper bounds of all bins of e - m t but the last, and where bins end in the sorted values r of the block; of equal values, those of later blocks are lower."""
        some = self.some_e - m * self.some_t
        order = np.lexsort((-self.of, some))[(np.arange(1, self.size) * len(some)) // self.size]
        bound = some[order]
        return bound, [0, *np.searchsorted(r, np.where(self.of[order] >= self.block, bound, np.nextafter(bound, np.inf))).tolist(), len(r)]


def _with(blocks: DataFrame, some: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Blocks with what is asked of their group and some of its points; few groups are broadcast."""
    asked = asked.join(some, by)
    return blocks.drop("some_t", "some_e").join(F.broadcast(asked) if is_small(some) else asked, by)


def _counted(blocks: DataFrame, some: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, m, pairs: the pairs of slope m at most, for each of the array ms.

    Points lie in blocks of time ranges, and for each m in bins of ranges of
    e - m t, as many as blocks.  Pairs within a block or within a bin are
    counted in one task; those apart in both by the numbers of points in
    blocks and bins.
    """
    names = [*by, "m", "bin", "block", "n", "pairs", "r"]
    kinds = _kinds(blocks, by)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("block", "t", "e", "ms", "some")}
                points = _Points(row)
                for m in row["ms"]:
                    r = points.e - m * points.t
                    pairs, r = falling(points.t, r), np.sort(r)
                    _, ends = points.bins(m, r)
                    # a group of one block needs no bins
                    parts = [(i, b - a, r[a:b].tobytes() if len(ends) > 2 else b"") for i, (a, b) in enumerate(pairwise(ends)) if b > a]
                    count = len(parts)
                    own = [batch.column(c).take(pa.array([k] * count, pa.int64())) for c in by]
                    rest = [pa.array([m] * count, pa.float64()), pa.array([x[0] for x in parts], pa.int32()), pa.array([row["block"]] * count, pa.int32()), pa.array([x[1] for x in parts], pa.int64()), pa.array([pairs] + [0] * (count - 1), pa.int64()), pa.array([x[2] for x in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *rest], names=names)

    def in_bins(table: pa.Table) -> pa.Table:
        """Pairs of different blocks in one bin, with those within the blocks."""
        table = table.sort_by("block")
        block, n, r = (table.column(c) for c in ("block", "n", "r"))
        pairs = sum(table.column("pairs").to_pylist())
        if table.num_rows > 1:
            pairs += falling(np.repeat(block.to_numpy(), n.to_numpy()), np.concatenate([np.frombuffer(x) for x in r.to_pylist()]))
        return pa.table([*[table.column(c).slice(0, 1) for c in [*by, "m", "bin"]], pa.array([pairs], pa.int64()), pa.array([block.to_pylist()], pa.list_(pa.int32())), pa.array([n.to_pylist()], pa.list_(pa.int64()))], names=[*by, "m", "bin", "pairs", "blocks", "ns"])

    def across(table: pa.Table) -> pa.Table:
        """All pairs; those in an earlier block and a higher bin by the numbers of points, in at most blocks x bins cells."""
        table = table.sort_by("bin")
        pairs, every = sum(table.column("pairs").to_pylist()), np.unique(table.column("blocks").combine_chunks().flatten().to_numpy())
        before = np.zeros(len(every), dtype=np.int64)  # of lower bins, by block
        for blocks_of, ns in zip(table.column("blocks").to_pylist(), table.column("ns").to_pylist(), strict=True):
            own = np.zeros(len(every), dtype=np.int64)
            own[np.searchsorted(every, blocks_of)] = ns
            pairs += int((own * (before.sum() - np.cumsum(before))).sum())
            before += own
        return pa.table([*[table.column(c).slice(0, 1) for c in [*by, "m"]], pa.array([pairs], pa.int64())], names=[*by, "m", "pairs"])

    dealt = _with(blocks, some, asked, by).mapInArrow(in_blocks, f"{kinds}, m double, bin int, block int, n long, pairs long, r binary")
    bins = dealt.groupBy(*by, "m", "bin").applyInArrow(in_bins, f"{kinds}, m double, bin int, pairs long, blocks array<int>, ns array<long>")
    return bins.groupBy(*by, "m").applyInArrow(across, f"{kinds}, m double, pairs long")


def _listed(blocks: DataFrame, some: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, lo, hi, found: the sorted slopes above lo and up to hi; incomplete where too many points would meet.

    The values e - lo t of such a pair lie in rising order, no further apart
    than the interval times the group's span of time.  So points meet in bins
    of these values, to which those next above a bin are copied.
    """
    names = [*by, "lo", "hi", "bin", "own", "t", "e"]
    kinds = _kinds(blocks, by)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("block", "t", "e", "lo", "hi", "span", "some")}
                points = _Points(row)
                a = points.e - row["lo"] * points.t
                order = np.argsort(a, kind="stable")
                a, t, e = a[order], points.t[order], points.e[order]
                bound, ends = points.bins(row["lo"], a)
                reach = [*np.searchsorted(a, bound + _reach(row["lo"], row["hi"], row["span"], bound, t), side="right").tolist(), len(a)]
                parts = [(i, own, t[x:y].tobytes(), e[x:y].tobytes()) for i, (p, q) in enumerate(pairwise(ends)) for own, x, y in ((True, p, q), (False, q, min(reach[i], q + MOST_MET))) if y > x]
                own = [batch.column(c).take(pa.array([k] * len(parts), pa.int64())) for c in [*by, "lo", "hi"]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([x[i] for x in parts], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))]], names=names)

    def met(table: pa.Table, lo: float, hi: float) -> np.ndarray:
        t, e = (np.concatenate([np.frombuffer(x) for x in table.column(c).to_pylist()]) for c in ("t", "e"))
        own = np.repeat(table.column("own").to_numpy(), [len(x) // 8 for x in table.column("t").to_pylist()])
        a = e - lo * t
        order = np.argsort(a, kind="stable")
        a, t, e, own = a[order], t[order], e[order], own[order]
        b = e - hi * t
        first = np.searchsorted(a, a, side="right")
        counts = np.where(own, np.maximum(np.searchsorted(a, a + _reach(lo, hi, t.max() - t.min(), a, t), side="right") - first, 0), 0)
        out = []
        if counts.sum() <= MOST_MET * 256:
            total = np.cumsum(counts)
            for lot in np.split(np.arange(len(a)), np.searchsorted(total, np.arange(1 << 22, total[-1], 1 << 22))):
                i = np.repeat(lot, counts[lot])
                j = np.arange(len(i)) - np.repeat(np.cumsum(counts[lot]) - counts[lot], counts[lot]) + first[i]
                kept = (t[i] < t[j]) & (b[i] >= b[j])
                i, j = i[kept], j[kept]
                out.append((e[j] - e[i]) / (t[j] - t[i]))
        return np.concatenate([*out, np.empty(0)])

    def slopes_of(table: pa.Table) -> pa.Table:
        found = met(table, *(table.column(c)[0].as_py() for c in ("lo", "hi")))
        return pa.table([*[table.column(c).slice(0, 1) for c in [*by, "lo", "hi"]], pa.array([found], pa.list_(pa.float64()))], names=[*by, "lo", "hi", "found"])

    rows = _with(blocks, some, asked, by).mapInArrow(dealt, f"{kinds}, lo double, hi double, bin int, own boolean, t binary, e binary")
    bins = rows.groupBy(*by, "lo", "hi", "bin").applyInArrow(slopes_of, f"{kinds}, lo double, hi double, found array<double>")
    return bins.groupBy(*by, "lo", "hi").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))


def _reach(lo: float, hi: float, span: float, a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How far apart the values of a listed pair can be, with room for rounding."""
    return (hi - lo) * span + 1e-14 * (np.abs(a) + max(abs(lo), abs(hi)) * np.abs(t).max())
