"""Long series on timelines: blocks of samples in tasks, never a whole track.

A series is a table of blocks (by, block, samples: array<double>), each of
`length` samples but a track's last.  Every operator deals the blocks to the
windows that need them, with their overlap, and works on one window at a time:
what a task holds depends on block length, search range and window only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import offset_at


def blocks(samples: DataFrame, by: list[str], position: str, value: str, length: int) -> DataFrame:
    """Rows of samples as blocks; places without a sample are 0."""
    at = F.struct(F.pmod(F.col(position), F.lit(length)).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    own = samples.groupBy(*by, F.floor(F.col(position) / length).cast("long").alias("block")).agg(F.sort_array(F.collect_list(at)).alias("s"))
    last = F.element_at("s", -1)["i"]
    held = F.map_from_entries("s")
    whole = F.transform("s", lambda x: x["v"])  # no place is missing
    filled = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(held[i], F.lit(0.0)))
    return own.select(*by, "block", F.when(F.size("s") == last + 1, whole).otherwise(filled).alias("samples"))


def _joined(table: pa.Table, name: str, length: int, start: int, n: int) -> np.ndarray:
    """Samples start..start + n of the blocks in a table; what they don't cover is 0."""
    out = np.zeros(n)
    for block, samples in zip(table.column("block").to_pylist(), table.column(name), strict=True):
        if block is not None and samples.is_valid:
            values = samples.values.to_numpy(zero_copy_only=False)
            at = block * length - start
            a, b = max(0, -at), min(len(values), n - at)
            if b > a:
                out[at + a : at + b] = values[a:b]
    return out


def _types(frame: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in by)


def _keys(key: tuple) -> list:
    return [k.as_py() for k in key]


def correlated(a: DataFrame, reference: DataFrame, by: list[str], length: int, rate: float, most: float) -> DataFrame:
    """offset, confidence of each track's series against its reference, both in blocks, as `align.lag` finds them within `most` seconds.

    Overlap-save: each block of `a` meets the stretch of the reference that
    its lags can reach, their spectra are multiplied and summed, first in each
    task and then over tasks, and turned back once a track.
    """
    reach = int(np.ceil(most * rate))
    near = -(-reach // length)
    size = 1 << int(length + 2 * reach).bit_length()
    types = _types(a, by)

    def mean(side: DataFrame, name: str) -> DataFrame:
        sums = side.select(*by, F.aggregate("samples", F.lit(0.0), lambda x, v: x + v).alias("s"), F.size("samples").alias("n"), F.array_min("samples").alias("lo"), F.array_max("samples").alias("hi"))
        return sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias(f"{name}_mean"), F.sum("n").alias(f"{name}_n"), (F.max("hi") > F.min("lo")).alias(f"{name}_varies"))

    about = mean(a, "a").join(mean(reference, "r"), by)
    centred = lambda side, m: side.join(about.select(*by, m), by).select(*by, "block", F.transform("samples", lambda v: v - F.col(m)).alias("samples"))
    left, right = centred(a, "a_mean"), centred(reference, "r_mean")
    dealt = right.withColumn("at", F.explode(F.sequence(F.col("block") - near, F.col("block") + near)))

    def product(key: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
        *track, at = _keys(key)
        columns = [[k] for k in track] if own.num_rows and others.num_rows else [[] for _ in track]
        spectrum = []
        if own.num_rows and others.num_rows:
            x = _joined(own, "samples", length, at * length, length)
            y = _joined(others, "samples", length, at * length - reach, length + 2 * reach)
            spectrum = [(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size))).tobytes()]
        return pa.table([*[pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], pa.array(spectrum, pa.binary())], names=[*by, "spectrum"])

    fields = [pa.field(c, _arrow(a, c)) for c in by]
    spectra = left.withColumn("at", F.col("block")).groupBy(*by, "at").cogroup(dealt.groupBy(*by, "at")).applyInArrow(product, f"{types}, spectrum binary")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, spectrum in zip(*[batch.column(k).to_pylist() for k in range(len(by) + 1)], strict=True):
                own = np.frombuffer(spectrum, dtype=np.complex128)
                totals[tuple(key)] = totals[tuple(key)] + own if tuple(key) in totals else own
                if len(totals) > 64:
                    yield rows(totals)
                    totals = {}
        if totals:
            yield rows(totals)

    def rows(totals: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = list(zip(*totals, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=[*by, "spectrum"])

    def peak(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s, dtype=np.complex128) for s in table.column("spectrum").to_pylist())
        field = np.abs(np.fft.irfft(total, size))[: 2 * reach + 1]
        n, m, varies = (table.column(c)[0].as_py() for c in ("a_n", "r_n", "varies"))
        lags = np.arange(-reach, reach + 1)
        inside = np.flatnonzero((np.abs(lags) <= most * rate) & (lags > -n) & (lags < m))
        best = inside[np.argmax(field[inside])] if varies and len(inside) else None
        found = (0.0, 0.0) if best is None else (lags[best] / rate, field[best] / max(np.median(field[inside]), 1e-12))
        return pa.table([*[pa.array([k], f.type) for k, f in zip(_keys(key), fields, strict=True)], *[pa.array([float(v)], pa.float64()) for v in found]], names=[*by, "offset", "confidence"])

    partial = spectra.mapInArrow(summed, f"{types}, spectrum binary").join(about.select(*by, "a_n", "r_n", (F.col("a_varies") & F.col("r_varies")).alias("varies")), by)
    return partial.groupBy(*by).applyInArrow(peak, f"{types}, offset double, confidence double")


def _arrow(frame: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[column].dataType)


def offsets_at(probes: DataFrame, a: DataFrame, reference: DataFrame, by: list[str], probe: str, length: int, rate: float, search: float, window: float) -> DataFrame:
    """Each probe (by, probe, t, expected) with offset and confidence there: `align.offset_at` on the blocks that its window reaches."""
    t, expected = F.col("t"), F.col("expected")
    reached = lambda start, end: F.sequence(F.floor(F.greatest(F.lit(0.0), start * rate) / length).cast("long"), F.floor(F.greatest(F.lit(0.0), end * rate) / length).cast("long"))
    margin = 2.0 / rate
    key = [*by, probe]
    sides = []
    for side, start, end, name in ((a, t, t + window, "a"), (reference, t + expected - search, t + expected + search + window, "r")):
        asked = probes.withColumn("block", F.explode(reached(start - margin, end + margin)))
        # columns of their own on each side: both descend from the probes
        sides.append(asked.join(side, [*by, "block"], "left").select(*[F.col(c).alias(c) for c in (*key, "t", "expected", "block")], F.col("samples").alias(name)))
    fields = [pa.field(c, _arrow(probes, c)) for c in key]

    def measure(values: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
        at, guess = own.column("t")[0].as_py(), own.column("expected")[0].as_py()
        first_a, first_r = min(own.column("block").to_pylist()), min(others.column("block").to_pylist())
        span = lambda table, name: sum(len(s.values) if s.is_valid else 0 for s in table.column(name))
        x = _joined(own, "a", length, first_a * length, span(own, "a"))
        y = _joined(others, "r", length, first_r * length, span(others, "r"))
        # both on clocks of their own: their starts differ by whole samples
        shift = (first_r - first_a) * length / rate
        found, sureness = offset_at(x, y, rate, at - first_a * length / rate, guess - shift, search, window)
        return pa.table([*[pa.array([k], f.type) for k, f in zip(_keys(values), fields, strict=True)], pa.array([at]), pa.array([float(found + shift)]), pa.array([float(sureness)])], names=[*key, "t", "offset", "confidence"])

    return sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInArrow(measure, f"{_types(probes, key)}, t double, offset double, confidence double")


def localised_steps(steps: DataFrame, a: DataFrame, reference: DataFrame, by: list[str], step: str, length: int, rate: float, search: float, window: float, cut: Callable[[DataFrame, str], DataFrame], rounds: int = 4) -> DataFrame:
    """Where the offset changes between two anchors, for all steps (by, step, t0, t1, before, after) at once: by, step, at.

    A round probes the middle of every open step of every track in one join and
    keeps the half in which the offset changes.  The search about the mean of
    both offsets reaches beyond each by `search`.  cut(frame, name) stores a
    round's small table.
    """
    open_steps = steps.select(*by, step, *[F.col(c).cast("double").alias(c) for c in ("t0", "t1", "before", "after")])
    for k in range(rounds):
        middle = (F.col("t0") + F.col("t1")) / 2
        probes = open_steps.select(*by, step, middle.alias("t"), ((F.col("before") + F.col("after")) / 2).alias("expected"))
        found = offsets_at(probes, a, reference, by, step, length, rate, search, window).select(*by, step, "offset")
        early = F.abs(F.col("offset") - F.col("before")) <= F.abs(F.col("offset") - F.col("after"))
        both = open_steps.join(found, [*by, step])
        open_steps = cut(both.select(*by, step, F.when(early, middle).otherwise(F.col("t0")).alias("t0"), F.when(early, F.col("t1")).otherwise(middle).alias("t1"), "before", "after"), f"steps-{k}")
    return open_steps.select(*by, step, ((F.col("t0") + F.col("t1")) / 2).alias("at"))


def conformed(a: DataFrame, knots: DataFrame, by: list[str], length: int, rate: float, most_missing: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(blocks of `a` on the new timeline, tracks that are refused with the seconds that would be missing).

    knots: by, old_t, new_t, gap, a track's few; between them old time runs
    linearly, and from new_t on a gap is silent.  An output block asks for the
    input blocks that its old times reach, and is resampled by itself, linearly;
    beyond the series' ends its first and last samples hold.
    """
    lines = knots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("old_t", "new_t", "gap")]))).alias("knots"), F.sum(F.greatest("gap", F.lit(0.0))).alias("missing"), F.max("new_t").alias("end"))
    refused = lines.where(F.col("missing") > most_missing).select(*by, "missing")
    ends = a.groupBy(*by).agg(F.max(F.col("block") * length + F.size("samples")).alias("n"))
    total = F.round(F.col("end") * rate).cast("long")
    kept = lines.where(F.col("missing") <= most_missing).join(ends, by).withColumn("total", total).where("total > 0")
    out = kept.withColumn("out", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / length).cast("long"))))
    first, last = F.col("out") * length, F.least((F.col("out") + 1) * length, F.col("total")) - 1
    place = lambda i: F.least(F.greatest(_old_time(F.col("knots"), i / rate) * rate, F.lit(0.0)), F.col("n") - 1.0)
    low, high = F.floor(F.greatest(place(first) - 1, F.lit(0.0)) / length), F.floor((place(last) + 2) / length)
    asked = out.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    dealt = asked.join(a, [*by, "block"]).select(*by, "out", "block", "samples", "n", "total", "knots")
    fields = [pa.field(c, _arrow(a, c)) for c in by]

    def resample(key: tuple, table: pa.Table) -> pa.Table:
        *track, block = _keys(key)
        n, total = table.column("n")[0].as_py(), table.column("total")[0].as_py()
        line = table.column("knots")[0].as_py()
        old, new, gap = (np.array([k[c] for k in line]) for c in ("old_t", "new_t", "gap"))
        held = table.column("block").to_pylist()
        start, stop = min(held) * length, min(n, (max(held) + 1) * length)
        values = _joined(table, "samples", length, start, stop - start)
        tau = np.arange(block * length, min(total, (block + 1) * length)) / rate
        part = np.interp(np.interp(tau, new, old) * rate, np.arange(start, stop), values)
        for g0, g in zip(new, gap, strict=True):
            if g > 0:
                part[(tau >= g0) & (tau < g0 + g)] = 0.0
        return pa.table([*[pa.array([k], f.type) for k, f in zip(track, fields, strict=True)], pa.array([block], pa.int64()), pa.array([part.tolist()], pa.list_(pa.float64()))], names=[*by, "block", "samples"])

    return dealt.groupBy(*by, "out").applyInArrow(resample, f"{_types(a, by)}, block long, samples array<double>"), refused


def _old_time(knots: Column, tau: Column) -> Column:
    """Old time at a new one, linear between knots and level beyond them."""
    inner = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(F.get(knots, i - 1).alias("p"), F.get(knots, i).alias("q")))
    spans = F.when(F.size(knots) > 1, inner).otherwise(F.filter(inner, lambda _: F.lit(False)))
    hit = F.get(F.filter(spans, lambda s: (tau >= s["p"]["new_t"]) & (tau <= s["q"]["new_t"])), F.lit(0))
    slope = F.try_divide(hit["q"]["old_t"] - hit["p"]["old_t"], hit["q"]["new_t"] - hit["p"]["new_t"])
    inside = hit["p"]["old_t"] + F.coalesce(slope, F.lit(0.0)) * (tau - hit["p"]["new_t"])
    head, tail = F.get(knots, F.lit(0)), F.get(knots, F.size(knots) - 1)
    return F.when(tau <= head["new_t"], head["old_t"]).when(tau >= tail["new_t"], tail["old_t"]).otherwise(inside)
