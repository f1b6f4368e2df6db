"""Signal alignment: kernels in numpy, one bounded series (a track) at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lag(a: np.ndarray, reference: np.ndarray, rate: float, most: float, least: float | None = None) -> tuple[float, float]:
    """(offset, confidence) by the peak of the cross-correlation of reference and `a` within limits.

    The offset is added to a place in `a` to find it in the reference: positive
    if `a` is early, negative if it is late.  Confidence is the peak over the median of the absolute correlation there.
    """
    a, b = np.asarray(a, dtype=float), np.asarray(reference, dtype=float)
    if not len(a) or not len(b) or not np.ptp(a) or not np.ptp(b):
        return 0.0, 0.0
    a, b = a - a.mean(), b - b.mean()
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    size = 1 << (len(a) + len(b) - 1).bit_length()
    field = np.abs(np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size))
    lags = np.arange(size)
    lags[lags > size // 2] -= size
    low = -most if least is None else least
    inside = (lags >= low * rate) & (lags <= most * rate) & (lags > -len(a)) & (lags < len(b))
    if not inside.any():
        return 0.0, 0.0
    best = np.flatnonzero(inside)[np.argmax(field[inside])]
    return float(lags[best] / rate), float(field[best] / max(np.median(field[inside]), 1e-12))


def offset_at(a: np.ndarray, reference: np.ndarray, rate: float, t: float, expected: float, search: float, window: float) -> tuple[float, float]:
    """(offset, confidence) of the window of `a` at t, looked for in the reference within `search` of the expected offset."""
    at, n = int(round(t * rate)), int(window * rate)
    start = int(round((t + expected - search) * rate))
    cut = reference[max(start, 0) : max(start + n + int(2 * search * rate), 0)]
    before = min(start, 0) / rate  # the part of the search that lies before the reference
    found, sureness = lag(a[at : at + n], cut, rate, 2 * search + before, before)
    return found + max(start, 0) / rate - t, sureness


def broad_offset(a: np.ndarray, reference: np.ndarray, rate: float, limit: float = 10.0) -> tuple[float | None, float]:
    """(offset, confidence) over the whole of both; None for one that is too large to be true."""
    found, sureness = lag(a, reference, rate, len(reference) / rate, -len(a) / rate)
    return (None if abs(found) > limit else found), sureness


def anchors(a: np.ndarray, reference: np.ndarray, rate: float, step: float = 60.0, window: float = 20.0, fine: float = 0.5, wide: float = 6.0, sure: float = 8.0, limit: float = 10.0) -> list[tuple]:
    """(t, offset, confidence, good, how) every `step` seconds; each probe is centred on the last good offset, and tried wide if it fails."""
    out, expected = [], broad_offset(a, reference, rate, limit)[0] or 0.0
    for t in np.arange(0.0, max(len(a) / rate - window, 0.0) + 1e-9, step):
        off, sureness, how = *offset_at(a, reference, rate, t, expected, fine, window), "fine"
        good = sureness >= sure and abs(off - expected) < 0.95 * fine and abs(off) <= limit
        if not good:
            again, more = offset_at(a, reference, rate, t, expected, wide, window)
            if more >= sure and abs(again) <= limit:
                off, sureness, good, how = again, more, True, "wide"
        out.append((float(t), off, sureness, bool(good), how))
        if good:
            expected = off
    return out


def conformed(a: np.ndarray, reference: np.ndarray, rate: float, knots: list[tuple[float, float, float]]) -> np.ndarray:
    """`a` on the timeline of knots (old_t, new_t, gap)."""
    old_t, new_t = np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
    return warped(a, rate, old_t, new_t, [(n, n + g) for _, n, g in knots if g > 0])


def localised(probe: Callable[[float], float], t0: float, t1: float, before: float, after: float, steps: int = 4) -> float:
    """Where between two anchors the offset steps, by bisection."""
    for _ in range(steps):
        middle = (t0 + t1) / 2
        value = probe(middle)
        t0, t1 = (middle, t1) if abs(value - before) <= abs(value - after) else (t0, middle)
    return (t0 + t1) / 2


def warped(samples: np.ndarray, rate: float, old_t: np.ndarray, new_t: np.ndarray, gaps: list[tuple[float, float]], block: int = 1 << 21, most_missing: float = 30.0) -> np.ndarray:
    """Samples on the new timeline by linear interpolation, silent in gaps; refused if too much would be missing."""
    if sum(b - a for a, b in gaps) > most_missing:
        raise ValueError("more is missing than may be filled")
    out = np.empty(int(round(new_t[-1] * rate)))
    for at in range(0, len(out), block):
        tau = np.arange(at, min(at + block, len(out))) / rate
        part = np.interp(np.interp(tau, new_t, old_t) * rate, np.arange(len(samples)), samples)
        for g0, g1 in gaps:
            part[(tau >= g0) & (tau < g1)] = 0.0
        out[at : at + block] = part
    return out


def lags_of_groups(series: DataFrame, by: str, position: str, a: str, reference: str, rate: float, most: float) -> DataFrame:
    """by, lag, confidence for each group's pair of series; a group is one bounded series."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        found = lag(rows[a].to_numpy(), rows[reference].to_numpy(), rate, most)
        return pd.DataFrame({by: [rows[by].iloc[0]], "lag": [found[0]], "confidence": [found[1]]})

    kind = series.schema[by].dataType.simpleString()
    return series.groupBy(by).applyInPandas(one, f"`{by}` {kind}, lag double, confidence double")


def anchors_of_groups(series: DataFrame, by: str, position: str, a: str, reference: str, rate: float, **options) -> DataFrame:
    """One row per anchor of each group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        found = pd.DataFrame(anchors(rows[a].to_numpy(), rows[reference].to_numpy(), rate, **options), columns=["t", "offset", "confidence", "good", "how"])
        found.insert(0, by, rows[by].iloc[0])
        return found

    kind = series.schema[by].dataType.simpleString()
    return series.groupBy(by).applyInPandas(one, f"`{by}` {kind}, t double, offset double, confidence double, good boolean, how string")


def sync_report(anchor_rows: DataFrame, by: list[str]) -> DataFrame:
    """worst, first and last offset of the good anchors, and whether it is worth a repair (40 ms)."""
    good = anchor_rows.where("good")
    out = good.groupBy(*by).agg(F.max(F.abs("offset")).alias("worst"), F.min_by("offset", "t").alias("first"), F.max_by("offset", "t").alias("last"))
    return out.withColumn("repair", F.col("worst") >= 0.040)
