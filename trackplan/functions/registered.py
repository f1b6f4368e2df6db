"""Functions for SQL: cue parsing as a table function, and three Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..operators.align import lag, warped

_TIME = re.compile(r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)")


@udtf(returnType=StructType().add("pos", IntegerType()).add("timing", StringType()).add("start", DoubleType()).add("stop", DoubleType()).add("body", StringType()))
class ParseCues:
    """parse_cues(text): a row for each cue, its lines joined; null times where the timing can't be read."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, block in enumerate(re.split(r"\r?\n[ \t]*\r?\n", text or "")):
            lines = [x for x in re.split(r"\r?\n", block) if x.strip(" ")]
            at = next((k for k in (1, 0) if len(lines) > max(k, 1) - 1 and len(lines) >= 2 and "-->" in lines[k]), None)
            if at is None:
                continue
            found = _TIME.search(lines[at])
            times = (None, None)
            if found:
                h, m, s, f, *end = found.groups()
                times = tuple(int(a) * 3600 + int(b) * 60 + int(c) + int(d[:3].ljust(3, "0")) / 1000 for a, b, c, d in ((h, m, s, f), tuple(end)))
            yield pos, lines[at], *times, "\n".join(lines[at + 1 :])


@pandas_udf(StructType().add("offset", DoubleType()).add("confidence", DoubleType()))
def lag_offset(a: pd.Series, reference: pd.Series, rate: pd.Series, most: pd.Series) -> pd.DataFrame:
    """lag_offset(a, reference, rate, most): offset and confidence of two arrays; null arrays have none."""
    rows = [lag(np.asarray(x), np.asarray(y), r, m) if x is not None and y is not None else (None, None) for x, y, r, m in zip(a, reference, rate, most, strict=True)]
    return pd.DataFrame(rows, columns=["offset", "confidence"], dtype="float64")


@pandas_udf(ArrayType(DoubleType()))
def warp_samples(samples: pd.Series, rate: pd.Series, old_t: pd.Series, new_t: pd.Series) -> pd.Series:
    """warp_samples(samples, rate, old_t, new_t): the samples on the timeline of knots."""
    return pd.Series([warped(np.asarray(s, dtype=float), r, np.asarray(o, dtype=float), np.asarray(n, dtype=float), []) if s is not None else None for s, r, o, n in zip(samples, rate, old_t, new_t, strict=True)])


@pandas_udf(StringType())
def word_wrap(text: pd.Series, width: pd.Series) -> pd.Series:
    """word_wrap(text, width): the words in lines of at most `width` characters, a longer word alone."""

    def one(words: list[str], most: int) -> str:
        lines: list[str] = []
        for w in words:
            if lines and len(lines[-1]) + 1 + len(w) <= most:
                lines[-1] += f" {w}"
            else:
                lines.append(w)
        return "\n".join(lines)

    return pd.Series([None if t is None else one([w for w in t.split(" ") if w], n) for t, n in zip(text, width, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("parse_cues", ParseCues)
    for function in (lag_offset, warp_samples, word_wrap):
        spark.udf.register(function.__name__, function)
