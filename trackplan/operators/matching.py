"""Matching records by range, words, score and hash."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import NO_HASH_DISTANCE, hamming, lookup, runtime_agrees
from ..functions.text import word_key
from .joins import all_pairs, in_intervals

# Number ranges of graphics generations (low, high, name, can encode AV1), and ordered franchise words.
GENERATIONS = [(5000, 5999, "Blackwell (RTX 50 series)", True), (4000, 4999, "Ada Lovelace (RTX 40 series)", True), (3000, 3999, "Ampere (RTX 30 series)", False), (2000, 2999, "Turing (RTX 20 series)", False), (1600, 1699, "Turing (GTX 16 series)", False), (1000, 1099, "Pascal (GTX 10 series)", False)]
PROFESSIONAL = [(r"\brtx\s*a(\d{3,4})\b", "Ampere (professional RTX A series)", False), (r"\b(l4|l40|l40s)\b|ada", "Ada Lovelace (professional)", True), (r"\b(a100|a40|a30|a10|a16|a2)\b", "Ampere (professional)", False), (r"\b(t4|titan\s+rtx|quadro)\b", "Turing or older (professional)", False)]
LEAST_DRIVER = {"13.1": "610.00", "13.0": "570.00", "12.2": "551.76", "12.1": "531.61", "12.0": "522.25"}
NO_ENCODER = ["no capable devices", "not supported", "unsupported", "invalid device", "no nvenc capable"]
EXIT_CODES = {-2: "ENOENT: a file or codec is missing", -13: "EACCES: not allowed", -22: "EINVAL: an argument was refused", -28: "ENOSPC: no space left", -40: "ENOSYS: not possible with this build, driver or encoder", 125: "it never started"}
LARGE_NEGATIVE = ", far below zero: the code of some library, whose message is in the log"
FRANCHISES = [("007", "007"), ("james_bond", "007"), ("jamesbond", "007"), ("bond", "007"), ("mcu", "MCU"), ("marvel", "MCU"), ("starwars", "Star_Wars"), ("star_wars", "Star_Wars"), ("startrek", "Star_Trek"), ("star_trek", "Star_Trek"), ("stargate", "Stargate"), ("star_gate", "Stargate"), ("dcu", "DCU"), ("pixar", "Pixar"), ("ghibli", "Ghibli"), ("lotr", "LOTR"), ("middleearth", "LOTR")]


def ranges_table(spark: SparkSession, ranges: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame(ranges, "low int, high int, label string").coalesce(1)


def in_ranges(rows: DataFrame, ranges: DataFrame, value: Column) -> DataFrame:
    """label of the one of disjoint inclusive ranges that holds the value, else null."""
    return in_intervals(rows, ranges, value, "low", "high", True, 1000.0).drop("low", "high")


def generation(name: Column) -> Column:
    """struct(label, encodes): graphics generation of a board's name; professional boards are told by name before any number is read."""
    low = F.lower(F.coalesce(name, F.lit("")))
    number = F.regexp_extract(low, r"\b(?:rtx|gtx)\s*(\d{4})\b", 1).try_cast("int")
    rules = [(low.rlike(pattern), label, can) for pattern, label, can in PROFESSIONAL] + [(number.between(a, b), label, can) for a, b, label, can in GENERATIONS]
    case = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit(False).alias("encodes")))
    for test, label, can in rules:
        case = case.when(test, F.struct(F.lit(label).alias("label"), F.lit(can).alias("encodes")))
    return F.coalesce(case, F.struct(F.lit("").alias("label"), F.lit(None).cast("boolean").alias("encodes")))


def start_failure(log: Column) -> Column:
    """struct(kind, needs): why an encoder didn't start (version_gap, nocard, unknown), and the driver that a newer interface needs."""
    low = F.lower(F.coalesce(log, F.lit("")))
    needed = F.nullif(F.regexp_extract(low, r"required:\s*([0-9.]+)\s+found:\s*([0-9.]+)", 1), F.lit(""))
    told = F.nullif(F.regexp_extract(low, r"driver for nvenc is\s*([0-9.]+)", 1), F.lit(""))
    gap = needed.isNotNull() | F.contains(low, F.lit("minimum required nvidia driver"))
    absent = F.lit(False)
    for words in NO_ENCODER:
        absent = absent | F.contains(low, F.lit(words))
    kind = F.when(gap, "version_gap").when(absent, "nocard").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(gap, F.coalesce(told, lookup(LEAST_DRIVER, needed, None))).alias("needs"))


def exit_text(code: Column) -> Column:
    """A 32-bit exit code with its signed value and, if known, its meaning."""
    code = code.cast("long")
    signed = F.when(code > 2**31, code - 2**32).otherwise(code)
    known = lookup(EXIT_CODES, signed, None)
    plain = (signed == code) & (code > 0) & (code < 256)
    long = F.concat(code.cast("string"), F.lit(" (signed "), signed.cast("string"), F.lit(", 0x"), F.lpad(F.hex(signed.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.coalesce(F.concat(F.lit(", "), known), F.when(signed < -1000000, F.lit(LARGE_NEGATIVE)), F.lit("")), F.lit(")"))
    return F.when(plain, F.concat(code.cast("string"), F.coalesce(F.concat(F.lit(" ("), known, F.lit(")")), F.lit("")))).otherwise(long)


def franchise(text: Column, words: list[tuple[str, str]] = FRANCHISES) -> Column:
    """Label of the first word of the ordered table that stands in the text as a whole word."""
    key = F.concat(F.lit("_"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    table = F.array(*[F.struct(F.lit(f"_{word}_").alias("w"), F.lit(label).alias("label")) for word, label in words])
    # the key is computed once for all words
    found = F.transform(F.array(key), lambda k: F.get(F.filter(table, lambda t: F.contains(k, t["w"])), F.lit(0))["label"])
    return F.get(found, F.lit(0))


def candidate_score(year: Column, release_year: Column, title: Column, name: Column, popularity: Column, seconds: Column | None = None, minutes: Column | None = None) -> Column:
    """Points for the year, the title, popularity and, if given, the runtime."""
    gap = F.abs(year - release_year)
    score = F.when(gap.isNull(), 0.0).when(gap == 0, 3.0).when(gap == 1, 1.0).otherwise(-3.0 * gap)
    score += F.when(F.lower(title) == F.lower(name), 3.0).otherwise(0.0) + F.least(F.lit(2.0), F.coalesce(popularity, F.lit(0.0)) / 50.0)
    return score if seconds is None else score + F.when(runtime_agrees(seconds, minutes)["ok"], 3.0).otherwise(-2.0)


def best_candidate(pairs: DataFrame, by: list[str], score: str, position: str, columns: list[str], first: int = 8) -> DataFrame:
    """The candidate of each group with the highest score, the earliest of ties; of those at positions below `first`."""
    pairs = pairs.where(F.col(position) < first)
    best = pairs.groupBy(*by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(position)).alias("p"), *columns)).alias("b"))
    return best.select(*by, F.col("b.s").alias(score), *[F.col(f"b.{c}").alias(c) for c in columns])


def conflict_reasons(found: Column, title: Column, name: Column, year: Column, released: Column, seconds: Column, minutes: Column, film: Column) -> Column:
    """Why a match should be looked at: array of reasons.

    released is a date as text; a missing year is one only for a film.
    """
    a, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, name))
    apart = (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)
    theirs, ours = F.left(F.coalesce(released, F.lit("")), F.lit(4)), F.coalesce(year.cast("string"), F.lit(""))
    late = (F.coalesce(minutes, F.lit(0)) > 0) & (F.coalesce(seconds, F.lit(0)) > 0) & ~runtime_agrees(seconds, minutes)["ok"]
    reasons = [(apart, "title differs"), ((theirs != "") & (ours != "") & (theirs != ours), "year differs"), (late, "runtime differs"), ((ours == "") & film, "no year to compare")]
    return F.when(~found, F.array(F.lit("nothing matched"))).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in reasons])))


def nearest(rows: DataFrame, references: DataFrame, by: list[str], order: list[str], hashes: list[str], reference_hash: str, reference_id: str) -> DataFrame:
    """distance, reference, frame order and variant of the closest reference of each group.

    rows: by, order columns and hash variants, tried in order.  Every row meets
    each reference; where these are few, pairs are reduced before they are
    shuffled.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(h).alias("h")) for k, h in enumerate(hashes)]))
    pairs = all_pairs(rows.select(*by, *order, variants.alias("v")), references.select(F.col(reference_hash).alias("_h"), F.col(reference_id).alias("reference")))
    key = F.struct(F.least(hamming(F.col("v.h"), F.col("_h")), F.lit(NO_HASH_DISTANCE)).alias("distance"), *order, "reference", F.col("v.variant").alias("variant"))
    return pairs.groupBy(*by).agg(F.min(key).alias("m")).select(*by, "m.distance", *[f"m.{c}" for c in order], "m.reference", "m.variant")


#: Bands that a 64-bit hash is cut into, and flipped bits in each that are looked for: hashes up to 4 * 1 + 3 bits apart meet by them.
BANDS, BAND_BITS, MOST_FLIPS = 4, 16, 1
#: Hashes of a block; pairs of blocks' hashes that take the time of one joined pair.
BLOCK, JOINED = 1 << 14, 100
#: Bits of a place (block, position) below a distance, and of the position.
PLACE, POSITION = 48, 24


def masks_of(flips: int) -> list[int]:
    """All masks of a band with this many bits set."""
    return [sum(1 << b for b in bits) for bits in combinations(range(BAND_BITS), flips)]


def nearest_indexed(rows: DataFrame, references: DataFrame, by: list[str], order: list[str], hashes: list[str], reference_hash: str, reference_id: str, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`nearest` by multi-index hashing: the same rows, without pairs of rows and references that are far apart.

    Two hashes at most 4 k + 3 bits apart agree in one of four bands up to k
    bits.  Round k looks for references whose band is up to k flips away; a
    group whose closest candidate is within 4 k + 3 bits is settled, ties
    included, and only the others go on.  What is open after one flip meets all
    references in blocks of hashes: each further flip would join a tenth or
    more of these pairs as rows, at a hundred times the cost of one in a block.
    A round whose bands are so uneven that it would cost more than the blocks
    is left to them.  Rows and references of equal hashes are one each; groups
    without a hash are at NO_HASH_DISTANCE of all.  cut(frame, name) stores
    what a round leaves.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(h).alias("h")) for k, h in enumerate(hashes)]))
    first = F.min(F.struct(*order, F.col("v.variant").alias("variant"))).alias("o")
    open_rows = cut(rows.select(*by, *order, variants.alias("v")).groupBy(*by, F.col("v.h").alias("h")).agg(first), "variants")
    named = references.select(F.col(reference_hash).alias("rh"), F.struct(F.col(reference_id).alias("reference")).alias("r"))
    known = cut(named.where("rh is not null").groupBy("rh").agg(F.min("r").alias("r")), "references")
    n_known = known.count()
    # places rise with the reference, so the least place is the least reference; its hash parts equal ones
    dealt = known.repartitionByRange(max(1, -(-n_known // BLOCK)), "r", "rh").withColumn("cell", F.spark_partition_id())
    blocks = cut(dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("r", "rh"))).alias("all")), "blocks")
    placed = blocks.select("cell", F.posexplode("all").alias("position", "x")).select(F.shiftleft(F.col("cell").cast("long"), POSITION).bitwiseOR(F.col("position").cast("long")).alias("place"), "x.rh", "x.r.reference")
    out = None
    for k in range(MOST_FLIPS + 2):
        asked = cut(open_rows.where("h is not null").select("h").distinct(), "asked")
        n_asked = asked.count()
        if not n_asked or not n_known:
            break
        last = k > MOST_FLIPS
        found = _met(asked, blocks, n_asked, n_known) if last else _in_bands(asked, placed, k, n_asked * n_known)
        if found is None:
            continue
        judged = open_rows.join(found, "h", "left")
        closest = judged.groupBy(*by).agg(F.shiftright(F.min("key"), PLACE).cast("int").alias("distance"))
        judged = cut(_of_groups(judged, closest, by), f"judged-{k}")
        settled = F.coalesce(F.col("distance") < (NO_HASH_DISTANCE if last else BANDS * (k + 1)), F.lit(False))
        done = judged.where(settled & (F.shiftright("key", PLACE) == F.col("distance"))).withColumn("place", F.col("key").bitwiseAND(F.lit((1 << PLACE) - 1))).join(placed.select("place", "reference").hint("merge"), "place")
        done = done.select(*by, "distance", "o", "reference")
        out = done if out is None else out.unionByName(done)
        open_rows = judged.where(~settled).select(*by, "h", "o")
    # all that is left has all references at the same distance
    least = references.agg(F.min(F.struct(F.col(reference_id).alias("reference"))).alias("r")).where("r is not null")
    rest = open_rows.crossJoin(F.broadcast(least)).select(*by, F.lit(NO_HASH_DISTANCE).alias("distance"), "o", "r.reference")
    out = rest if out is None else out.unionByName(rest)
    key = F.struct("distance", *[F.col(f"o.{c}").alias(c) for c in order], "reference", "o.variant")
    return out.groupBy(*by).agg(F.min(key).alias("m")).select(*by, "m.distance", *[f"m.{c}" for c in order], "m.reference", "m.variant")


def _of_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is known of their group; null is a group too."""
    named = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(named, same, "left").drop(*[f"_{c}" for c in by])


def _in_bands(asked: DataFrame, placed: DataFrame, flips: int, pairs: int) -> DataFrame | None:
    """h, key: distance and place of the closest reference with a band up to so many flips away, where there is one; None if blocks are cheaper."""
    bands = lambda h: F.posexplode(F.array(*[F.shiftrightunsigned(h, BAND_BITS * b).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int") for b in range(BANDS)]))
    masks = F.explode(F.array(*[F.lit(m) for f in range(flips + 1) for m in masks_of(f)]))
    flipped = lambda frame: frame.withColumn("flip", masks).withColumn("value", F.col("own").bitwiseXOR(F.col("flip")))
    own = asked.select("h", bands(F.col("h")).alias("band", "own"))
    index = placed.select("rh", "place", bands(F.col("rh")).alias("band", "value"))
    # sizes are guessed before rows are multiplied by flips and bands, so what looks small must not be broadcast
    counts = flipped(own.groupBy("band", "own").agg(F.count("*").alias("m"))).join(index.groupBy("band", "value").agg(F.count("*").alias("n")).hint("merge"), ["band", "value"])
    if (counts.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0) * JOINED > pairs:
        return None
    key = F.shiftleft(F.bit_count(F.col("h").bitwiseXOR(F.col("rh"))).cast("long"), PLACE).bitwiseOR(F.col("place"))
    return flipped(own).join(index.hint("merge"), ["band", "value"]).groupBy("h").agg(F.min(key).alias("key"))


def _met(asked: DataFrame, blocks: DataFrame, n_asked: int, n_known: int) -> DataFrame:
    """h, key: distance and place of the closest of all references, compared in pairs of blocks, each an array of hashes."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = blocks.agg(F.max("cell")).first()[0] + 1
    # enough pairs of blocks for all tasks, unless these would be tiny
    sides = max(-(-n_asked // BLOCK), min(-(-n_asked // 256), -(-parts // cells)))
    packed = asked.groupBy(F.pmod(F.xxhash64("h"), F.lit(sides)).cast("int").alias("at")).agg(F.collect_list("h").alias("hashes"))
    left = packed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(parts, "at", "cell")
    right = blocks.select("cell", F.col("all.rh").alias("hashes")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).repartition(parts, "at", "cell")

    def closest(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["h", "key"])
        h, known = (x.column("hashes").combine_chunks().flatten().to_numpy().view(np.uint64) for x in (own, others))
        key = np.empty(len(h), dtype=np.int64)
        for a in range(0, len(h), 32):
            apart = np.bitwise_count(h[a : a + 32, None] ^ known)
            at = apart.argmin(axis=1)  # the first of equally close ones
            key[a : a + 32] = apart[np.arange(len(at)), at].astype(np.int64) << PLACE | at
        return pa.table([pa.array(h.view(np.int64)), pa.array(key | others.column("cell")[0].as_py() << POSITION)], names=["h", "key"])

    return left.groupBy("at", "cell").cogroup(right.groupBy("at", "cell")).applyInArrow(closest, "h long, key long").groupBy("h").agg(F.min("key").alias("key"))
