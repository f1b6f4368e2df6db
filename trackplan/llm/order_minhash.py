"""Document fingerprints by Order MinHash (DataFrame functions only).

A text of any length is read as tokens (runs of up to 16 non-space characters;
each character of a longer run, and each ideograph or kana, is a token of its
own, so that an edit moves no borders of tokens but its own), its k-mers are runs
of `KMER` tokens, and all of them are numbered by occurrence: a repeated k-mer
is another one each time.  Each of `SKETCHES` orders, a hash of its own, selects
two minimal numbered k-mers; they are put in their text order and hashed as a
tuple.  The share of equal tuples falls both with lost k-mers and with k-mers
that changed their order, as edit similarity does.

The two are the minima of two halves, into which the order's own hash deals all
numbered k-mers.  By symmetry they are any two of them with equal chance, as the
two smallest of one order would be, and texts choose alike: so tuples are equal
with the same chance.  Minima are what Spark's aggregation keeps in fixed space,
so that every k-mer of the longest text takes part in every order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Scratch

KMER, SKETCHES = 3, 32
#: Orders whose minima one pass of an aggregation keeps: with more, its compiled code is too long for the JVM to speed up.
TOGETHER = 8
_LETTER = r"[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
TOKEN = rf"[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]|(?<!{_LETTER}){_LETTER}{{1,16}}(?!{_LETTER})|{_LETTER}"
#: A numbered k-mer is hash << 25 | position << 1 | side (0: the text, 1: the edited text); positions beyond 2**24 count as that.
POSITION_BITS = 25
_MOST = (1 << (POSITION_BITS - 1)) - 1
_LOW = (1 << POSITION_BITS) - 1
_NO_ID = -(1 << 63)
#: Repeated rows that are given back from one array.
PART_ROWS = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _packed(hashed: Column, low: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(low)


def _hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, POSITION_BITS)


def _kmers(h: Column, side: int) -> Column:
    """hash << 25 | position << 1 | side of each k-mer of token hashes h; fewer than KMER tokens are one k-mer."""
    starts = F.slice(h, F.lit(1), F.greatest(F.least(F.size(h), F.lit(1)), F.size(h) - (KMER - 1)))
    low = lambda i: F.least(i, F.lit(_MOST)).cast("long") * 2 + side
    return F.transform(starts, lambda x, i: _packed(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, KMER)]), low(i)))


def numbered(text: Column, side: int = 0) -> Column:
    """hash(k-mer, occurrence) << 25 | position << 1 | side of all k-mers of a text."""

    def with_runs(k: Column) -> Column:
        first = F.transform(k, lambda x, i: F.when((i == 0) | (_hash_of(F.get(k, i - 1)) != _hash_of(x)), i))
        return _let(F.filter(first, lambda x: x.isNotNull()), lambda runs: F.flatten(F.transform(runs, lambda start, r: F.transform(F.slice(k, start + 1, F.coalesce(F.get(runs, r + 1), F.size(k)) - start), lambda x, seen: _packed(F.xxhash64(_hash_of(x), seen), x.bitwiseAND(F.lit(_LOW)))))))

    def counted(kmers: Column) -> Column:
        # without repeats every k-mer is the first of its kind, and nothing need be sorted to number them
        once = F.transform(kmers, lambda x: _packed(F.xxhash64(_hash_of(x), F.lit(0)), x.bitwiseAND(F.lit(_LOW))))
        repeats = F.size(F.array_distinct(F.transform(kmers, _hash_of))) < F.size(kmers)
        return F.when(repeats, _let(F.sort_array(kmers), with_runs)).otherwise(once)

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: _let(_kmers(h, side), counted))


def _tuple(a: Column, b: Column) -> Column:
    """32 bits of two selected k-mers in their text order; zero if there is none."""
    position = lambda x: x.bitwiseAND(F.lit(_LOW))
    swapped = F.coalesce(position(a) > position(b), F.lit(False))
    first, second = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    hashed = F.shiftright(F.xxhash64(_hash_of(first), _hash_of(second)), 32).cast("int")
    return F.when(a.isNull() & b.isNull(), 0).otherwise(hashed)


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, sketch (array<int> of SKETCHES tuple hashes) of rows (by, x: a numbered k-mer, or null if there is none).

    The rows of a group are reduced to minima as they come, before any shuffle.
    """
    bunches = SKETCHES // TOGETHER
    # every row goes through all orders, a bunch of them at a time
    rows = rows.withColumn("bunch", F.explode(F.array(*map(F.lit, range(bunches)))))
    rows = rows.select("*", *[F.xxhash64(_hash_of(F.col("x")), F.col("bunch") * TOGETHER + j).alias(f"h{j}") for j in range(TOGETHER)])
    # the order is the upper bits of its hash; its lowest bit deals k-mers into halves
    value = [_packed(F.col(f"h{j}"), F.col("x").bitwiseAND(F.lit(_LOW))) for j in range(TOGETHER)]
    half = [F.col(f"h{j}").bitwiseAND(F.lit(1)) for j in range(TOGETHER)]
    least = rows.groupBy(*by, "bunch").agg(*[F.min(F.when(half[j] == k, value[j])).alias(f"m{j}_{k}") for j in range(TOGETHER) for k in (0, 1)])
    tuples = F.array(*[_tuple(F.col(f"m{j}_0"), F.col(f"m{j}_1")) for j in range(TOGETHER)])
    out = least.select(*by, "bunch", tuples.alias("t")).groupBy(*by).agg(*[F.max(F.when(F.col("bunch") == k, F.col("t"))).alias(f"t{k}") for k in range(bunches)])
    return out.select(*by, F.concat(*[f"t{k}" for k in range(bunches)]).alias("sketch"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two sketches, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SKETCHES))


def as_text(a: Column) -> Column:
    """A sketch as hex digits, eight for each tuple."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def successors(scratch: Scratch, ids: DataFrame) -> DataFrame:
    """id, next_id: the next larger id, and for the largest the smallest; `ids` has distinct non-null ids.

    Ids are dealt by ranges, each range is sorted in a task of its own, and only
    the least id of each range is carried to the one before.
    """
    ranges = scratch.store(ids.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("p")), "ranges")
    inside = ranges.select("p", "id", F.lead("id").over(W.partitionBy("p").orderBy("id")).alias("next"))
    # one row for each partition, not for each id
    heads = ranges.groupBy("p").agg(F.min("id").alias("head"))
    heads = heads.select(F.col("p").alias("q"), F.lead("head").over(W.orderBy("head")).alias("after"), F.min("head").over(W.partitionBy()).alias("least"))
    return inside.join(F.broadcast(heads), F.col("p") == F.col("q")).select("id", F.coalesce("next", "after", "least").alias("next_id"))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprint every text of `docs` (doc_id, text) and its edited text.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many, or all, of the next document's (ascending doc_id; after the
    last comes the first).  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (shares of equal tuples).
    Null counts as the empty text; texts without tokens share one fingerprint.
    A null doc_id counts as an id before all others.  Rows that repeat a doc_id
    have the same next document; as a next document the least text stands for
    them.  Equal texts have equal fingerprints.  An empty table gives an empty
    result.
    """
    with Scratch(spark, "order-minhash") as scratch:
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        lengths = scratch.store(texts.select("id", F.char_length("text").alias("n")).groupBy("id").agg(F.max("n").alias("most")), "lengths")
        after = scratch.store(successors(scratch, lengths.select("id")).join(lengths, "id").select(F.col("id").alias("of"), "next_id", F.expr("most div 4").cast("int").alias("most")), "successors", keep=True)
        # texts are shuffled by id once: both joins read that exchange
        heads = texts.join(after, F.col("id") == F.col("next_id")).select("of", F.expr("left(text, most)").alias("head"))
        heads = heads.groupBy("of").agg(F.min("head").alias("head"))
        both = texts.join(heads, F.col("id") == F.col("of"))
        edited = F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 4 as int))"), F.expr("left(head, cast(char_length(text) div 4 as int))"))
        sha = F.unhex(F.sha2(F.col("edited").cast("binary"), 256))
        # rows of the same id and texts are sketched as one, under a key of two numbers that each k-mer carries
        both = both.select("id", F.xxhash64("text", edited).alias("key"), F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
        kmers = F.array(F.struct(F.lit(0).alias("side"), numbered(F.col("text"), 0).alias("x")), F.struct(F.lit(1).alias("side"), numbered(F.col("edited"), 1).alias("x")))
        rows = both.select("id", "key", F.inline(kmers)).select("id", "key", "side", F.explode_outer("x").alias("x"))
        found = sketches(rows, ["id", "key", "side"])
        found = found.groupBy("id", "key").agg(*[F.max(F.when(F.col("side") == k, F.col("sketch"))).alias(c) for k, c in enumerate("ab")])
        texts_of = both.groupBy("id", "key").agg(F.first("n_chars").alias("n_chars"), F.first(sha).alias("sha"), F.count("*").alias("rows"))
        done = found.join(texts_of, ["id", "key"])
        # given back as often as they were, in parts that fit in an array
        done = done.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {PART_ROWS}"))))
        done = done.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.col("rows") - F.col("part") * PART_ROWS, F.lit(PART_ROWS)).cast("int")))).drop("rows", "part", "copy", "key")
        done = scratch.store(done, "sketches", keep=True)
    nexts = done.groupBy("id").agg(F.min("a").alias("next_a")).join(after, F.col("id") == F.col("next_id")).select("of", "next_a")
    out = done.join(nexts, F.col("id") == F.col("of"))
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_a")).alias("near_next"))
