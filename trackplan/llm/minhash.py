"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles and a MinHash signature; texts
   with equal sets collapse to one representative.
2. Representatives are posted under coordinate-value pairs of the first `POST`
   coordinates.  A pair above the similarity matches in at least M of them
   (`least_matches`: it fails to with a chance of about 1e-6 at the limit
   itself), so only the POST - M + 1 rarest values of a document need be posted
   (prefix); long lists are thereby skipped, and a document with fewer than M
   values that anyone shares is posted nowhere.
3. Documents that meet in a list have their collisions counted over the whole
   signature; enough of them among `SIZE` (and sizes that allow the
   similarity) make them candidates, and candidates form clusters.
4. Clusters get the full shingle sets, and links are confirmed on those.

Lists and clusters longer than a cap are split into chunks that share a few
hub documents; pairs in different components after that are then compared
block by block, so no group has to fit in a task and no link is lost.  Pairs
that are already in one component are not compared, and none are emitted:
a task returns one edge for each document at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import stars
from .groups import bounds, grouped
from .kept import kept_rows, marked
from .shingles import set_key, shingle_sets, signatures
from .storage import Scratch, small_batches

SIZE, POST = 64, 32
#: The chance that a link exactly at the similarity asked for is not found by each of the two counts.
MISSED = 2e-6
SHINGLE_WORDS = 5
#: Documents, and shingles, of a group that one task compares at once.
CAP_DOCS, CAP_SHINGLES = 1000, 1_000_000
HUBS = 16
#: Parts that the members of a group of more than one chunk are dealt into where they meet a row of the group.
SALTS = 64
#: Links of a document that are confirmed one by one before those left are confirmed together.
FEW = 8
_SIGNED = "doc_id long, n_shingles long, set_key binary, signature array<int>"
_EDGES = "u long, v long"


def least_matches(percent: int, of: int) -> int:
    """Collisions that a pair of `percent` similarity reaches among `of` coordinates but for a chance of MISSED."""
    p, below = percent / 100, 0.0
    for m in range(of):
        below += comb(of, m) * p**m * (1 - p) ** (of - m)
        if below >= MISSED:
            return m
    return of


def sign(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for sets in shingle_sets(batch.column(1).to_pylist(), width):
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full, SIZE).view(np.int32).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )
                at += len(sets)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _SIGNED)


def postings(scratch: Scratch, signed: DataFrame, post_match: int) -> DataFrame:
    """g, doc, size: the documents under the rarest shared coordinate-value pairs of each, with the length of the list."""
    keys = signed.select("doc", F.posexplode(F.slice("signature", 1, POST)).alias("at", "value"))
    keys = keys.select("doc", F.expr("shiftleft(cast(at as bigint), 32) | (cast(value as bigint) & 4294967295)").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = keys.join(often, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    posted = shared.where(F.size("keys") >= post_match).select("doc", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (post_match - 1))).alias("k"))
    posted = scratch.store(posted.select("doc", F.col("k.key").alias("key")), "postings")
    # lists of the same documents are merged once
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("a"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("b")).where("n > 1")
    lists = lists.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key", "n")
    return posted.join(lists, "key").select(F.col("key").alias("g"), "doc", F.col("n").alias("size"))


def _close(sig: np.ndarray, n: np.ndarray, i: int, js: np.ndarray, percent: int, match: int, post_match: int) -> np.ndarray:
    """Those of js whose signature collides often enough with row i's, most collisions first."""
    same = sig[js] == sig[i]
    count = np.count_nonzero(same, axis=1)
    ok = (count >= match) & (np.count_nonzero(same[:, :POST], axis=1) >= post_match)
    ok &= 100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])
    js, count = js[ok], count[ok]
    return js[np.argsort(-count, kind="stable")]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets, given as arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


class _Commons:
    """Sizes of the intersections of one set of a group with many of them, by numbering the group's shingles."""

    def __init__(self, sets: list[np.ndarray]):
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.starts = np.cumsum([0] + [len(s) for s in sets])
        self.mark = np.zeros(len(values), dtype=bool)

    def of(self, i: int) -> np.ndarray:
        own = self.flat[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[self.flat], self.starts[:-1], dtype=np.int64)
        self.mark[own] = False
        return out


def _link(docs: np.ndarray, sig: np.ndarray, n: np.ndarray, percent: int, sets: list[np.ndarray] | None, side: np.ndarray | None, label: np.ndarray | None) -> set[tuple[int, int]]:
    """Edges (document, smallest document of its component) found in a group.

    sets: full sets to confirm links on.  side: 0 rows are compared with the 1
    rows of another label; without it all rows are compared.  Rows of a label
    are in one component beforehand: edges are then between labels.
    """
    names = docs if label is None else label
    _, at = np.unique(names, return_inverse=True)
    match, post_match = least_matches(percent, SIZE), least_matches(percent, POST)
    everyone = np.arange(len(docs))
    inner = None if side is None else np.flatnonzero(side == 1)
    commons = None
    for i in everyone.tolist() if side is None else np.flatnonzero(side == 0).tolist():
        js = everyone[i + 1 :] if inner is None else inner
        js = js[at[js] != at[i]]
        if not len(js):
            continue
        js = _close(sig, n, i, js, percent, match, post_match)
        if sets is not None:  # what a link brings into the component needs no confirmation
            for _ in range(min(FEW, len(js))):
                if not len(js):
                    break
                j = js[0]
                both = _common(sets[i], sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    at[at == at[j]] = at[i]
                    js = js[at[js] != at[i]]
                else:
                    js = js[1:]
            if len(js):
                commons = commons or _Commons(sets)
                both = commons.of(i)[js]
                js = js[100 * both >= percent * (n[i] + n[js] - both)]
        if len(js):
            at[np.isin(at, at[js])] = at[i]
    least = np.full(len(docs), np.iinfo(np.int64).max)
    np.minimum.at(least, at, names)
    moved = least[at] != names
    return set(zip(names[moved].tolist(), least[at[moved]].tolist(), strict=True))


def _edges_in_groups(percent: int, width: int, by_text: bool) -> Callable:
    """For mapInArrow over rows (g, chunk, doc, side, label, payload: signature with n, or text), sorted by g and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["g", "chunk"]):
            edges: set[tuple[int, int]] = set()
            for a, b in bounds(batch, ["g", "chunk"]):
                if b - a < 2:
                    continue
                part = batch.slice(a, b - a)
                docs, side, label = (part.column(c).to_numpy() for c in ("doc", "side", "label"))
                sets = None
                if by_text:
                    arrays = [s for some in shingle_sets(part.column("payload").to_pylist(), width) for s in some]
                    full = np.array([len(s) > 0 for s in arrays])
                    if not full.all():  # texts without words link with nothing
                        docs, side, label, arrays = docs[full], side[full], label[full], [s for s in arrays if len(s)]
                    sig, n, sets = signatures(arrays, SIZE), np.array([len(s) for s in arrays]), arrays
                else:
                    sig = part.column("payload").flatten().to_numpy().reshape(b - a, SIZE)
                    n = part.column("n").to_numpy()
                cross = len(side) and side[0] >= 0
                edges |= _link(docs, sig, n, percent, sets, side if cross else None, label if cross else None)
            ends = np.array(sorted(edges), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return run


def _linked(scratch: Scratch, members: DataFrame, payload: DataFrame, percent: int, width: int, by_text: bool, cap_docs: int, cap_shingles: int) -> DataFrame:
    """node, component of the documents linked within groups, for all but the smallest document of each component.

    members: a stored table of g, doc, and either weight (shingles that a task has
    to hold for the document) or size (documents of the group, of no weight).
    payload: doc, payload (signature, with n, or text).
    With signatures a document may be in many groups, with texts it is in one:
    edges in groups of one chunk are then stars already.
    """
    kernel = _edges_in_groups(percent, width, by_text)

    def compare(placed: DataFrame) -> DataFrame:
        rows = placed.join(payload, "doc").repartition("g", "chunk").sortWithinPartitions("g", "chunk", "doc")
        return scratch.store(rows.mapInArrow(kernel, _EDGES), "links")

    def salted(table: DataFrame) -> DataFrame:
        """Each row (of a large group) once for every salt of its members, so that no task meets a whole group."""
        return table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def chunks_of(size: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(size / cap_docs), F.ceil(weight / cap_shingles)).cast("long")

    none = F.lit(-1)
    members = members.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(SALTS)))
    if "size" in members.columns:
        placed = members.withColumn("weight", F.lit(0).cast("long")).withColumn("chunks", chunks_of(F.col("size"), F.col("weight")))
        large = placed.where("chunks > 1")
    else:
        sizes = members.groupBy("g").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"))
        large = sizes.withColumn("chunks", chunks_of(F.col("size"), F.col("weight"))).where("chunks > 1").select("g", "size", "chunks")
        large = scratch.store_narrow(large, "large-groups")
        placed = members.join(salted(large), ["g", "salt"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    if large.isEmpty():
        edges = compare(members.select("g", F.lit(0).cast("long").alias("chunk"), "doc", none.alias("side"), none.cast("long").alias("label")))
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) if by_text else stars(scratch, edges)
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("doc", F.lit(5)), F.col("size")) < HUBS)
    own = F.pmod(F.xxhash64("doc", F.lit(6)), F.col("chunks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    edges = compare(placed.select("g", F.explode(F.when(hub, every).otherwise(F.array(own))).alias("chunk"), "doc", none.alias("side"), none.cast("long").alias("label")))

    # what the chunks left apart: documents outside their group's largest component against all others
    found = stars(scratch, edges)
    rest = placed.where("chunks > 1").join(found, F.col("doc") == F.col("node"), "left")
    rest = scratch.store(rest.select("g", "salt", "doc", "weight", "chunks", F.coalesce("component", "doc").alias("label")), "labelled")
    labels = rest.groupBy("g", "label").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"))
    main = labels.groupBy("g").agg(F.max(F.struct("size", "label", "weight")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).where("size > main.size")
    main = main.select("g", F.col("main.label").alias("main"), chunks_of(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight")).alias("blocks"))
    main = scratch.store_narrow(main, "outside")
    if main.isEmpty():
        return found
    rest = rest.join(salted(main), ["g", "salt"])
    outer = rest.where("label <> main").withColumn("o", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks"))).withColumn("i", F.explode(every))
    inner = rest.withColumn("i", F.pmod(F.xxhash64("doc", F.lit(6)), F.col("chunks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    chunk = (F.col("o") * F.col("chunks") + F.col("i")).alias("chunk")
    both = outer.select("g", chunk, "doc", F.lit(0).alias("side"), "label").union(inner.select("g", chunk, "doc", F.lit(1).alias("side"), "label"))
    across = compare(both)
    if across.isEmpty():
        return found
    # edges between components: their members follow
    merged = stars(scratch, across)
    moved = found.join(merged.select(F.col("node").alias("_from"), F.col("component").alias("_to")), F.col("component") == F.col("_from"), "left")
    return moved.select("node", F.coalesce("_to", "component").alias("component")).union(merged)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, width: int = SHINGLE_WORDS, cap_docs: int = CAP_DOCS, cap_shingles: int = CAP_SHINGLES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    distinct `width`-word shingles; component_id is the smallest doc_id reachable
    over links, and kept says that it is the row's own.  Null and empty texts and
    texts of white space have no shingles, are linked with nothing and kept.
    Repeated rows give repeated rows; rows with a null doc_id join the component
    of their set, or have a null component_id and are kept.  Other columns of
    `docs` are not read.  An empty table gives an empty result.
    `percent` is at least 70: below, too many rare values would have to be posted.
    """
    if not 70 <= percent <= 100:
        raise ValueError("similarities from 70 to 100 percent are supported")
    with Scratch(spark, "minhash") as scratch:
        return _near(scratch, docs, percent, width, cap_docs, cap_shingles)


def _near(scratch: Scratch, docs: DataFrame, percent: int, width: int = SHINGLE_WORDS, cap_docs: int = CAP_DOCS, cap_shingles: int = CAP_SHINGLES) -> DataFrame:
    spark = scratch.spark
    small_batches(spark)
    signed_path = scratch.path("signed", keep=True)
    sign(docs, width).write.parquet(signed_path)
    signed = spark.read.parquet(signed_path)
    one = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
    one = one.agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    one = scratch.store(one, "representatives")

    lists = scratch.store(postings(scratch, one, least_matches(percent, POST)), "lists")
    clusters = _linked(scratch, lists, one.select("doc", F.col("signature").alias("payload"), "n"), percent, width, False, cap_docs, cap_shingles)
    # every document in a cluster; the few others that may be taken for a centre are clusters of one
    members = marked(one.select("doc", F.col("n").alias("weight")).join(clusters, F.col("doc") == F.col("node"), "left"), "doc", clusters.select(F.col("component").alias("id")))
    members = members.where("node is not null or _likely").withColumn("g", F.coalesce("component", "doc"))
    members = scratch.store(members.select("g", "doc", "weight"), "clusters")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("payload"))
    found = _linked(scratch, members, marked(texts, "doc", members.select(F.col("doc").alias("id"))).where("_likely").drop("_likely"), percent, width, True, cap_docs, cap_shingles)
    by_set = one.select("set_key", "doc").join(found, F.col("doc") == F.col("node"), "left").select("set_key", F.coalesce("component", "doc").alias("component"))
    by_set = scratch.store(by_set, "components", keep=True)
    out = spark.read.parquet(signed_path).select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component of near duplicates of `docs`, with all its columns: that of the smallest doc_id.

    Rows with null doc_ids come after all others; of rows that repeat doc_id
    and text any one stays, and neither null nor repeated doc_ids keep or drop
    other rows.  Null, empty and blank texts have no shingles and are linked
    with nothing.  Other columns may have any names; an empty table stays empty.
    """
    key = lambda text: F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))
    with Scratch(spark, "near-rows") as scratch, Scratch(spark, "near", brief=True) as brief:
        # rows are compared under numbers of their own
        rows = brief.store(docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long"), F.col("text").cast("string"), key(F.col("text")).alias("key")), "rows")
        found = _near(brief, rows.select(F.col("id").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("id"), "component_id")
        found = brief.store(found.join(rows.select("id", "doc_id", "key"), "id"), "found")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first")
        stays = found.groupBy("component_id").agg(first).select(F.col("first.id").alias("_id"))
        decisions = found.join(stays, F.col("id") == F.col("_id"), "left").select("doc_id", "key", F.col("_id").isNotNull().alias("stays"))
        return kept_rows(scratch, docs, key, decisions)
