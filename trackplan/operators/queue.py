"""Queues and their state: listing filters, order, names, the append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import lookup

# Extensions that are scanned, and the order of containers of equal size (others 50).
EXTENSIONS = ["mkv", "mp4", "m4v", "avi", "mov", "wmv", "mpg", "mpeg", "m2ts", "ts", "vob", "flv", "webm", "divx", "mts", "3gp", "ogm", "rm", "rmvb", "asf"]
CONTAINER_RANK = {"m2ts": 0, "mts": 1, "ts": 2, "vob": 3, "rm": 4, "rmvb": 4, "asf": 5, "wmv": 6, "avi": 7, "divx": 8, "mpg": 9, "mpeg": 9, "flv": 10, "ogm": 11, "3gp": 12, "mp4": 13, "m4v": 14, "mov": 15, "webm": 16, "mkv": 17}
LEAST_BYTES = 5 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scannable(items: DataFrame, path: str = "path", size: str = "size", least: int = LEAST_BYTES) -> DataFrame:
    """Rows of an allowed extension and size, without hidden resource files."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return items.where(extension(F.col(path)).isin(*EXTENSIONS) & ~name.startswith("._") & (F.col(size) >= least))


def ordered(items: DataFrame, size: Column, rank: Column, created: Column, tie: Column, limit: int = 0) -> DataFrame:
    """Largest first, then by rank, age and the tie-break; a limit makes it a top-k."""
    out = items.orderBy(size.desc(), rank.asc(), created.asc(), tie.asc())
    return out.limit(limit) if limit else out


def container_rank(path: Column) -> Column:
    return lookup(CONTAINER_RANK, extension(path), 50)


def with_clashes(items: DataFrame, target: Column) -> DataFrame:
    """clash_size: rows that share the case-folded target; they keep their own extension."""
    counts = items.groupBy(F.lower(target).alias("_t")).agg(F.count("*").alias("clash_size"))
    return items.join(counts, F.lower(target) == F.col("_t"), "left").drop("_t").withColumn("clash_size", F.coalesce("clash_size", F.lit(1)))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log; combines before it shuffles."""
    rest = [c for c in log.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    best = log.groupBy(*keys).agg(F.max(row).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def disposition(status: Column, exists: Column, force: bool = False, analyze_only: bool = False) -> Column:
    """What to do with an item of this last status."""
    return F.when((status == "done") & exists & F.lit(not force), "skip_done").when(status == "skipped_av1", "skip_codec").when(status == "failed", "skip_failed").when((status == "analyzed") & F.lit(analyze_only), "skip_analyzed").otherwise("process")


def remaining(queue: DataFrame, log: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """Rows of the queue whose last state isn't done."""
    return queue.join(latest(log, [key], order).where(done).select(key), key, "left_anti")


def without_failed(log: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """The log's keys whose last status isn't `failed`, to be tried again otherwise."""
    last = latest(log, [key], order)
    return last.where(F.col(status) != "failed")


def tally(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def numbered_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def with_precedence(*maps: Column) -> Column:
    """Settings from several maps; earlier ones win."""
    keys = F.array_distinct(F.concat(*[F.map_keys(m) for m in maps]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(*[m[k] for m in maps])))


def with_records(outputs: DataFrame, log: DataFrame, path: Column, out: Column, source: str, rest: list[str]) -> DataFrame:
    """Outputs with the source and record of the log's row of the same output, case-folded; without one the output is its own source."""
    known = log.select(F.lower(out).alias("_out"), F.col(source).alias("_source"), *rest)
    both = outputs.withColumn("_path", path).join(known, F.lower(F.col("_path")) == F.col("_out"), "left")
    return both.withColumn("source", F.coalesce("_source", "_path")).drop("_path", "_out", "_source")


def with_cached(items: DataFrame, cache: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Items with the cached value of each name, or the one worked out where the cache has none."""
    kept = cache.select(key, *[F.col(n).alias(f"_{n}") for n in values])
    both = items.join(kept, key, "left")
    return both.select(*items.columns, *[F.coalesce(f"_{n}", v).alias(n) for n, v in values.items()], F.coalesce(*[F.col(f"_{n}") for n in values]).isNotNull().alias("hit"))


def with_sidecars(items: DataFrame, listing: DataFrame, path: str = "path", suffix: str = "info") -> DataFrame:
    """done: a file of the same stem and the suffix is in the listing."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    sidecars = listing.where(F.col(path).endswith(f".{suffix}")).select(stem.alias("_stem")).distinct()
    return items.join(sidecars, stem == F.col("_stem"), "left").withColumn("done", F.col("_stem").isNotNull()).drop("_stem")


def orphaned(sessions: DataFrame, own: int, idle: str = "idle", alive: str = "alive", least_idle: float = 86400.0) -> DataFrame:
    """Sessions `s<process>-...` of other processes that are gone, or untouched for a day."""
    process = F.regexp_extract("name", r"^s(\d+)-", 1).try_cast("long")
    return sessions.withColumn("process", process).where(process.isNotNull() & (process != own) & (~F.col(alive) | (F.col(idle) >= least_idle)))


#: How good a kind of medium is as scratch space, and the least that must be free.
MEDIUM_RANK = {"nvme": 4, "scm": 4, "ssd": 3, "unknown": 2, "hdd": 1}
SCRATCH_FREE = 50 * 1024**3


def scratch_volumes(volumes: DataFrame, by: list[str], need: Column, target: Column) -> DataFrame:
    """Volumes (root, free, media, mbps) with room enough, and their place: by medium (unknown ones by speed), not the target's own, most free."""
    media = F.when(F.col("media") != "unknown", F.col("media")).when(F.col("mbps") >= 400, "ssd").when(F.col("mbps") > 0, "hdd").otherwise("unknown")
    rows = volumes.where(F.col("free") >= F.greatest(F.lit(SCRATCH_FREE), need)).withColumn("media", media).withColumn("rank", lookup(MEDIUM_RANK, F.col("media"), 2))
    same = F.upper(F.left("root", F.lit(1))) == F.upper(F.left(target, F.lit(1)))
    return rows.withColumn("same_disk", same).withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rank"), F.asc("same_disk"), F.desc("free"), "root")))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows without repeats of `by`: the first of each."""
    return numbered_within(rows, by, order, "_first").where("_first = 1").drop("_first")
