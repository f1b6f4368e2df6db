"""Intermediate tables in the folder that all executors share.

Executors can be lost at any time, so lineage is cut by writing Parquet into
the folder named by `spark.checkpoint.dir`; nothing is kept on one executor.
Tables that a result is still read from stay until the driver ends, and go then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints"
#: Rows and bytes in one Arrow batch handed to Python, so that long texts stay bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Row groups that a writer of buckets holds in memory.
ROW_GROUP_BYTES = 16 << 20
_AT_END: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local default only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, unless the session has bounds of its own."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns added beside it can't clash with their names."""
    return F.struct(*map(quoted, docs.columns))


def with_stored_order(df: DataFrame, name: str) -> DataFrame:
    """Add `name` (long, no value twice) to a table read from Parquet: it rises in the order in which the rows were written.

    Reading deals files out by size.  The order is kept in the names, which
    number the written partition and its files, and in the rows of a file.
    """
    file = F.col("_metadata.file_name")
    part = F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")
    # the counter ends the name: parts of the identifier before it may look like one
    of_part = F.coalesce(F.regexp_extract(file, r"-c(\d+)\.[^-]*$", 1).try_cast("long"), F.lit(0))
    return df.withColumn(name, F.shiftleft(part, 42) + F.shiftleft(of_part, 32) + F.col("_metadata.row_index"))


class Scratch:
    """Tables of one operator call.  `keep` tables stay until the driver ends, the rest go at the end of the call.

    With `brief` all go then: for calls whose result is stored elsewhere.
    """

    def __init__(self, spark: SparkSession, name: str, brief: bool = False):
        self.spark, self.brief = spark, brief
        own = f"{shared_folder(spark)}/trackplan/{spark.sparkContext.applicationId}"
        self.folder = f"{own}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.dropped: list[str] = []
        self.tables: list[str] = []
        if own not in _AT_END:
            _AT_END.add(own)
            system, target = self._file(own)
            system.mkdirs(target)
            system.deleteOnExit(target)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.dropped:
            system, target = self._file(path)
            system.delete(target, True)

    def path(self, name: str, keep: bool = False) -> str:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        if self.brief or not keep:
            self.dropped.append(path)
        return path

    def store(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Write `df` and return a DataFrame that reads the written table."""
        path = self.path(name, keep)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_narrow(self, df: DataFrame, name: str) -> DataFrame:
        """`store` for rows of a few numbers: an eighth of the session's shuffle partitions, which are set for texts, as tasks and files."""
        return self.store(df.coalesce(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)), name)

    def bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int, by: str | None = None) -> DataFrame:
        """Write `df` in buckets of `keys`, and folders of `by`: grouping and joining by `keys` moves none of its rows.  It goes at the end of the call."""
        table = f"trackplan_{uuid.uuid4().hex}"
        self.tables.append(table)
        writer = df.write.format("parquet").bucketBy(buckets, *keys).option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("path", self.path(name))
        (writer.partitionBy(by) if by else writer).saveAsTable(table)
        return self.spark.table(table)

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target
