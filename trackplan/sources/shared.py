"""Places in the folder that all executors share, for tables that cut lineage and for what queries write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"
_AT_END: set[str] = set()


def shared_place(spark: SparkSession, name: str) -> str:
    """A new place in the folder of `spark.checkpoint.dir` (a local one for local masters), which goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or (LOCAL_DEFAULT if spark.sparkContext.master.startswith("local") else None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{folder.rstrip('/')}/trackplan/queries-{spark.sparkContext.applicationId}"
    if own not in _AT_END:
        _AT_END.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new place and read from it."""
    at = shared_place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
