"""A versioned journal of keyed records in a shared folder.

Data are append-only tables; a version is a small list of them.  The list of a
new version is created under its number, which fails if another writer was
first, and a pointer to it is then replaced by a rename.  Readers follow the
pointer once and so see one version, whatever is written meanwhile; data of a
write that failed before its list stood are never seen.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries of a commit, and seconds of the first pause between them.
TRIES, PAUSE = 4, 0.4


class Journal:
    """Records (key: string, fields: map of strings) under `root`; an update lays its fields over those before."""

    SCHEMA = "key string, fields map<string,string>, gone boolean, version long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read(self, name: str) -> dict | None:
        """A small JSON file; a broken one is moved aside and never trusted."""
        path = self._path(name)
        if not self._files.exists(path):
            return None
        try:
            stream = self._files.open(path)
            try:
                return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
            finally:
                stream.close()
        except (ValueError, Py4JJavaError) as error:  # torn, or not what its checksum says
            if isinstance(error, Py4JJavaError) and not error.java_exception.getClass().getName().endswith("ChecksumException"):
                raise  # the store can't be reached: that says nothing of the file
            self._files.rename(path, self._path(f"{name}.corrupt-{uuid.uuid4().hex[:8]}"))
            return None

    def _create(self, name: str, content: dict) -> None:
        """Write a file that must not exist yet."""
        stream = self._files.create(self._path(name), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def _point(self, version: int) -> None:
        """Replace the pointer: written beside it and renamed over it."""
        beside = f"_pointer-{uuid.uuid4().hex[:8]}"
        self._create(beside, {"version": version})
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(beside), self._path("_pointer"), options)

    def _versions(self) -> list[int]:
        folder = self._path("versions")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> tuple[int, dict]:
        """(number, list) of the version to read: the newest whose list is whole; 0 without any.

        The pointer may lag behind a writer that died between its list and its
        rename, so later lists are looked for from it on.
        """
        pointer = self._read("_pointer")
        number = int(pointer["version"]) if pointer else max(self._versions(), default=0)
        found = self._read(f"versions/{number:010d}.json") if number else {"tables": [], "batches": []}
        while (later := self._read(f"versions/{number + 1:010d}.json")) is not None:
            number, found = number + 1, later
        if found is None:  # the list itself was broken: the newest whole one before it
            for n in reversed(self._versions()):
                if (found := self._read(f"versions/{n:010d}.json")) is not None:
                    return n, found
            return 0, {"tables": [], "batches": []}
        return number, found

    def _commit(self, change) -> bool:
        """Make a version of change(list before); False, never an error, if it can't be written."""
        for attempt in range(TRIES):
            number, before = self.state()
            after = change(number + 1, before)
            if after is None:
                return True
            try:
                self._create(f"versions/{number + 1:010d}.json", after)
            except Exception:  # another writer was first, or the store refused: look again
                time.sleep(PAUSE * (attempt + 1))
                continue
            try:
                self._point(number + 1)
            except Exception:
                pass  # the list stands: readers find it from the pointer before
            return True
        return False

    def _table(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.select(F.col("key").cast("string").alias("key"), F.col("fields").cast("map<string,string>").alias("fields"), F.col("gone").cast("boolean").alias("gone")).write.parquet(f"{self.root}/{name}")
        return name

    def update(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Lay rows (key, fields; one row for a key) over the records; a named batch counts once however often it comes."""
        if batch is not None and batch in self.state()[1]["batches"]:
            return True
        name = self._table(rows.withColumn("gone", F.lit(False)))

        def change(number: int, before: dict) -> dict | None:
            if batch is not None and batch in before["batches"]:
                return None
            return {"tables": [*before["tables"], [name, number]], "batches": [*before["batches"], *([batch] if batch is not None else [])]}

        return self._commit(change)

    def records(self, version: dict | None = None) -> DataFrame:
        """key, fields of one version: of each key the fields since its last tombstone, later ones over earlier ones."""
        tables = (version or self.state()[1])["tables"]
        log = self.spark.createDataFrame([], self.SCHEMA)
        for name, number in tables:
            log = log.union(self.spark.read.schema("key string, fields map<string,string>, gone boolean").parquet(f"{self.root}/{name}").select("key", "fields", "gone", F.lit(number).cast("long")))
        # a key has one row in each table, and `compact` bounds the tables
        steps = F.array_sort(F.collect_list(F.struct("version", "gone", "fields")), lambda a, b: F.signum(a["version"] - b["version"]).cast("int"))
        laid = F.aggregate("steps", F.struct(F.lit(True).alias("gone"), F.create_map().cast("map<string,string>").alias("fields")), lambda a, s: F.struct(s["gone"].alias("gone"), F.when(s["gone"], F.create_map().cast("map<string,string>")).otherwise(F.map_concat(F.map_filter(a["fields"], lambda k, _: ~F.map_contains_key(s["fields"], k)), s["fields"])).alias("fields")))
        keyed = log.groupBy("key").agg(F.transform(steps, lambda s: F.struct(s["version"].alias("version"), s["gone"].alias("gone"), F.coalesce(s["fields"], F.create_map().cast("map<string,string>")).alias("fields"))).alias("steps"))
        return keyed.select("key", laid.alias("r")).where("not r.gone").select("key", "r.fields")

    def clear(self, field: str = "status", value: str = "failed") -> int:
        """Drop the records whose field has this value, so that they are tried again; how many they were."""
        _, before = self.state()
        dead = self.records(before).where(F.col("fields")[field] == value).select("key", F.create_map().cast("map<string,string>").alias("fields"), F.lit(True).alias("gone"))
        name = self._table(dead)
        count = self.spark.read.parquet(f"{self.root}/{name}").count()
        if count and not self._commit(lambda number, now: {"tables": [*now["tables"], [name, number]], "batches": now["batches"]}):
            return 0
        return count

    def compact(self) -> bool:
        """One table in place of many; versions before it stay readable."""
        seen, before = self.state()
        name = self._table(self.records(before).withColumn("gone", F.lit(False)))
        covered = {t for t, _ in before["tables"]}
        return self._commit(lambda number, now: {"tables": [[name, seen], *[t for t in now["tables"] if t[0] not in covered]], "batches": now["batches"]})

    def follow(self, stream: DataFrame, name: str, checkpoint: str, **options) -> None:
        """Lay a stream (key, fields) over the records, batch by batch, until what is there is done; a batch that comes again changes nothing."""

        def put(rows: DataFrame, number: int) -> None:
            last = rows.groupBy("key").agg(F.max_by("fields", F.col("at")).alias("fields")) if "at" in rows.columns else rows
            if not self.update(last, f"{name}-{number}"):
                raise OSError("the journal could not be written")

        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start().awaitTermination()
