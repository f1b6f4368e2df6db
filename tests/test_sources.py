"""Trees of files, the journal, stored packets and keyed streams at their edges."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from trackplan.sources import tables
from trackplan.sources.journal import Journal
from trackplan.sources.tree import TreeReader, readable, tree
from trackplan.streaming import keyed


@pytest.fixture
def files(tmp_path):
    for top in ("a", "b", "c"):
        for sub in ("x", "y"):
            os.makedirs(tmp_path / top / sub)
            (tmp_path / top / sub / "one.conf").write_text("k = 1\n# none\nk = 2")
    (tmp_path / "root.txt").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "gone", tmp_path / "a" / "lost")
    return str(tmp_path)


@pytest.mark.parametrize("tasks", [1, 4, 50])
def test_tree_lists_every_file_once(spark, files, tasks):
    read, lost = readable(tree(spark, files, tasks=tasks))
    assert sorted(r.path for r in read.collect()) == sorted([f"{t}/{s}/one.conf" for t in "abc" for s in "xy"] + ["root.txt"])
    assert [(r.path, r.error) for r in lost.collect()] == [("a/lost", "No such file or directory")]


def test_tree_filters_prune_partitions(spark, files):
    reader = TreeReader(files, "entries", 50)
    every = len(reader.partitions())
    list(reader.pushFilters([In(("top",), ("b", "c")), EqualTo(("top",), "b")]))
    assert every == 10 and {p.path.split("/")[0] for p in reader.partitions()} == {"b"}
    frame = tree(spark, files, tasks=50).where("top = 'b'")
    assert frame.count() == 2 and frame.rdd.getNumPartitions() == 3


def test_tree_of_lines_and_texts(spark, files):
    read, lost = readable(tree(spark, files, "lines"))
    found = tables.settings(read, ["path"]).collect()
    assert len(found) == 6 and {(r.key, r.value) for r in found} == {("k", "2")}
    assert {(r.path, r.error) for r in lost.collect()} == {("a/lost", "No such file or directory"), ("root.txt", "not UTF-8")}
    assert readable(tree(spark, f"{files}/nowhere"))[1].count() == 1
    os.makedirs(f"{files}/empty")
    assert tree(spark, f"{files}/empty", "texts").count() == 0


def rows(spark, **fields):
    return spark.createDataFrame([(k, f) for k, f in fields.items()], "key string, fields map<string,string>")


def test_journal(spark, tmp_path):
    """Fields laid over each other, tombstones, batches that come again, another writer, a broken pointer and list."""
    log = Journal(spark, f"file://{tmp_path}/journal")
    state = lambda: {r.key: r.fields for r in log.records().collect()}
    assert state() == {} and log.clear() == 0
    assert log.update(rows(spark, a={"status": "failed", "n": "1"}, b={"status": "done"}), "first")
    assert log.update(rows(spark, a={"n": "9"}), "first")
    assert log.update(rows(spark, a={"n": "2"}))
    assert state() == {"a": {"status": "failed", "n": "2"}, "b": {"status": "done"}}
    before = log.state()[1]
    assert log.clear() == 1 and state() == {"b": {"status": "done"}}
    assert {r.key for r in log.records(before).collect()} == {"a", "b"}  # a reader of the version before
    assert log.update(rows(spark, a={"status": "new"})) and state()["a"] == {"status": "new"}
    assert log.compact() and state() == {"a": {"status": "new"}, "b": {"status": "done"}} and len(log.state()[1]["tables"]) == 1
    # another writer takes the next number first: the change is made upon its version
    number, now = log.state()
    original = log._create

    def overtaken(name, content):
        if name.startswith("versions/") and not os.path.exists(f"{tmp_path}/journal/versions/{number + 1:010d}.json"):
            original(f"versions/{number + 1:010d}.json", now)
        original(name, content)

    log._create = overtaken
    assert log.update(rows(spark, c={"status": "done"})) and set(state()) == {"a", "b", "c"} and log.state()[0] == number + 2
    log._create = original
    (tmp_path / "journal" / "_pointer").write_text("{torn")
    assert set(state()) == {"a", "b", "c"} and any(n.startswith("_pointer.corrupt") for n in os.listdir(tmp_path / "journal"))
    (tmp_path / "journal" / "versions" / f"{number + 3:010d}.json").write_text("{torn")
    assert set(state()) == {"a", "b", "c"}


def test_journal_that_cannot_be_written(spark, tmp_path, monkeypatch):
    log = Journal(spark, f"file://{tmp_path}/journal")

    def refused(name, content):
        raise OSError("refused")

    monkeypatch.setattr("trackplan.sources.journal.PAUSE", 0.0)
    monkeypatch.setattr(log, "_create", refused)
    assert log.update(rows(spark, a={"x": "1"})) is False and log.records().count() == 0


def test_stored_packets_prune_folders(spark, tmp_path):
    packets = spark.range(4000).select((F.col("id") % 2).alias("file"), F.col("id").cast("double").alias("pts"), F.lit(0.5).alias("length"))
    tables.store_packets(packets, f"{tmp_path}/packets")
    durations = spark.createDataFrame([(0, 4000.0), (1, 150.0)], "file long, d double")
    found = tables.last_packet_stored(spark.read.parquet(f"{tmp_path}/packets"), durations, ["file"], "d")
    assert sorted(map(tuple, found.collect())) == [(0, 3998.5), (1, 1199.5)]
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString().lower()


class Memory:
    """A processor's state and timers in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def watch(batches, limit=10.0, fire=()):
    memory, dog = Memory(), keyed.Watchdog(limit)
    dog.init(memory)
    out = []
    for batch in batches:
        frame = pd.DataFrame(batch, columns=["t", "position", "frame", "size"]).astype("float64")
        out += [tuple(r) for f in dog.handleInputRows((7,), iter([frame]), None) for r in f[["since", "position"]].itertuples(index=False)]

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    for at in fire:
        if at in memory.timers:
            out += [tuple(r) for f in dog.handleExpiredTimer((7,), None, Expired(at)) for r in f[["since", "position"]].itertuples(index=False)]
    return out, memory


def test_watchdog_signals():
    """Any of three signals is a sign of life; a missing position is none; steps too small add up; a limit of 0 finds nothing."""
    none = float("nan")
    assert watch([[(0, 1.0, none, none), (8, none, 5, none), (16, none, none, 100), (30, none, 6, none)]])[0] == [(16.0, 1.0)]
    assert watch([[(0, none, none, none), (30, 0.5, none, none)]])[0][0][0] == 0.0
    slow = [(k, 1.0 + k * 0.0004, none, none) for k in range(12)]
    assert watch([slow])[0] == []
    assert watch([[(0, 1.0, none, none), (99, 2.0, none, none)]], limit=0)[0] == [] and not watch([[(0, 1.0, none, none)]], limit=0)[1].timers


def test_watchdog_timers():
    """One timer at a time; silence is told once, by the timer or by the next rise."""
    none = float("nan")
    out, memory = watch([[(0, 1.0, none, none)], [(5, 2.0, none, none)]], fire=[15001])
    assert out == [(5.0, 2.0)] and memory.timers == {15001} and memory.value[4]
    out, memory = watch([[(0, 1.0, none, none)], [(40, 2.0, none, none)]])
    assert out == [(0.0, 1.0)] and memory.timers == {50001}
