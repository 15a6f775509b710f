"""Micro-batches, keyed dedup and the tailing source."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from alertloom.streaming import cycle, tail


def test_cycles_go_on_after_a_failure(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen, failed = [], []

    def step(batch, number):
        seen.append(batch.count())
        raise ValueError("bad batch")

    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    cycle.run_cycles(stream, step, str(tmp_path / "cp"), failed=failed).awaitTermination(60)
    assert sum(seen) == 10 and failed and "bad batch" in failed[0][1]


def test_pushes_that_fail_are_counted_and_cycles_logged(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sent, errors, lines = [], [], []

    def refuse(rows):
        raise ConnectionError("no dashboard")

    step = cycle.with_pushes(lambda batch, number: {"triage": batch, "incidents": batch}, {"triage": refuse, "incidents": lambda rows: rows.count()}, sent, errors)
    log = cycle.CycleLog(lines.append)
    spark.streams.addListener(log)
    try:
        cycle.run_cycles(stream, step, str(tmp_path / "cp"), fail_fast=True).awaitTermination(60)
        for _ in range(100):  # the listener hears of it a little later
            if any("terminated" in x for x in lines):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sum(n for _, name, n in sent if name == "incidents") == 10 and errors[0][1:] == ("triage", "no dashboard")
    assert log.rows == 10 and log.cycles >= 1 and log.failed == 0
    assert sum(json.loads(x)["raw_events"] for x in lines if "cycle_completed" in x) == 10


def test_first_of_each_key(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in"))
    start = lambda: cycle.dedup_with_ttl(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert start().awaitTermination(90)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    spark.createDataFrame([("a", 4), ("c", 5)], "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert start().awaitTermination(90)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def all_lines(reader, start):
    end = reader.latestOffset()
    return [r[0] for p in reader.partitions(start, end) for r in reader.read(p)], end


def test_tail_resumes_and_resets(tmp_path):
    path = str(tmp_path / "log")
    reader = tail._Reader(path)
    assert all_lines(reader, reader.initialOffset())[0] == []
    with open(path, "w") as f:
        f.write("half of a line")
    assert all_lines(reader, reader.initialOffset()) == ([], reader.initialOffset())
    with open(path, "w") as f:
        f.write("one\ntwo\nhalf")
    rows, end = all_lines(reader, reader.initialOffset())
    assert rows == ["one", "two"]
    with open(path, "a") as f:
        f.write(" done\n")
    rows, end = all_lines(reader, end)
    assert rows == ["half done"]
    assert all_lines(reader, end) == ([], end)
    with open(path, "r+") as f:
        f.write("ONE")
    assert tail.resume(path, end) == 0
    assert all_lines(reader, end)[0] == ["ONE", "two", "half done"]
    end = reader.latestOffset()
    with open(path, "w") as f:  # shrunk
        f.write("x\n")
    assert all_lines(reader, end)[0] == ["x"]
    end = reader.latestOffset()
    os.rename(path, path + ".1")
    with open(path, "w") as f:  # rotated
        f.write("y\nz\n")
    assert all_lines(reader, end)[0] == ["y", "z"]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_tail_ranges_hold_each_line_once(tmp_path, size):
    rng = random.Random(size)
    want = ["x" * rng.choice((0, 1, 5, 6, 7, 200)) + rng.choice(("", "é", "\r")) for _ in range(300)]
    path = tmp_path / "log"
    path.write_bytes("".join(x + "\n" for x in want).encode() + b"rest")
    reader = tail._Reader(str(path), size)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert all(p.end - p.start <= size for p in parts)
    assert [r[0] for p in parts for r in reader.read(p)] == [x.rstrip("\r") for x in want if x.strip()]


def test_tail_limits_a_trigger_and_a_restart_goes_on(tmp_path):
    path, progress = tmp_path / "log", str(tmp_path / "progress")
    path.write_text("".join(f"{i:09d}\n" for i in range(100)) + "long " * 100 + "\nend\n")
    at, seen, batches = {"at": 0, "file": "", "head": ""}, [], 0
    while batches < 50:
        reader = tail._Reader(str(path), 16, 55, progress)  # restarted before each batch
        rows, end = all_lines(reader, at)
        if end == at:
            break
        assert len(rows) <= 6
        seen += rows
        reader.commit(end)
        at, batches = end, batches + 1
    assert seen == [f"{i:09d}" for i in range(100)] + [("long " * 100).rstrip("\n"), "end"] and batches > 15
    with pytest.raises(ValueError, match="progress"):
        tail._Reader(str(path), 16, 55)


def test_tail_source(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("a\nb\n")
    spark.dataSource.register(tail.TailSource)
    query = spark.readStream.format("tail").load(str(path)).select(F.upper("value").alias("v")).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["v"] for r in spark.table("tailed").collect()) == ["A", "B"]


def test_tail_source_reads_ranges_in_tasks(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("".join(f"line {i}\n" for i in range(50_000)))
    spark.dataSource.register(tail.TailSource)

    def run():
        source = spark.readStream.format("tail").option("rangeBytes", 20_000).option("bytesPerTrigger", 200_000).option("progress", str(tmp_path / "progress")).load(str(path))
        query = source.select("value", F.spark_partition_id().alias("part")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out"))

    got = run()
    assert got.count() == got.select("value").distinct().count() == 50_000 and got.select("part").distinct().count() >= 9
    with open(path, "a") as f:
        f.write("more\n")
    assert run().count() == 50_001


def test_keys_expire_in_a_query_that_runs_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(list(rows), "k string, v int").coalesce(1).write.mode("append").parquet(folder)
    add(("a", 1), ("a", 2), ("b", 3))
    stream = spark.readStream.schema("k string, v int").parquet(folder)
    with pytest.raises(ValueError, match="providerClass"):
        cycle.dedup_continuous(stream, "k", 20)
    spark.conf.set(*cycle.STATE_STORE)

    def start(life):
        return cycle.dedup_continuous(stream, "k", life).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def until(query, ok):
        for _ in range(120):
            if query.exception() is None and query.lastProgress and ok():
                return True
            time.sleep(0.5)
        return False

    passed = lambda: sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
    try:
        query = start(12)
        assert until(query, lambda: len(passed()) == 2)
        query.stop()
        add(("a", 4), ("c", 5))
        query = start(12)  # the keys are in the checkpoint
        assert until(query, lambda: [k for k, _ in passed()] == ["a", "b", "c"])
        # no further rows come, and the keys go
        assert until(query, lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
        add(("a", 6))
        assert until(query, lambda: ("a", 6) in passed())
        assert [k for k, _ in passed()] == ["a", "a", "b", "c"]
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.unset(cycle.STATE_STORE[0])
