"""The keyed store: upserts by bucket, replays, failures between data and commit, removal."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertloom.streaming import cycle
from alertloom.streaming.store import BUCKET, KeyedStore

SCHEMA = StructType().add("k", "string").add("a", "integer").add("b", "string")


def _store(spark, tmp_path, **how):
    return KeyedStore(spark, str(tmp_path / "store"), "k", SCHEMA, **{"buckets": 8} | how)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replace_equals_a_dictionary(spark, tmp_path):
    store, want, dice = _store(spark, tmp_path, files=2), {}, random.Random(3)
    for batch in range(4):
        rows = [(dice.choice(["hot", None, *(f"k{i}" for i in range(30))]), dice.randrange(9), dice.choice(["x", None])) for _ in range(60)] + [("hot", batch, "y")] * 30
        numbered = [(*r, i) for i, r in enumerate(rows)]
        df = spark.createDataFrame(numbered, "k string, a int, b string, i int")
        assert store.apply(df.select("k", "a", "b"), batch) is True
        # without a sequence the greatest JSON text of the equal ones counts
        for k in {r[0] for r in rows}:
            want[k] = max((r for r in rows if r[0] == k), key=lambda r: "{" + ("\"k\":null" if r[0] is None else f'"k":"{r[0]}"') + f',"a":{r[1]},"b":' + ("null" if r[2] is None else f'"{r[2]}"'))
    assert _rows(store.read()) == sorted(want.values(), key=repr)
    assert _rows(store.lookup(spark.createDataFrame([("hot",), (None,), ("no",)], "k string"))) == sorted((want["hot"], want[None]), key=repr)


def test_sequence_and_missing_columns(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.apply(spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 5, "y")], SCHEMA), 0, sequence=F.col("a"))
    assert _rows(store.read()) == [("x", 2, "new"), ("y", 5, "y")]
    store.apply(spark.createDataFrame([("x", 9)], "k string, a int"), 1)
    assert _rows(store.read()) == [("x", 9, None), ("y", 5, "y")]
    with pytest.raises(ValueError):
        store.apply(spark.createDataFrame([("x", 9)], "k string, c int"), 2)


def test_update_and_absent(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.apply(spark.createDataFrame([("x", 1, "one"), ("y", 2, "two")], SCHEMA), 0)
    store.apply(spark.createDataFrame([("x", 7, "no"), ("z", 8, "z")], SCHEMA), 1, mode="update", columns=["a"])
    assert _rows(store.read()) == [("x", 7, "one"), ("y", 2, "two"), ("z", 8, "z")]
    store.apply(spark.createDataFrame([("x", 0, "q"), ("w", 2, "late"), ("w", 1, "first")], SCHEMA), 2, mode="absent", sequence=F.col("a"))
    assert _rows(store.read()) == [("w", 1, "first"), ("x", 7, "one"), ("y", 2, "two"), ("z", 8, "z")]


def test_replayed_batches_change_nothing(spark, tmp_path):
    store = _store(spark, tmp_path)
    first, second = (spark.createDataFrame([("x", i, "b")], SCHEMA) for i in (1, 2))
    assert store.apply(first, 0) and store.apply(second, 1)
    files = sorted(os.listdir(tmp_path / "store" / "commits"))
    assert not store.apply(first, 0) and not store.apply(first, 1) and _rows(store.read()) == [("x", 2, "b")]
    assert sorted(os.listdir(tmp_path / "store" / "commits")) == files
    assert store.apply(first, 0, writer="other") and _rows(store.read()) == [("x", 1, "b")]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.apply(spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("a"), F.lit("v").alias("b")), 0)
    before = store._last()["folders"]
    store.apply(spark.createDataFrame([("7", -1, "w")], SCHEMA), 1)
    after = store._last()["folders"]
    changed = [b for b in before if before[b] != after[b]]
    assert len(before) == len(after) == 8 and len(changed) == 1
    assert os.listdir(tmp_path / "store" / "data" / after[changed[0]]).count(f"{BUCKET}={changed[0]}") == 1
    assert store.read().count() == 200 and store.read().where("k = '7'").first()["a"] == -1
    # reopened with another number of buckets it keeps its own
    assert _store(spark, tmp_path, buckets=3).buckets == 8


def test_data_without_a_commit_is_not_seen(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    store.apply(spark.createDataFrame([("x", 1, "kept")], SCHEMA), 0)

    def crash(self, last, rows, touched, applied):
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/data/orphan")
        os.makedirs(f"{self.path}/commits/000000000001/_temporary")
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_commit", crash)
        with pytest.raises(OSError):
            store.apply(spark.createDataFrame([("x", 2, "lost")], SCHEMA), 1)
    assert _rows(store.read()) == [("x", 1, "kept")]
    assert store.apply(spark.createDataFrame([("x", 2, "again")], SCHEMA), 1) and _rows(store.read()) == [("x", 2, "again")]
    gone = store.vacuum(keep=1)
    assert "data/orphan" in gone and len(os.listdir(tmp_path / "store" / "data")) == 1 and _rows(store.read()) == [("x", 2, "again")]


def test_remove_and_empty_batches(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.read().count() == 0 and store.remove(F.col("a") < 5) == 0
    assert store.apply(spark.createDataFrame([], SCHEMA), 0) and store.read().count() == 0
    store.apply(spark.createDataFrame([("x", 1, "b"), ("y", 9, "b"), ("z", None, "b")], SCHEMA), 1)
    assert store.remove(F.col("a") < 5) == 1 and _rows(store.read()) == [("y", 9, "b"), ("z", None, "b")]
    assert store.remove(F.lit(True)) == 2 and store.read().count() == 0
    assert not store.apply(spark.createDataFrame([("x", 1, "b")], SCHEMA), 1)


def test_stream_into_the_store(spark, tmp_path):
    source = str(tmp_path / "in")
    store = _store(spark, tmp_path)
    spark.createDataFrame([("x", 1, "b"), ("y", 1, "b")], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    run = lambda: cycle.run_cycles(stream, store.sink("alerts"), str(tmp_path / "cp"), fail_fast=True).awaitTermination(90)
    assert run()
    spark.createDataFrame([("x", 2, "c")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run()
    assert _rows(store.read()) == [("x", 2, "c"), ("y", 1, "b")]
    assert store._last()["applied"] == {"alerts": 1}
