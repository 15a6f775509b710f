"""Ordinals and islands over hot keys against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from alertloom.operators import cluster, ordinal, sinks


def test_ordinals_of_a_hot_hour(spark):
    # a third of all rows within one hour
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id") % 3600).otherwise(F.hash("id") % 10_000_000).alias("at")).repartition(7)
    got = ordinal.ranked(rows, ["at", "id"], parts=16)
    want = {r["id"]: n for n, r in enumerate(sorted(rows.collect(), key=lambda r: (r["at"], r["id"])), 1)}
    assert {r["id"]: r["ordinal"] for r in got.collect()} == want
    sizes = [r["count"] for r in ordinal._placed(rows, ["at", "id"], 16).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)


def test_batches_without_a_shard_and_with_a_hot_one(spark):
    data = [(i, "hot" if i % 3 else (None, "a", "b")[i % 2 + i % 5 % 2], f"2024-01-01 00:{i % 60:02d}:00") for i in range(1000)]
    rows = spark.createDataFrame(data, "k long, rule string, t string").select("k", "rule", F.col("t").cast("timestamp").alias("t"), F.lit(1).alias("score")).repartition(5)
    order = sorted(data, key=lambda r: (r[2], r[0]))
    got = {r["k"]: r["batch"] for r in sinks.hec_batches(rows, ("score",), "t", ["t", "k"], 100).collect()}
    assert got == {r[0]: n // 100 for n, r in enumerate(order)}
    got = {r["k"]: (r["shard"], r["batch"]) for r in sinks.hec_batches(rows, ("score",), "t", ["t", "k"], 100, F.col("rule")).collect()}
    want = {r[0]: (s, n // 100) for s in ("hot", "a", "b", None) for n, r in enumerate(x for x in order if x[1] == s)}
    assert got == want


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_islands(spark, parts):
    rng = random.Random(parts)
    data = []
    for i in range(3000):
        key = "giant" if rng.random() < 0.8 else f"k{rng.randrange(40)}"
        at = rng.randrange(40_000)
        dated = not (key == "k7" and i % 5 == 0)
        data.append((key, i, at if dated else None, at + rng.randrange(60) if dated else None))
    rows = spark.createDataFrame(data, "component string, id long, moment long, last long").repartition(6)
    want = {}
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        loose, seen, n = any(r[2] is None for r in mine), None, 0
        for _, i, moment, last in mine:
            n += not loose and seen is not None and moment > seen + 30
            seen = max(x for x in (seen, last, -1) if x is not None)
            want[i] = n
    got = ordinal.islands(rows, "component", "moment", "last", F.col("moment").isNull(), 30, parts=parts)
    assert got.columns == ["component", "id", "moment", "last", "island"]
    assert {r["id"]: r["island"] for r in got.collect()} == want
    assert max(want.values()) > 5


def greedy(rows, minutes, cap):
    """The rule as it is stated: in order of time, a row joins the newest group that shares an entity, is near and not full."""
    groups, out = [], {}
    for ts, own, names in sorted(rows, key=lambda r: (r[0], r[1])):
        for g in reversed(groups):
            if names & g["names"] and g["n"] < cap and abs((ts - g["last"]).total_seconds()) <= minutes * 60:
                break
        else:
            g = {"names": set(), "n": 0, "last": ts, "first": own}
            groups.append(g)
        g["names"] |= names
        g["n"] += 1
        g["last"] = max(g["last"], ts)
        out[own] = g["first"]
    return out


def test_one_giant_component_equals_the_sequential_rule(spark):
    import datetime as dt

    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    data, at = [], 0
    for i in range(1500):
        at += rng.choice((0, 20, 60, 400, 3000))
        # everything is chained through host:h0
        data.append((start + dt.timedelta(seconds=at), f"a{i:05d}", {f"user:u{rng.randrange(6)}"} | ({"host:h0"} if i % 4 == 0 else {f"host:h{rng.randrange(5)}"})))
    rows = spark.createDataFrame([(i, t, sorted(e)) for t, i, e in data], "id string, event_ts timestamp, entities array<string>").repartition(5)
    for minutes, cap in ((30, 50), (30, 5)):
        got = {r["id"]: r["cluster"] for r in cluster.cluster(rows, minutes, cap).collect()}
        assert got == greedy(data, minutes, cap)
