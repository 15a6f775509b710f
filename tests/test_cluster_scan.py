"""The scan of alerts: batches come and go, only open groups stay, and ranges scanned side by side give what one scan gives."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from alertloom.operators import cluster

MINUTE = 60_000_000


def plain(rows, minutes, cap):
    """The rule as it is stated, over (component, ts or None, id, names) in order."""
    groups, out = [], {}
    for component, ts, own, names in rows:
        for g in reversed(groups):
            near = ts is None or g["last"] is None or ts - g["last"] <= minutes * MINUTE
            if g["component"] == component and set(names) & g["names"] and g["n"] < cap and near:
                break
        else:
            g = {"component": component, "names": set(), "n": 0, "last": None, "first": own}
            groups.append(g)
        g["names"] |= set(names)
        g["n"] += 1
        g["last"] = g["last"] if ts is None else ts
        out[own] = g["first"]
    return out


def batch(rows, span=0):
    return pa.RecordBatch.from_pydict({"span": [span] * len(rows), "component": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.int64()), "id": [r[2] for r in rows], "entities": pa.array([r[3] for r in rows], pa.list_(pa.string()))})


def alerts(n, users, seed, undated=0, every=1):
    rng = random.Random(seed)
    rows = [("c0" if k % 10 else "c1", None if k < undated else rng.randrange(n * every * MINUTE // 60), f"a{k:06d}", [f"user:u{k % 10 == 0}-{rng.randrange(users)}", f"host:h{k % 10 == 0}-{rng.randrange(20)}"]) for k in range(n)]
    return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("undated", [0, 40])
def test_a_scan_goes_on_from_what_another_left_open(undated):
    rows = alerts(1200, 60, 3, undated)
    want, got, state = plain(rows, 5, 12), {}, None
    for first in range(0, len(rows), 170):
        out = list(cluster._scan(5 * MINUTE, 12, {7: state})([batch(rows[first : first + 170], 7)]))
        got |= {r["id"]: r["cluster"] for b in out for r in b.to_pylist() if r["id"] is not None}
        state = out[-1].to_pylist()[-1]["state"]
    assert got == want


def test_an_island_without_a_gap_is_never_held_whole():
    taken = []

    def batches():
        for first in range(0, 60_000, 1000):
            taken.append(first)
            yield batch([("c", k * MINUTE // 10, f"a{k}", [f"user:{k}", f"host:{k % 50}"]) for k in range(first, first + 1000)])

    seen = 0
    for out in cluster._scan(5 * MINUTE, 20, {})(batches()):
        seen += out.num_rows
        assert len(taken) <= seen // 1000 + 1
    groups = cluster._Open(5 * MINUTE, 20)
    for k in range(60_000):
        groups.place("c", k * MINUTE // 10, f"a{k}", [f"user:{k}", f"host:{k % 50}"])
        assert len(groups.groups) <= groups.bound < 10_000


@pytest.mark.parametrize(("users", "every", "scans"), [(12, 50, 2), (3000, 1, 3)])
def test_ranges_equal_the_rule(spark, monkeypatch, users, every, scans):
    # few alerts a window: what is open is soon the same from any start; many: it is not, and after two scans ranges are scanned in turn
    rows = alerts(4000, users, users, every=every)
    start = dt.datetime(2024, 1, 1)
    data = [(own, start + dt.timedelta(microseconds=ts), [*names, None]) for _, ts, own, names in rows]
    real, begun = cluster._scan, []
    monkeypatch.setattr(cluster, "_scan", lambda *given: begun.append(given) or real(*given))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        df = cluster.cluster(spark.createDataFrame(data, "id string, event_ts timestamp, entities array<string>").repartition(3), 5, 30)
        got = {r["id"]: r["cluster"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows, 5, 30)
    assert len(begun) == scans
