"""Rows that a stage can't handle go aside, the others go on; canonical identifiers of content."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from alertloom.functions import canonical
from alertloom.operators import normalize, quarantine
from alertloom.plans import pipeline
from alertloom.sources import readers


def _folder(tmp_path):
    at = tmp_path / "events"
    at.mkdir()
    good = [{"id": f"e{i}", "source": "wazuh", "timestamp": "2026-01-05T10:00:00Z", "payload": {"id": f"a{i}", "rule": {"level": 12, "description": "login"}, "agent": {"name": f"host{i}"}}} for i in range(3)]
    bad = [{"id": "b1", "source": "wazuh", "payload": "text"}, {"id": "b2", "source": "nowhere", "payload": {"x": 1}}, {"id": "b3", "source": "wazuh", "timestamp": "yesterday", "payload": {"x": 1}}]
    (at / "all.json").write_text(json.dumps([good[0], *bad, *good[1:]]))
    return str(at)


def test_bad_rows_of_a_replay_go_aside(spark, tmp_path):
    out = pipeline.run(readers.replay(spark, _folder(tmp_path), strict=False), now=None)
    assert sorted(r["raw_event_id"] for r in out["alerts"].collect()) == ["e0", "e1", "e2"]
    errors = {r["id"]: (r["stage"], r["message"]) for r in out["errors"].collect()}
    assert set(errors) == {"b1", "b2", "b3"} and {s for s, _ in errors.values()} == {"read"}
    assert errors["b1"][1] == "payload is not an object" and errors["b2"][1] == "unknown source: nowhere" and errors["b3"][1] == "malformed timestamp: yesterday"
    assert {r["message"]: r["n"] for r in quarantine.counts(out["errors"]).collect()}["payload is not an object"] == 1


def test_fail_fast_names_the_row(spark, tmp_path):
    with pytest.raises(Exception, match="read failed for b"):
        pipeline.run(readers.replay(spark, _folder(tmp_path), strict=False), config=pipeline.Config(fail_fast=True))


def test_a_replaced_stage_tells_of_its_rows(spark, tmp_path):
    def picky(raw):
        return normalize.normalize(raw).withColumn("error", F.when(F.col("hostname") == "host1", "no such host"))

    out = pipeline.run(readers.replay(spark, _folder(tmp_path), strict=False), stages=pipeline.Stages(normalize=picky))
    assert sorted(r["hostname"] for r in out["alerts"].collect()) == ["host0", "host2"] and "error" not in out["alerts"].columns
    assert [(r["stage"], r["id"], r["message"]) for r in out["errors"].where("stage = 'normalize'").collect()] == [("normalize", "wazuh:a1", "no such host")]
    kept = {i for r in out["candidates"].collect() for i in r["alert_ids"]}
    assert kept == {"wazuh:a0", "wazuh:a2"}


def test_no_id_and_null_payloads(spark):
    raw = spark.createDataFrame([("a", "{}"), (None, "{}"), (" ", " {\"x\": 1}"), ("b", None), ("c", "[1]")], "id string, payload_json string")
    good, errors = quarantine.split(raw, "read", "id", quarantine.raw_problem(raw))
    assert [r["id"] for r in good.collect()] == ["a"]
    assert sorted((r["id"] or "", r["message"]) for r in errors.collect()) == [("", "raw event has no id"), (" ", "raw event has no id"), ("b", "payload is not an object"), ("c", "payload is not an object")]
    assert quarantine.split(raw, "read", "id") == (raw, None)


PAYLOADS = [
    {"b": 1, "a": {"z": [1.0, 1e22, 0.1, -0.0], "y": None}}, {"text": "Ünïcode   😀 \"q\" \\ / \t"}, {"n": 12345678901234567890123456789012345678901234567890, "t": True},
    {"": [], "o": {}}, {"e": 1e-7, "f": 123456789.125, "g": 5e-324}, {"A": 1, "a": 2, "Z": {"b": {"a": [{"d": 1, "c": 2}]}}},
]


def _want(payload):
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]


def test_canonical_text(spark):
    df = spark.createDataFrame([(json.dumps(p, ensure_ascii=False),) for p in PAYLOADS] + [(None,), ("{no",)], "t string")
    got = [r[0] for r in df.select(canonical.content_id("x", canonical.canonical_text("t"))).collect()]
    assert got == [f"x-{_want(p)}" for p in PAYLOADS] + [None, None]


def test_hits_get_canonical_ids(spark, tmp_path):
    hits = [{"_source": {**p, "@timestamp": "2026-01-05T10:00:00Z"}} for p in PAYLOADS if "n" not in p]
    (tmp_path / "r.json").write_text(json.dumps({"hits": {"hits": [*hits, "junk", {"_id": "own", "_source": {"x": 1}}]}}, ensure_ascii=False))
    rows = readers.hits(readers._whole_files(spark, str(tmp_path)), "text", "wazuh-indexer", "wazuh")
    got = [(r["id"], r["usable"]) for r in rows.collect()]
    assert got == [(f"wazuh-indexer-{_want(h['_source'])}", True) for h in hits] + [(None, False), ("own", True)]
    assert {r["usable"]: r["n"] for r in readers.hit_counts(rows).collect()} == {True: len(hits) + 1, False: 1}
