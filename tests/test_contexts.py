"""What outside readers may see: allowlisted fields, cut texts, bounded lists."""

import json

from pyspark.sql import functions as F

from alertloom.operators import normalize

RAW = "id string, source string, event_ts timestamp, payload_json string"


def _alerts(spark, n, **more):
    payload = {"rule": {"level": 5, "description": "r" * 600}, "agent": {"id": "7", "name": "host"}, "password": "hidden", "full_log": "x" * 513} | more
    rows = [(f"e{i:03d}", "wazuh", None, json.dumps(payload | {"id": f"a{i:03d}"})) for i in range(n)]
    return normalize.normalize(spark.createDataFrame(rows, RAW).withColumn("payload", F.parse_json("payload_json")))


def test_alert_context(spark):
    got = normalize.context(_alerts(spark, 1)).first().asDict(recursive=True)
    assert set(got) == {*normalize.ALERT_FIELDS, "raw_excerpt"} and "hidden" not in str(got)
    assert got["rule_name"] == "r" * 512 + "...[truncated]" and got["raw_excerpt"] == {"full_log": "x" * 512 + "...[truncated]"}
    assert got["agent_id"] == "7" and normalize.context(_alerts(spark, 1, full_log="")).first()["raw_excerpt"] is None
    long = _alerts(spark, 1).withColumn("rule_groups", F.array(F.lit("g" * 600), F.lit("h"), F.lit(None).cast("string")))
    assert normalize.context(long).first()["rule_groups"] == ["g" * 512 + "...[truncated]", "h", None]
    assert normalize.context(_alerts(spark, 1).limit(0)).count() == 0


def test_candidates_show_their_first_alerts(spark):
    members = _alerts(spark, 21).withColumn("candidate_id", F.lit("c1")).unionByName(_alerts(spark, 20).withColumn("candidate_id", F.lit("c2")))
    members = members.unionByName(_alerts(spark, 2).withColumn("candidate_id", F.lit(None).cast("string")))
    candidates = spark.createDataFrame([("c1", "h" * 600, ["1.1.1.1"]), ("c2", None, None), ("c3", None, None)], "candidate_id string, primary_host string, src_ips array<string>").withColumn("secret", F.lit("hidden"))
    got = {r["candidate_id"]: r.asDict(recursive=True) for r in normalize.candidate_context(candidates, members).collect()}
    assert {k: (v["alert_count"], v["alerts_truncated"], len(v["alerts"])) for k, v in got.items()} == {"c1": (21, True, 20), "c2": (20, False, 20), "c3": (0, False, 0)}
    assert [a["id"] for a in got["c1"]["alerts"]] == [f"wazuh:a{i:03d}" for i in range(20)]
    assert got["c1"]["primary_host"].endswith("h...[truncated]") and "hidden" not in str(got) and got["c1"]["src_ips"] == ["1.1.1.1"]


def test_incidents_and_the_rest(spark):
    members = _alerts(spark, 1).withColumn("candidate_id", F.lit("c0"))
    candidates = spark.createDataFrame([(f"c{i}",) for i in range(3)], "candidate_id string")
    shown = normalize.candidate_context(candidates, members).withColumn("incident_id", F.when(F.col("candidate_id") != "c2", "i1"))
    incidents = spark.createDataFrame([("i1", 9, "hidden"), ("i2", 1, "hidden")], "incident_id string, max_score int, notes string")
    got = {r["incident_id"]: r.asDict(recursive=True) for r in normalize.incident_context(incidents, shown, most=1).collect()}
    assert {k: (v["candidate_count"], v["candidates_truncated"], [c["candidate_id"] for c in v["candidates"]]) for k, v in got.items()} == {"i1": (2, True, ["c0"]), "i2": (0, False, [])}
    assert got["i1"]["max_score"] == 9 and got["i1"]["candidates"][0]["alert_count"] == 1 and "hidden" not in str(got)
    rows = spark.createDataFrame([("x", "s" * 600, "raw")], "indicator string, summary string, raw string")
    assert normalize.enrichment_context(rows).first().asDict() == {"indicator": "x", "indicator_type": None, "provider": None, "summary": "s" * 512 + "...[truncated]", "looked_up_at": None}
    assert normalize.triage_context(rows).columns == list(normalize.TRIAGE_FIELDS) and normalize.routing_context(rows).columns == list(normalize.ROUTING_FIELDS)
