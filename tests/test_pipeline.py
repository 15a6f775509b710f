"""Readers, clustering, scoring and the whole batch plan on small recorded telemetry."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.operators import cluster, dedup, evaluate, normalize, queries, reports, review, sinks, triage
from alertloom.plans import pipeline
from alertloom.sources import readers

T0 = datetime(2026, 6, 10, 12, 0, 0)


@pytest.fixture()
def replay_file(tmp_path):
    events = [
        {"id": "w1", "source": "wazuh", "timestamp": "2026-06-10T12:00:00Z", "payload": {"id": "w1", "timestamp": "2026-06-10T12:00:00Z", "agent": {"id": "007", "name": "ws-12"}, "rule": {"level": 12, "description": "Encoded PowerShell", "groups": ["windows"]}, "data": {"srcip": "10.0.1.42", "dstip": "198.51.100.25", "dstuser": "alice", "command": "powershell -encodedcommand AAAA"}}},
        {"id": "s1", "source": "so", "timestamp": "2026-06-10T12:00:40Z", "payload": {"@timestamp": "2026-06-10T12:00:40Z", "event": {"id": "s1"}, "source": {"ip": "10.0.1.42"}, "destination": {"ip": "198.51.100.25"}, "suricata": {"eve": {"alert": {"severity": 1, "signature": "ET TROJAN beacon", "category": "trojan"}}}}},
        {"id": "z1", "source": "security_onion", "timestamp": "2026-06-10T12:01:40Z", "payload": {"@timestamp": "2026-06-10T12:01:40Z", "event": {"id": "z1", "dataset": "zeek.dns"}, "message": "dns query", "source.ip": "10.0.1.42", "destination": {"ip": "198.51.100.25"}}},
    ]
    path = tmp_path / "replay.json"
    path.write_text(json.dumps({"events": events}))
    return str(path)


def test_replay_to_incident(spark, replay_file):
    raw = readers.replay(spark, replay_file)
    assert raw.count() == 3
    out = pipeline.run(raw)
    alerts = {r["id"]: r for r in out["alerts"].collect()}
    assert set(alerts) == {"wazuh:w1", "security_onion:s1", "security_onion:z1"}
    assert alerts["wazuh:w1"]["severity"] == "critical" and alerts["security_onion:s1"]["severity"] == "high" and alerts["security_onion:z1"]["src_ip"] == "10.0.1.42"
    scores = {r["id"]: r["score"] for r in triage.score_alerts(out["alerts"]).collect()}
    assert scores["wazuh:w1"] == 9 and scores["security_onion:s1"] == 8
    triaged = out["triage"].collect()
    assert len(triaged) == 1 and triaged[0]["score"] == 10 and triaged[0]["routed_action"] == "page_now"
    assert triaged[0]["candidate_id"].startswith("CAND-20260610-001-")
    incident = out["incidents"].collect()
    assert len(incident) == 1 and incident[0]["incident_id"].startswith("INC-20260610-001-") and incident[0]["alert_count"] == 3
    members = out["members"]
    assert members.count() == 3 and {r["candidate_id"] for r in members.collect()} == {triaged[0]["candidate_id"]}
    text = reports.incident_reports(out["incidents"], members, out["triage"]).first()["markdown"]
    names = ["Report Provenance", "Executive Summary", "Timeline", "Affected Assets", "IOCs", "Attack Narrative", "Remediation", "Detection Gaps", "Triage Decisions", "Enrichment Summary"]
    places = [text.index(f"## {n}\n") for n in names]
    assert places == sorted(places) and "Agent IDs: `007`" in text and "3 alert(s)" in text
    of = out["enrichments"].withColumn("candidate_id", F.lit(triaged[0]["candidate_id"]))
    assert "## Alerts" in reports.candidate_reports(out["triage"], members, of).first()["markdown"]
    assert reports.alert_reports(triage.score_alerts(out["alerts"]), out["enrichments"]).count() == 3
    assert {r["kind"]: r["count"] for r in reports.evidence(members, of).groupBy("kind").count().collect()}["alert"] == 3
    assert queries.incident_context(members).first()["agent_ids"] == ["007"]
    assert queries.reach(out["alerts"], "10.0.1.42", out["incidents"], spark.createDataFrame([("ws-12", "10.0.1.42", "ann", "high", True, 1)], "hostname string, ip string, owner string, criticality string, internet_facing boolean, row int")).first()["asset_criticality"] == "high"
    assert {r["table"]: r["n"] for r in pipeline.summary(out).collect()}["candidates"] == 1


def test_replay_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"source": "martian", "payload": {}}, {"payload": 3}, {"payload": {"k": 1}, "timestamp": "nonsense"}, {"payload": {"k": 2}}]))
    (tmp_path / "b.txt").write_text("no")
    rows = readers.replay(spark, str(tmp_path), strict=False).orderBy("pos").collect()
    assert [bool(r["error"]) for r in rows] == [True, True, True, False] and rows[3]["id"] == "replay-replay-a-0004"
    with pytest.raises(Exception, match="unknown source"):
        readers.replay(spark, str(tmp_path / "a.json")).collect()
    assert [r["file"] for r in readers.skipped_files(spark, str(tmp_path)).collect()] == ["b.txt"]


def test_wazuh_log(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "timestamp": (T0 - timedelta(minutes=i)).isoformat() + "Z", "rule": {"level": i}, "agent": {"id": "1"}}) for i in range(10)]
    (tmp_path / "alerts.json").write_text("\n".join([*lines, "", "{broken", "[1]", '"text"']))
    path = str(tmp_path / "alerts.json")
    rows = readers.wazuh_alerts(spark, path, T0, lookback_minutes=8, least_level=3, limit=4, agents=spark.createDataFrame([("1", "ws")], "agent_id string, name string")).collect()
    assert [r["id"] for r in rows] == ["6", "5", "4", "3"] and rows[0]["agent_context"]["name"] == "ws"
    assert readers.malformed_lines(spark, path).first()["malformed"] == 3


def test_search_responses(spark, tmp_path):
    hits = {"hits": {"hits": [{"_id": "a", "_source": {"@timestamp": "2026-06-10T11:59:00Z", "rule": {"level": 9}, "event": {"severity": 1}}}, 5, {"_source": {"@timestamp": "2026-06-10T11:58:00Z", "rule": {"level": 2}}}]}}
    (tmp_path / "r.json").write_text(json.dumps(hits))
    assert [r["id"] for r in readers.wazuh_indexer(spark, str(tmp_path), T0, 30, least_level=3).collect()] == ["a"]
    so = readers.security_onion(spark, str(tmp_path), T0, 30, least="high").collect()
    assert len(so) == 2  # unknown severity stays
    assert readers.security_onion(spark, str(tmp_path), T0, 30, mirror=True).first()["source"] == "wazuh"


def test_splunk_rows(spark):
    df = spark.createDataFrame([("1781092800", '{"a": 1}', "suricata:alert"), ("2026-06-10T12:00:00Z", "plain", "ossec"), (None, None, "other")], "_time string, _raw string, sourcetype string")
    rows = {r["source"]: r for r in readers.splunk_results(df).collect()}
    assert set(rows) == {"security_onion", "wazuh", "splunk"}
    assert json.loads(rows["security_onion"]["payload_json"])["a"] == 1 and json.loads(rows["security_onion"]["payload_json"])["splunk"]["sourcetype"] == "suricata:alert"
    assert json.loads(rows["wazuh"]["payload_json"])["_raw"] == "plain"


def test_firewall_lines(spark):
    lines = ["Jun 10 12:00:00.123456 rule 3/(match) block in on em0: 10.0.0.5.51234 > 8.8.8.8.53: Flags [S], seq 1", "Jun  9 01:02:03 rule 4/(match) pass out on em1: 10.0.0.5 > 1.1.1.1: icmp: echo request", "not a line"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = readers.pf_lines(df, 2026, "fw").orderBy("event_ts").collect()
    a, b = (json.loads(r["payload_json"]) for r in rows)
    assert (a["protocol"], a.get("src_port"), b["protocol"], b["src_port"], b["dst_port"], b["dst_ip"]) == ("icmp", None, "tcp", 51234, 53, "8.8.8.8")
    assert readers.pf_malformed(df).first()["malformed"] == 1
    alerts = normalize.normalize(readers.pf_lines(df, 2026, "fw")).orderBy("event_ts").collect()
    assert alerts[1]["rule_name"] == "pf block in on em0" and alerts[1]["severity"] == "low" and alerts[1]["rule_groups"] == ["firewall", "pf", "block"]


def test_assets_first_row_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Hostname,IP,criticality,internet_facing,os\nweb.corp.example,10.0.0.1,critical,yes,x\nweb.other.example,10.0.0.2,low,no,x\n,10.0.0.3,high,1,x\ndb,10.0.0.4,Tier-0,,x\n", encoding="utf-8")
    assets = readers.assets(spark, str(tmp_path / "a.csv"))
    assert assets.count() == 3
    rows = spark.createDataFrame([("WEB.corp.example", None), ("web", None), ("nothing", "10.0.0.4"), ("none", None), (None, None)], "host string, ip string")
    got = [r["asset_criticality"] for r in triage.with_assets(rows, assets, "host", F.col("ip"), ("criticality", "internet_facing")).orderBy(F.desc_nulls_last("host")).collect()]
    assert sorted(map(str, got)) == ["None", "None", "critical", "critical", "unknown"]


def greedy(rows, minutes, cap):
    groups, out = [], {}
    for own, ts, names in sorted(rows, key=lambda r: (r[1] or datetime.min, r[0])):
        for g in reversed(groups):
            if len(g["m"]) < cap and (ts is None or g["last"] is None or abs(ts - g["last"]) <= timedelta(minutes=minutes)) and names & g["names"]:
                break
        else:
            g = {"m": [], "last": None, "names": set()}
            groups.append(g)
        g["m"].append(own)
        g["names"] |= names
        if ts:
            g["last"] = max(g["last"] or ts, ts)
        out[own] = g["m"][0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clustering_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(f"a{i:03d}", None if rng.random() < 0.03 * seed else T0 + timedelta(minutes=rng.randrange(600)), {f"user:{rng.randrange(14)}", f"host:{rng.randrange(14)}"}) for i in range(120)]
    df = spark.createDataFrame([(a, t, sorted(n)) for a, t, n in rows], "id string, event_ts timestamp, entities array<string>")
    assert {r["id"]: r["cluster"] for r in cluster.cluster(df, 30, 5).collect()} == greedy(rows, 30, 5)


def test_dedup(spark):
    rows = spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "a"), ("k2", 1, "c")], "dedup_key string, at int, v string")
    assert {(r["dedup_key"], r["v"]) for r in dedup.first_wins(rows, ["dedup_key"], ["at"]).collect()} == {("k1", "a"), ("k2", "c")}
    seen = dedup.marked(rows.where("dedup_key = 'k1'"), T0)
    assert [r["dedup_key"] for r in dedup.unseen(rows, seen, T0 + timedelta(hours=1)).collect()] == ["k2"]
    assert dedup.unseen(rows, seen, T0 + timedelta(hours=25)).count() == 3 and dedup.live(seen, T0 + timedelta(hours=25)).count() == 0
    with pytest.raises(Exception, match="empty"):
        spark.range(1).select(dedup.key("raw", F.lit(" "), F.lit("x"))).collect()


def test_gates_and_lifecycle(spark):
    books = spark.createDataFrame([("p", "pf_block_ip", 9, ["page_now"], True)], "name string, action string, required_confidence int, trigger_actions array<string>, enabled boolean")
    rows = spark.createDataFrame([("t1", "page_now", "llm", 10, "8.8.8.8"), ("t2", "page_now", "llm", 10, "10.0.0.1"), ("t3", "page_now", "local", 10, "8.8.8.8"), ("t4", "page_now", "llm", 8, "8.8.8.8"), ("t5", "queue_review", "llm", 9, "8.8.8.8")], "triage_id string, action string, analysis_source string, score int, target string")
    got = {r["triage_id"]: (r["status"], r["denial_reason"][:6], r["command"]) for r in triage.proposals(rows, books, ("pf_block_ip",)).collect()}
    assert got["t1"][0] == "suggested" and got["t1"][2].endswith("8.8.8.8")
    assert {k: v[1] for k, v in got.items() if v[0] == "denied"} == {"t2": "target", "t3": "triage", "t4": "score "}
    log = spark.createDataFrame([("x", 1, "suggested"), ("x", 2, "approved"), ("x", 3, "executed"), ("y", 1, "suggested"), ("y", 2, "executed")], "proposal_id string, at int, status string")
    assert {r["proposal_id"]: (r["status"], r["valid"]) for r in triage.response_states(log).collect()} == {"x": ("executed", True), "y": ("executed", False)}


def test_provider_verdicts(spark):
    vt = spark.createDataFrame([(5, 0, 0), (1, 0, 9), (0, 0, 3), (0, 0, 0)], "malicious int, suspicious int, harmless int").select(triage.provider_verdict("virustotal", F.struct("*")).alias("v"))
    assert [r["v"] for r in vt.collect()] == ["malicious", "suspicious", "benign", "unknown"]
    ab = spark.createDataFrame([(80, 1, True), (75, 1, False), (25, 1, False), (0, 0, False), (0, 4, False)], "score int, reports int, whitelisted boolean").select(triage.provider_verdict("abuseipdb", F.struct("*")).alias("v"))
    assert [r["v"] for r in ab.collect()] == ["benign", "malicious", "suspicious", "benign", "unknown"]


def test_assistant(spark):
    assert queries.topic("what is the blast radius of 10.0.0.1?") == ("blast_radius", "10.0.0.1")
    assert queries.topic("what is at fe80::1 from?") == ("entity_alerts", "fe80::1") and queries.topic("is anything affected?")[0] == "capabilities"
    assert queries.topic("show the review queue")[0] == "queue" and queries.topic("alerts for ws-12") == ("entity_alerts", "ws-12") and queries.topic("hello")[0] == "capabilities"


def test_upsert_and_batches(spark):
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string"), spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "id string, n int, s string")
    assert {tuple(r) for r in sinks.merged(old, new, "id", ["n"]).collect()} == {("a", 1, "x"), ("b", 9, "y"), ("c", 3, "w")}
    rows = spark.range(250).select(F.col("id"), F.lit(T0).alias("event_ts"), F.lit(5).alias("score"))
    assert [r["count"] for r in sinks.hec_batches(rows, sinks.TRIAGE_FIELDS, "event_ts", ["id"]).groupBy("batch").count().orderBy("batch").collect()] == [100, 100, 50]


def test_routes(spark):
    rows = spark.createDataFrame([("t1", "a", 9, "page_now", "s"), ("t2", "b", 5, "page_now", "s"), ("t3", "c", 1, "mark_likely_benign", "s")], "triage_id string, id string, score int, action string, summary string")
    got = {r["id"]: (r["destination"], r["status"], r["message"]) for r in triage.routed(rows, "id").collect()}
    assert got["a"] == ("page_now", "created", "Routed target a with score 9/10 as page_now to page_now: s")
    assert got["b"] == ("analyst_queue", "queued", "Routed target b with score 5/10 as queue_review to analyst_queue (triage suggested page_now; score policy applied queue_review): s")
    assert got["c"][:2] == ("likely_benign", "marked_likely_benign")
    levels = sinks.notifications(triage.routed(rows, "id")).collect()
    assert [r["level"] for r in levels] == ["critical"]


def test_recorded_answers(spark):
    answers = [("a", '{"score": 2, "action": "escalate", "reasoning": ["x", "y", "z", "w"], "iocs": {"ip": ["1.2.3.4"]}}'), ("b", "nothing"), ("c", '```json\n{"score": 99, "action": " Notify "}\n```'), ("a", "also nothing")]
    local = spark.createDataFrame([(k, 5, "queue_review", "needs_analyst_review", "medium", "local", f"old-{k}") for k in "abc"], "candidate_id string, score int, action string, classification string, fp_likelihood string, analysis_source string, triage_id string")
    got = {r["candidate_id"]: r for r in triage.with_recorded(local, spark.createDataFrame(answers, "target_id string, response string"), "candidate_id").collect()}
    assert (got["a"]["score"], got["a"]["action"], got["a"]["fp_likelihood"], got["a"]["analysis_source"]) == (2, "mark_likely_benign", "unknown", "llm") and got["a"]["summary"].endswith("Reasons: x; y; z")
    assert got["a"]["triage_id"].startswith("triage-") and got["b"]["triage_id"] == "old-b" and got["b"]["analysis_source"] == "local"
    assert (got["c"]["score"], got["c"]["action"]) == (10, "page_now")


def test_agents_relate_candidates(spark):
    row = lambda i, host, agents: (i, T0 + timedelta(minutes=i), T0 + timedelta(minutes=i), host, None, [], [], agents, 9, 1, "page_now")
    names = "candidate_id int, first_seen timestamp, last_seen timestamp, primary_host string, primary_user string, src_ips array<string>, dst_ips array<string>, agent_ids array<string>, score int, alert_count int, action string"
    df = spark.createDataFrame([row(1, "a", ["007"]), row(2, "b", ["007"]), row(3, "c", [])], names).withColumn("candidate_id", F.concat(F.lit("c"), "candidate_id"))
    assert sorted(r["candidate_ids"] for r in cluster.incidents(df).collect()) == [["c1", "c2"], ["c3"]]


def test_ordinals_count_all_groups(spark):
    rows = [(f"g{i}", T0 + timedelta(minutes=37 * (i * 7 % 50)) if i else None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, first_seen timestamp").withColumn("first_at", F.struct("first_seen", "g"))
    got = {r["g"]: int(r["n"].split("-")[2]) for r in cluster.numbered(df, "X", F.col("g"), "n").collect()}
    order = [g for g, t in sorted(rows, key=lambda x: (x[1] or datetime.min, x[0]))]
    assert got == {g: i + 1 for i, g in enumerate(order)}


def test_cases_are_scored_from_their_events(spark):
    names = "case_id string, id string, source string, event_ts timestamp, severity string, rule_name string, hostname string, user string, src_ip string, dst_ip string, command_line string, process_name string, payload_json string, agent_id string"
    row = lambda case, i, minutes, severity: (case, i, "replay", T0 + timedelta(minutes=minutes), severity, "r", "h", "u", None, None, None, None, "{}", None)
    alerts = spark.createDataFrame([row("one", "x", 0, "medium"), row("two", "x", 0, "low"), row("two", "y", 5, "high"), row("split", "x", 0, "low"), row("split", "y", 300, "critical")], names)
    cases = spark.createDataFrame([("one", 3, 5, ["queue_review"], "synthetic"), ("two", 6, 8, ["queue_review"], "synthetic"), ("split", 8, 10, ["page_now"], "synthetic")], "case_id string, score_min int, score_max int, expected_actions array<string>, provenance string")
    got = {r["case_id"]: r for r in evaluate.evaluated_cases(cases, alerts).collect()}
    assert (got["one"]["score"], got["one"]["candidates_scored"]) == (4, 1) and got["two"]["candidates_scored"] == 1 and got["split"]["candidates_scored"] == 2
    assert got["two"]["score"] == 7 and got["split"]["score"] == 9 and all(r["in_band"] and r["agrees"] for r in got.values())
    fixed = lambda a: a.select("case_id").distinct().selectExpr("case_id", "1 as score", "'mark_likely_benign' as action", "1 as candidates_scored")
    assert {r["score"] for r in evaluate.evaluated_cases(cases, alerts, fixed).collect()} == {1}
    with pytest.raises(Exception, match="no events"):
        evaluate.evaluated_cases(cases, alerts.where("case_id != 'one'")).collect()


def test_verdicts(spark):
    queue = spark.createDataFrame([("q1", "a1", "alert", 5, "queue_review", "local", T0), ("q2", "a2", "alert", 6, "queue_review", "local", T0)], "triage_result_id string, target_id string, target_type string, score int, action string, analysis_source string, queued_at timestamp")
    said = lambda own, score: spark.createDataFrame([(own, "too_low", score, None, T0)], "triage_result_id string, verdict string, analyst_score int, notes string, reviewed_at timestamp")
    judged = review.with_verdicts(queue, said("q1", None))
    assert [r["triage_result_id"] for r in review.reviewed(judged).collect()] == ["q1"] and queries.open_queue(judged.withColumnRenamed("triage_result_id", "id")).count() == 1
    assert review.export_records(judged).first()["label_provenance"] == "analyst_reviewed"
    cases, gone = review.labels(judged, spark.createDataFrame([("a1", "r1", "replay", T0, "{}")], "target_id string, id string, source string, event_ts timestamp, payload_json string"))
    case = cases.first()
    assert (case["score_min"], case["score_max"], case["expected_actions"], len(case["events"])) == (6, 10, ["page_now", "queue_review"], 1) and gone.count() == 0
    for own, score in (("q9", None), ("q1", 11)):
        with pytest.raises(Exception, match="queue|between"):
            review.with_verdicts(queue, said(own, score)).collect()


def test_provider_cache(spark):
    snapshot = spark.createDataFrame([("vt", "ip", "8.8.8.8", "benign", [], T0 + timedelta(hours=1)), ("vt", "ip", "1.1.1.1", "benign", [], T0 - timedelta(hours=1))], "provider string, type string, value string, verdict string, factors array<string>, expires_at timestamp")
    fetched = spark.createDataFrame([("vt", "ip", "9.9.9.9", "malicious", ["x"]), ("vt", "ip", "7.7.7.7", None, [])], "provider string, type string, value string, verdict string, factors array<string>")
    assert sorted(r["value"] for r in triage.cache_after(snapshot, fetched, T0).collect()) == ["8.8.8.8", "9.9.9.9"]
    with pytest.raises(Exception, match="does not describe"):
        triage.described(spark.createDataFrame([("t", "c9")], "triage_id string, candidate_id string"), spark.createDataFrame([("c1",)], "candidate_id string")).collect()


def test_saved_search_jobs(spark, tmp_path):
    def saved(name, status):
        (tmp_path / f"{name}.json").write_text(json.dumps(status))
        return str(tmp_path / f"{name}.json")

    results = saved("results", {"results": [{"a": 1}, "x", {"a": 2}]})
    done = saved("done", {"entry": [{"content": {"dispatchState": "DONE", "isDone": True}}]})
    rows = readers.search_job(spark, done, results).orderBy("pos").collect()
    assert [r["usable"] for r in rows] == [True, False, True]
    assert readers.search_job(spark, saved("flag", {"content": {"is_done": "1"}}), results, limit=2).count() == 2
    for name, status in (("failed", {"entry": [{"content": {"dispatchState": "FAILED", "isDone": True}}]}), ("running", {"entry": [{"content": {"dispatchState": "RUNNING", "isDone": False}}]}), ("blank", {})):
        with pytest.raises(Exception, match="search job"):
            readers.search_job(spark, saved(name, status), results).collect()


def test_agent_inventory(spark, tmp_path):
    items = [{"id": "001", "name": "web-1", "ip": "10.0.0.1", "os": {"name": "Debian", "version": "12"}, "status": "active", "group": ["default"]}, {"id": " ", "name": "none"}, "x", {"id": "002"}, {"id": "001", "name": "web-1b"}]
    (tmp_path / "agents.json").write_text(json.dumps({"data": {"affected_items": items}}))
    rows = {r["agent_id"]: r for r in readers.agents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"001", "002"} and rows["001"]["hostname"] == "web-1b" and rows["001"]["ip"] is None and rows["002"]["groups"] == []


def test_provider_factors_and_host_lists(spark):
    vt = spark.createDataFrame([(5, 2, 0, ["Cobalt Strike!", "b", "c", "d"]), (0, 1, 0, None), (0, 0, 4, ["x"])], "malicious int, suspicious int, harmless int, tags array<string>").select(triage.provider_factors("virustotal", F.struct("*")).alias("f"))
    assert [r["f"] for r in vt.collect()] == [["virustotal_malicious", "virustotal_malicious_engines_5", "virustotal_suspicious_engines_2", "virustotal_tag_cobalt_strike", "virustotal_tag_b", "virustotal_tag_c"], ["virustotal_suspicious", "virustotal_suspicious_engines_1"], []]
    ab = spark.createDataFrame([(80, 3, False), (30, 1, False), (0, 0, False)], "score int, reports int, whitelisted boolean").select(triage.provider_factors("abuseipdb", F.struct("*")).alias("f"))
    assert [r["f"] for r in ab.collect()] == [["abuseipdb_high_confidence"], ["abuseipdb_reported_abuse"], []]
    host = spark.createDataFrame([(list(range(40, 10, -1)) + [11], ["CVE-2", "CVE-1", "CVE-2"], None)], "ports array<int>, vulns array<string>, hostnames array<string>").select(triage.host_details(F.struct("*")).alias("h"), triage.provider_factors("shodan", F.struct("*")).alias("f")).first()
    assert tuple(host["h"]) == (list(range(11, 31)), 30, ["CVE-1", "CVE-2"], 2, [], 0) and host["f"] == ["shodan_known_vulns"]
