"""Markdown reports of alerts, candidates and incidents, and the evidence behind them, as column expressions over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queries import incident_context

HEAD = 12


def _text(c: str, missing: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(missing))


def _code(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _codes(values: Column) -> Column:
    """A list as code, comma-joined; `none recorded` if it is empty."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.array_join(F.transform(values, _code), ", ")).otherwise("`none recorded`")


def _at(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("unknown time"))


def _sections(title: Column, *sections: tuple[str, Column]) -> Column:
    parts = [x for name, body in sections for x in (F.lit(f"## {name}\n\n"), F.coalesce(body, F.lit("None recorded.")), F.lit("\n\n"))]
    return F.concat(F.lit("# "), title, F.lit("\n\n"), *parts, F.lit("Generated from stored data; nothing was executed.\n"))


def _decision() -> Column:
    return F.concat(F.lit("- Score: "), _text("score"), F.lit("/10\n- Action: "), _code(_text("action")), F.lit("\n- Classification: "), _code(_text("classification")), F.lit("\n- False-positive likelihood: "), _code(_text("fp_likelihood")), F.lit("\n- Source: "), _code(_text("analysis_source")))


def _lines(rows: DataFrame, own: str, line: Column, order: list[Column], name: str) -> DataFrame:
    """(own, name): each group's lines in order, joined."""
    return rows.groupBy(own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x.line), "\n").alias(name))


def _alert_line() -> Column:
    return F.concat(F.lit("- "), _at("event_ts"), F.lit(" "), _code(_text("severity")), F.lit(" "), _text("rule_name", "Unknown rule"), F.lit(" on "), _code(_text("hostname", "unknown host")), F.lit(" ("), F.col("id"), F.lit(")"))


def _enrichment_lines(enrichments: DataFrame, own: str) -> DataFrame:
    line = F.concat(F.lit("- "), F.col("type"), F.lit(" "), _code(F.col("value")), F.lit(" ["), _text("severity_hint"), F.lit("]: "), _text("summary", "No enrichment summary."))
    return _lines(enrichments, own, line, [F.col("type"), F.col("value")], "enriched")


def alert_reports(triage: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(id, markdown) of scored alerts and their enrichments (target_id, ...)."""
    rows = triage.join(_enrichment_lines(enrichments, "target_id").withColumnRenamed("target_id", "_t"), F.col("id") == F.col("_t"), "left")
    details = F.concat(_alert_line(), *(F.concat(F.lit(f"\n- {c}: "), _code(_text(c))) for c in ("user", "src_ip", "dst_ip", "process_name", "command_line") if c in triage.columns))
    return rows.select("id", _sections(F.concat(F.lit("Alert Report: "), F.col("id")), ("Executive Summary", F.col("summary")), ("Triage Decision", _decision()), ("Alert Details", details), ("Enrichment Summary", F.col("enriched"))).alias("markdown"))


def candidate_reports(triage: DataFrame, members: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(candidate_id, markdown) of scored candidates, their alerts (candidate_id, ...) and enrichments (candidate_id, ...)."""
    alerts = _lines(members, "candidate_id", _alert_line(), [F.coalesce(F.unix_micros("event_ts"), F.lit(0)).alias("t"), F.col("id")], "alerts")
    rows = triage.join(alerts, "candidate_id", "left").join(_enrichment_lines(enrichments, "candidate_id"), "candidate_id", "left")
    scope = F.concat(F.lit("- Span: "), _at("first_seen"), F.lit(" to "), _at("last_seen"), F.lit("\n- Host: "), _code(_text("primary_host")), F.lit("\n- User: "), _code(_text("primary_user")), F.lit("\n- Sources: "), _codes(F.col("src_ips")), F.lit("\n- Destinations: "), _codes(F.col("dst_ips")))
    routing = F.concat(F.lit("- "), F.col("message")) if "message" in triage.columns else F.lit(None).cast("string")
    return rows.select("candidate_id", _sections(F.concat(F.lit("Incident Candidate Report: "), F.col("candidate_id")), ("Executive Summary", F.col("summary")), ("Triage Decision", _decision()), ("Routing", routing), ("Candidate Scope", scope), ("Alerts", F.col("alerts")), ("Enrichment Summary", F.col("enriched"))).alias("markdown"))


def incident_reports(incidents: DataFrame, members: DataFrame, triage: DataFrame, enrichments: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(incident_id, markdown) of incidents, their alerts (``cluster.members``), and the triage of candidates.

    Sections come in a fixed order; the narrative restates what fired, HEAD alerts at most. ``enrichments``: (candidate_id, ...); ``notes``: (incident_id, notes).
    """
    of = incidents.select("incident_id", F.explode("candidate_ids").alias("candidate_id"))
    order = [F.coalesce(F.unix_micros("event_ts"), F.lit(0)).alias("t"), F.col("id")]
    cells = [_at("event_ts"), _code(F.col("id")), _code(F.col("candidate_id")), _code(_text("severity")), F.replace(_text("rule_name", "Unknown rule"), F.lit("|"), F.lit("\\|")), *(_code(_text(c, "")) for c in ("hostname", "user", "src_ip", "dst_ip"))]
    table = _lines(members, "incident_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), order, "timeline")
    story = F.concat(F.lit("- "), _at("event_ts"), F.lit(": "), _code(_text("rule_name", "Unknown rule")), F.lit(" fired on "), _code(_text("hostname", "unknown host")), F.lit(" for user "), _code(_text("user")))
    told = members.groupBy("incident_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*order, story.alias("line")))), 1, HEAD), lambda x: x.line).alias("story"), F.count(F.lit(1)).alias("alerts"))
    marks = triage.join(of.withColumnRenamed("candidate_id", "_c"), F.col("candidate_id") == F.col("_c"))
    decided = _lines(marks, "incident_id", F.concat(F.lit("- "), _code(F.col("candidate_id")), F.lit(": "), F.col("score").cast("string"), F.lit("/10 "), F.col("action"), F.lit(", "), _text("summary", "no summary")), [-F.col("score"), F.col("candidate_id")], "decided")
    modelled = marks.groupBy("incident_id").agg(F.max(F.col("analysis_source") == "llm").alias("modelled"))
    rows = incidents.join(table, "incident_id", "left").join(told, "incident_id", "left").join(decided, "incident_id", "left").join(modelled, "incident_id", "left").join(incident_context(members), "incident_id", "left")
    if enrichments is not None:
        rows = rows.join(_enrichment_lines(enrichments.join(of.withColumnRenamed("candidate_id", "_e"), F.col("candidate_id") == F.col("_e")), "incident_id"), "incident_id", "left")
    else:
        rows = rows.withColumn("enriched", F.lit(None).cast("string"))
    rows = rows.join(notes, "incident_id", "left") if notes is not None else rows.withColumn("notes", F.lit(None).cast("string"))
    summary = F.concat(F.size("candidate_ids").cast("string"), F.lit(" candidate(s) and "), F.coalesce(F.col("alerts").cast("string"), F.lit("0")), F.lit(" alert(s) between "), _at("first_seen"), F.lit(" and "), _at("last_seen"), F.lit(".\n\n- Maximum triage score: "), _text("max_score"), F.lit("/10\n- Candidates: "), _codes(F.col("candidate_ids")))
    assets = F.concat(F.lit("- Primary host: "), _code(_text("primary_host")), F.lit("\n- Primary user: "), _code(_text("primary_user")), F.lit("\n- Hosts: "), _codes(F.col("hostnames")), F.lit("\n- Users: "), _codes(F.col("users")), F.lit("\n- Agent IDs: "), _codes(F.col("agent_ids")))
    more = F.when(F.col("alerts") > HEAD, F.concat(F.lit("\n- and "), F.col("alerts") - HEAD, F.lit(" further alert(s); see the timeline"))).otherwise("")
    gap = lambda ok, text: F.when(ok, text)
    gaps = F.concat_ws("\n", F.concat(F.lit("- Alerts came only from: "), _codes(F.col("sources"))), gap(F.col("enriched").isNull(), F.lit("- No enrichment is attached.")), gap(~F.coalesce("modelled", F.lit(False)), F.lit("- Every score came from local rules.")), gap(F.size("hosts_without_agent") > 0, F.concat(F.lit("- No agent is recorded for: "), _codes(F.col("hosts_without_agent")))))
    head = F.lit("| Time | Alert ID | Candidate | Severity | Rule | Host | User | Src | Dst |\n|---|---|---|---|---|---|---|---|---|\n")
    text = _sections(
        F.concat(F.lit("Incident Report: "), F.col("incident_id")), ("Report Provenance", F.lit("Written from stored data by fixed templates; no model was asked.")), ("Executive Summary", summary), ("Timeline", F.concat(head, F.col("timeline"))), ("Affected Assets", assets),
        ("IOCs", F.concat(F.lit("- Source addresses: "), _codes(F.col("src_ips")), F.lit("\n- Destination addresses: "), _codes(F.col("dst_ips")))), ("Attack Narrative", F.concat(F.array_join("story", "\n"), more)), ("Remediation", F.when(F.col("max_score") >= 8, "- Confirm the activity and contain the primary host.").otherwise("- Confirm the scope before any containment.")),
        ("Detection Gaps", gaps), ("Analyst Notes", F.col("notes")), ("Triage Decisions", F.col("decided")), ("Enrichment Summary", F.col("enriched")),
    )
    return rows.select("incident_id", text.alias("markdown"))


def evidence(members: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(evidence_id, candidate_id, kind, source, title, description, at) of candidates' alerts and enrichments."""
    own = lambda key, kind: F.concat(F.lit("evidence-"), F.substring(F.sha2(F.concat_ws(":", "candidate_id", key, F.lit(kind)), 256), 1, 12)).alias("evidence_id")
    fired = members.select(own(F.col("id"), "alert"), "candidate_id", F.lit("alert").alias("kind"), F.col("source").alias("source"), _text("rule_name", "Unknown rule").alias("title"), _alert_line().alias("description"), F.col("event_ts").alias("at"))
    provider = F.col("provider") if "provider" in enrichments.columns else F.lit("local")
    known = enrichments.select(own(F.col("value"), "enrichment"), "candidate_id", F.lit("enrichment").alias("kind"), provider.alias("source"), F.concat(F.lit("Enrichment: "), F.col("value")).alias("title"), _text("summary", "No enrichment summary.").alias("description"), F.lit(None).cast("timestamp").alias("at"))
    return fired.unionByName(known).dropDuplicates(["evidence_id"])
