"""Enrichment, asset context, scoring, routing, response gates and evaluation as DataFrame steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ioc, net, scoring


def indicators(alerts: DataFrame) -> DataFrame:
    """(id, indicators) of alerts: addresses, host, user, command, process, then what the texts and the payload's own texts hold."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.trim(F.col(c)).alias("value"))
    fields = F.array(*(one(k, c) for k, c in (("ip", "src_ip"), ("ip", "dst_ip"), ("host", "hostname"), ("user", "user"), ("command", "command_line"), ("process", "process_name"))))
    text = F.concat_ws(" ", "rule_name", "command_line", "process_name", "payload_json")
    return alerts.select("id", ioc.dedupe(F.concat(fields, ioc.from_text(text))).alias("indicators"))


def enriched(found: DataFrame, own: str = "id") -> DataFrame:
    """One local enrichment a row for (id, indicators)."""
    each = found.select(F.col(own).alias("target_id"), F.posexplode("indicators").alias("pos", "i")).select("target_id", "pos", "i.type", "i.value")
    each = each.withColumn("risk_factors", ioc.risk_factors(F.col("type"), F.col("value")))
    return each.select("target_id", "pos", "type", "value", "risk_factors", ioc.severity_hint(F.col("risk_factors")).alias("severity_hint"), ioc.confidence(F.col("type")).alias("confidence"), ioc.summary(F.col("type"), F.col("value"), F.col("risk_factors")).alias("summary"), ioc.enrichment_id(F.col("target_id"), F.col("type"), F.col("value")).alias("enrichment_id"))


def boosts(enrichments: DataFrame) -> DataFrame:
    """(target_id, enrichment): what each target's enrichments add, 3 at most."""
    text = F.concat_ws(" ", F.array_join("risk_factors", " "), "summary", "value")
    return enrichments.groupBy("target_id").agg(F.least(F.sum(scoring.enrichment_boost(F.col("severity_hint"), F.col("risk_factors"), text)), F.lit(3)).alias("enrichment"))


VERDICT_HINTS = {"malicious": "high", "suspicious": "medium", "benign": "info", "unknown": "info"}


def provider_verdict(provider: str, d: Column, malicious_at: int = 3, suspicious_at: int = 1) -> Column:
    """The verdict of a provider's recorded answer ``d`` (a struct): an engine count, an abuse score or a host record."""
    if provider == "virustotal":
        return F.when(d["malicious"] >= malicious_at, "malicious").when((d["malicious"] >= suspicious_at) | (d["suspicious"] >= suspicious_at), "suspicious").when((F.coalesce(d["malicious"], F.lit(0)) == 0) & (d["harmless"] > 0), "benign").otherwise("unknown")
    if provider == "abuseipdb":
        return F.when(d["whitelisted"], "benign").when(d["score"] >= 75, "malicious").when(d["score"] >= 25, "suspicious").when((d["score"] == 0) & (d["reports"] == 0), "benign").otherwise("unknown")
    if provider == "shodan":
        return F.when(F.size(d["vulns"]) > 0, "suspicious").otherwise("unknown")
    raise ValueError(f"unknown provider: {provider}")


def provider_factors(provider: str, d: Column) -> Column:
    """The short factors behind an escalating verdict of ``provider_verdict``, an empty list for any other."""
    verdict, none = provider_verdict(provider, d), F.array().cast("array<string>")
    escalates = F.coalesce(verdict.isin("malicious", "suspicious"), F.lit(False))
    if provider == "virustotal":
        counted = lambda c: F.when(d[c] > 0, F.concat(F.lit(f"virustotal_{c}_engines_"), d[c]))
        slug = lambda t: F.concat(F.lit("virustotal_tag_"), F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "_"), "^_|_$", ""), 1, 32))
        tags = F.transform(F.slice(F.coalesce(d["tags"], none), 1, 3), slug)
        said = F.concat(F.array_compact(F.array(F.concat(F.lit("virustotal_"), verdict), counted("malicious"), counted("suspicious"))), tags)
    elif provider == "abuseipdb":
        said = F.array(F.when(verdict == "malicious", "abuseipdb_high_confidence").otherwise("abuseipdb_reported_abuse"))
    else:
        said = F.array(F.lit("shodan_known_vulns"))
    return F.when(escalates, said).otherwise(none)


#: How many items of each list a host record keeps.
HOST_LISTS = {"ports": 20, "vulns": 20, "hostnames": 10}


def host_details(d: Column) -> Column:
    """A host record's lists, sorted, each value once and bounded, beside their whole counts."""
    whole = {c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(d[c], F.array())))) for c in HOST_LISTS}
    return F.struct(*(x for c, n in HOST_LISTS.items() for x in (F.slice(whole[c], 1, n).alias(c), F.size(whole[c]).alias(c[:-1] + "_count"))))


def intel(found: DataFrame, capabilities: DataFrame, snapshot: DataFrame, now: datetime) -> DataFrame:
    """Provider enrichments: indicator x provider that takes its type, answered from a recorded snapshot (provider, type, value, verdict, factors, expires_at).

    Only global addresses are asked for; an expired answer is a miss (null verdict), and only escalating verdicts keep their factors.
    """
    each = found.select(F.col("id").alias("target_id"), F.explode("indicators").alias("i")).select("target_id", "i.type", F.lower("i.value").alias("value")).distinct()
    each = each.where((F.col("type") != "ip") | net.is_global(F.col("value")))
    asked = each.join(F.broadcast(capabilities.select("provider", "type")), "type")  # a dozen rows: providers by type
    answers = snapshot.where(F.col("expires_at") > F.lit(now)).withColumn("value", F.lower("value")).drop("expires_at")
    out = asked.join(answers, ["provider", "type", "value"], "left")
    hint = F.create_map(*(F.lit(x) for kv in VERDICT_HINTS.items() for x in kv))[F.col("verdict")]
    return out.withColumn("severity_hint", hint).withColumn("risk_factors", F.when(F.col("verdict").isin("malicious", "suspicious"), F.col("factors")).otherwise(F.array().cast("array<string>")))


def with_assets(rows: DataFrame, assets: DataFrame, host: str, ip: Column, fields: tuple[str, ...]) -> DataFrame:
    """rows with asset ``fields``: by exact host, else by its first label, else by address; the first inventory row of a key wins.

    Three equi-joins against one row a key; the planner broadcasts an inventory that is small by its statistics.
    """
    def side(key: Column, name: str) -> DataFrame:
        value = F.struct(*fields)
        return assets.select(key.alias(name), "row", value.alias("v")).where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.min_by("v", "row").alias(f"_{name}"))

    full = F.lower(F.trim(F.col("hostname")))
    label = F.substring_index(full, ".", 1)
    out = rows.withColumn("_h", F.lower(F.trim(F.col(host)))).withColumn("_i", F.trim(ip))
    out = out.withColumn("_s", F.substring_index("_h", ".", 1))
    out = out.join(side(full, "k1"), F.col("_h") == F.col("k1"), "left").join(side(label, "k2"), F.col("_s") == F.col("k2"), "left").join(side(F.trim(F.col("ip")), "k3"), F.col("_i") == F.col("k3"), "left")
    best = F.coalesce("_k1", "_k2", "_k3")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(best[f].alias(f"asset_{f}") for f in fields))


def score_alerts(alerts: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Alerts with score, action, classification, fp_likelihood and triage_id."""
    rows = alerts if added is None else alerts.join(added.withColumnRenamed("target_id", "id"), "id", "left")
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None)
    score = scoring.alert_score(get)
    return with_summary(judged(rows.withColumn("score", score), "alert", "id"), F.concat(F.lit("Local triage scored alert "), "id", F.lit(" as "), "score", F.lit("/10 ("), "action", F.lit("): "), F.coalesce(get("rule_name"), F.lit("Unknown rule")), F.lit(" on "), F.coalesce(get("hostname"), F.lit("unknown host")), F.lit(".")))


def with_summary(rows: DataFrame, text: Column) -> DataFrame:
    """Local triage with its one-line summary."""
    return rows.withColumn("summary", text)


def judged(rows: DataFrame, kind: str, own: str) -> DataFrame:
    s = F.col("score")
    out = rows.withColumn("action", scoring.action(s)).withColumn("classification", scoring.classification(s)).withColumn("fp_likelihood", scoring.fp_likelihood(s)).withColumn("analysis_source", F.lit("local"))
    return out.withColumn("triage_id", scoring.triage_id(F.lit(kind), F.col(own), s, F.col("classification")))


def score_candidates(candidates: DataFrame, alerts: DataFrame, clusters: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Candidates scored: the best alert (scored without enrichments), +1 for three detections, +1 for two addresses, +1 for a user, + enrichments + asset."""
    plain = score_alerts(alerts).join(clusters, "id")
    detection = F.coalesce(F.nullif(F.lower(F.trim("rule_name")), F.lit("")), F.col("id"))
    folded = plain.groupBy("cluster").agg(F.max("score").alias("best"), F.countDistinct(detection).alias("detections"))
    rows = candidates.join(folded, "cluster")
    if added is not None:
        rows = rows.join(added.withColumnRenamed("target_id", "candidate_id"), "candidate_id", "left")
    extra = F.when(F.col("detections") >= 3, 1).otherwise(0) + F.when((F.size("src_ips") >= 2) | (F.size("dst_ips") >= 2), 1).otherwise(0) + F.when(F.trim("primary_user") != "", 1).otherwise(0)
    if "enrichment" in rows.columns:
        extra = extra + F.coalesce("enrichment", F.lit(0))
    if "asset_criticality" in rows.columns:
        extra = extra + scoring.asset_boost(F.col("asset_criticality"), F.col("asset_internet_facing"))
    out = judged(rows.withColumn("score", scoring.clamp(F.col("best") + extra)), "incident_candidate", "candidate_id")
    return with_summary(out, F.concat(F.lit("Local triage scored candidate "), "candidate_id", F.lit(" as "), "score", F.lit("/10 ("), "action", F.lit(") with "), "alert_count", F.lit(" alert(s) on "), F.coalesce("primary_host", F.lit("unknown host")), F.lit(".")))


#: Where each action goes, and the first status there.
DESTINATIONS = {"page_now": "page_now", "queue_review": "analyst_queue", "mark_likely_benign": "likely_benign"}
STATUSES = {"page_now": "created", "queue_review": "queued", "mark_likely_benign": "marked_likely_benign"}


def chosen(by: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map."""
    return F.create_map(*(F.lit(x) for kv in by.items() for x in kv))[key]


def routed(triage: DataFrame, target: str, page_at: int = 8, queue_at: int = 4, destinations: dict[str, str] | None = None) -> DataFrame:
    """Routing decisions by score alone; a differing suggestion is named in the message."""
    act = scoring.action(F.col("score"), page_at, queue_at)
    where = chosen(destinations or DESTINATIONS, act)
    summary = F.coalesce("summary", F.lit("")) if "summary" in triage.columns else F.lit("")
    differs = F.when(F.col("action") != act, F.concat(F.lit(" (triage suggested "), F.col("action"), F.lit("; score policy applied "), act, F.lit(")"))).otherwise("")
    message = F.concat(F.lit("Routed target "), F.col(target), F.lit(" with score "), F.col("score"), F.lit("/10 as "), act, F.lit(" to "), where, differs, F.lit(": "), summary)
    own = F.concat(F.lit("route-"), F.substring(F.sha2(F.concat_ws(":", "triage_id", target, act), 256), 1, 12))
    return triage.withColumn("routed_action", act).withColumn("destination", where).withColumn("status", chosen(STATUSES, act)).withColumn("message", message).withColumn("routing_id", own)


def proposals(triage: DataFrame, playbooks: DataFrame, enabled: tuple[str, ...] = (), need_model: bool = True) -> DataFrame:
    """Playbook x triage where the action triggers it; ``denial_reason`` is the first gate that fails, empty if none does. Nothing is executed."""
    books = F.broadcast(playbooks.where("enabled").select("name", F.col("action").alias("response"), "required_confidence", "trigger_actions"))  # a folder of hand-written files
    fits = (F.size("trigger_actions") == 0) | F.array_contains("trigger_actions", F.col("action"))
    rows = triage.join(books, fits)
    on = F.col("response").isin(*enabled) if enabled else F.lit(False)
    reason = F.when(~on, F.concat(F.lit("response capability "), F.col("response"), F.lit(" is not enabled in settings")))
    if need_model:
        reason = reason.when(F.col("analysis_source") != "llm", F.concat(F.lit("triage score was not model-produced (analysis_source="), F.col("analysis_source"), F.lit("); local scoring cannot authorize a response")))
    reason = reason.when(F.col("score") < F.col("required_confidence"), F.concat(F.lit("score "), F.col("score"), F.lit(" is below required confidence "), F.col("required_confidence")))
    reason = reason.when((F.col("response") == "pf_block_ip") & ~net.is_global(F.coalesce("target", F.lit(""))), F.concat(F.lit("target '"), F.coalesce("target", F.lit("")), F.lit("' is not a publicly routable address; blocking internal or reserved space could cut off the network")))
    reason = reason.when(F.trim(F.coalesce("target", F.lit(""))) == "", "target is empty").otherwise("")
    own = F.concat(F.lit("RESP-"), F.substring(F.sha2(F.concat_ws(":", "name", "triage_id", F.coalesce("target", F.lit(""))), 256), 1, 12))
    command = F.when(F.col("response") == "pf_block_ip", F.concat(F.lit("pfctl -t blocked -T add "), F.col("target")))
    undo = F.when(F.col("response") == "pf_block_ip", F.concat(F.lit("pfctl -t blocked -T delete "), F.col("target")))
    return rows.withColumn("denial_reason", reason).withColumn("status", F.when(F.col("denial_reason") == "", "suggested").otherwise("denied")).withColumn("proposal_id", own).withColumn("command", F.when(F.col("denial_reason") == "", command)).withColumn("rollback_command", F.when(F.col("denial_reason") == "", undo))


#: Which states may follow which.
LIFECYCLE = {"suggested": ("approved", "denied"), "approved": ("executed", "failed"), "executed": ("rolled_back",)}


def response_states(log: DataFrame) -> DataFrame:
    """The last state of each proposal of an event log (proposal_id, at, status), and whether each step was allowed."""
    order = Window.partitionBy("proposal_id").orderBy("at")
    allowed = F.lit(False)
    for a, bs in LIFECYCLE.items():
        allowed = allowed | ((F.lag("status").over(order) == a) & F.col("status").isin(*bs))
    first = F.lag("status").over(order).isNull() & F.col("status").isin("suggested", "denied")
    steps = log.withColumn("ok", allowed | first)
    return steps.groupBy("proposal_id").agg(F.max_by("status", "at").alias("status"), F.min("ok").alias("valid"))


def evaluated(cases: DataFrame) -> DataFrame:
    """Cases (case_id, score, action, score_min, score_max, expected_actions) with error and failure flags."""
    s, lo, hi = F.col("score"), F.col("score_min"), F.col("score_max")
    return cases.withColumn("band_error", scoring.band_error(s, lo, hi)).withColumn("in_band", s.between(lo, hi)).withColumn("agrees", F.array_contains("expected_actions", F.col("action"))).withColumn("serious", lo >= 7).withColumn("benign", hi <= 3).withColumn("missed", (lo >= 7) & (s <= 3)).withColumn("noise", (hi <= 3) & (s >= 8))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of rates over evaluated cases; benign_caught is 1 where no case is benign."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    caught = F.avg(F.when(F.col("benign"), (F.col("action") == "mark_likely_benign").cast("int")))
    return rows.agg(F.count(F.lit(1)).alias("cases"), rate("agrees").alias("action_agreement"), rate("in_band").alias("in_band_rate"), F.round(F.avg("band_error"), 4).alias("mean_score_error"), F.round(F.coalesce(caught, F.lit(1.0)), 4).alias("benign_caught"), F.count_if("missed").alias("missed"), F.count_if("noise").alias("noise"))


def failures(summary: DataFrame, most_missed: int = 0, least_caught: float = 0.6, least_agreement: float = 0.7) -> DataFrame:
    """(unmet): one message for each threshold that a summary misses."""
    checks = F.array_compact(F.array(F.when(F.col("missed") > most_missed, F.concat(F.lit("missed true positives "), F.col("missed"))), F.when(F.col("benign_caught") < least_caught, F.concat(F.lit("benign caught "), F.col("benign_caught"))), F.when(F.col("action_agreement") < least_agreement, F.concat(F.lit("action agreement "), F.col("action_agreement")))))
    return summary.select(F.explode(checks).alias("unmet"))


def verdict_band(verdict: Column, score: Column, analyst_score: Column) -> tuple[Column, Column]:
    """The expected band of a reviewed item."""
    low = F.when(analyst_score.isNotNull(), analyst_score - 1).when(verdict == "too_high", 1).when(verdict == "too_low", score + 1).otherwise(score - 1)
    high = F.when(analyst_score.isNotNull(), analyst_score + 1).when(verdict == "too_high", score - 1).when(verdict == "too_low", 10).otherwise(score + 1)
    low, high = scoring.clamp(low), scoring.clamp(high)
    return F.least(low, high), F.greatest(low, high)


#: What recorded answers may call each action.
ACTION_NAMES = {"page_now": ("page_now", "page", "urgent", "notify"), "queue_review": ("queue_review", "queue", "review", "analyst_review"), "mark_likely_benign": ("mark_likely_benign", "likely_benign", "benign", "close")}


def parsed_responses(recorded: DataFrame) -> DataFrame:
    """Recorded model answers (target_id, response) as triage: score, action, classification, fp_likelihood, summary, iocs, evidence, recommended_actions.

    A Markdown fence is stripped. An answer that is no JSON object or has no whole score gives null scores. Scores are clamped to 1..10;
    an action by another name, or none, follows the answer's own score, as does a missing classification; an fp_likelihood
    other than low, medium and high is unknown. The first three reasons join the summary. iocs: a map of lists by kind (a plain list is kind
    ``iocs``). Evidence without a field name is dropped.
    """
    text = F.regexp_replace(F.trim("response"), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")
    rows = recorded.select("target_id", F.try_parse_json(text).alias("doc"))
    ok = F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT")
    get = lambda p, t: F.when(ok, F.try_variant_get("doc", p, t))
    clean = lambda p: F.nullif(F.trim(get(p, "string")), F.lit(""))
    rows = rows.withColumn("score", scoring.clamp(get("$.score", "double").cast("int"))).withColumn("score", F.when(get("$.score", "double").isNotNull(), F.col("score")))
    s, named, likelihood = F.col("score"), F.lower(clean("$.action")), F.lower(clean("$.fp_likelihood"))
    act = F.when(s.isNull(), None)
    for name, words in ACTION_NAMES.items():
        act = act.when(named.isin(*words), name)
    empty = F.array().cast("array<string>")
    reasons = F.coalesce(get("$.reasoning", "array<string>"), empty)
    summary = F.coalesce(clean("$.summary"), F.lit("LLM triage completed without summary."))
    evidence = F.filter(F.coalesce(get("$.evidence", "array<struct<field:string,value:string>>"), F.array().cast("array<struct<field:string,value:string>>")), lambda e: F.trim(e.field) != "")
    iocs = F.coalesce(get("$.iocs", "map<string,array<string>>"), F.when(F.size(F.coalesce(get("$.iocs", "array<string>"), empty)) > 0, F.create_map(F.lit("iocs"), get("$.iocs", "array<string>"))), F.create_map().cast("map<string,array<string>>"))
    return rows.select(
        "target_id", "score", act.otherwise(scoring.action(s)).alias("action"), F.when(s.isNotNull(), F.coalesce(clean("$.classification"), scoring.classification(s))).alias("classification"),
        F.when(likelihood.isin("low", "medium", "high"), likelihood).otherwise("unknown").alias("fp_likelihood"),
        F.when(F.size(reasons) > 0, F.concat(summary, F.lit(" Reasons: "), F.array_join(F.slice(reasons, 1, 3), "; "))).otherwise(summary).alias("summary"),
        iocs.alias("iocs"), evidence.alias("evidence"), F.coalesce(get("$.recommended_actions", "array<string>"), empty).alias("recommended_actions"),
    )


def with_recorded(local: DataFrame, recorded: DataFrame, own: str, kind: str = "incident_candidate") -> DataFrame:
    """Local triage replaced by the recorded model answer where one parsed; of several answers the one whose text sorts first. analysis_source tells which."""
    one = recorded.groupBy("target_id").agg(F.min_by("response", F.struct(F.try_parse_json("response").isNull(), "response")).alias("response"))
    fields = ("score", "action", "classification", "fp_likelihood", "summary")
    answers = parsed_responses(one).where("score is not null").select(F.col("target_id").alias(own), F.struct(*fields).alias("_m"))
    rows = local.join(answers, own, "left")
    there = F.col("_m").isNotNull()
    rows = rows.withColumn("analysis_source", F.when(there, "llm").otherwise(F.col("analysis_source"))).withColumn("triage_id", F.when(there, scoring.triage_id(F.lit(kind), F.col(own), F.col("_m.score"), F.col("_m.classification"))).otherwise(F.col("triage_id")))
    for f in fields:
        rows = rows.withColumn(f, F.when(there, F.col(f"_m.{f}")).otherwise(F.col(f) if f in local.columns else F.lit(None)))
    return rows.drop("_m")


def provenance(enrichments: DataFrame, own: str = "target_id") -> DataFrame:
    """(target, enrichment_providers, enrichment_looked_up_at): the sorted distinct providers and the latest lookup behind each decision."""
    return enrichments.groupBy(own).agg(F.array_sort(F.collect_set(F.nullif(F.trim("provider"), F.lit("")))).alias("enrichment_providers"), F.max("looked_up_at").alias("enrichment_looked_up_at"))


def all_enrichments(local: DataFrame, answered: DataFrame) -> DataFrame:
    """Local enrichments and those answered by providers as one bag (nothing is merged); unanswered questions stay out."""
    columns = ("target_id", "type", "value", "provider", "risk_factors", "severity_hint", "summary")
    have = local if "provider" in local.columns else local.withColumn("provider", F.lit("local"))
    verdict = F.concat_ws(" ", "provider", F.lit("says"), "value", F.lit("is"), "verdict")
    return have.select(*columns).unionByName(answered.where("verdict is not null").withColumn("summary", verdict).select(*columns))


def cache_after(snapshot: DataFrame, fetched: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """The provider cache after a run: live answers, and each fetched one (provider, type, value, verdict, factors) with a new expiry; failed lookups (null verdict) are never cached."""
    new = fetched.where("verdict is not null").withColumn("expires_at", F.lit(now) + F.expr(f"interval {int(hours)} hours"))
    old = snapshot.where(F.col("expires_at") > F.lit(now)).join(new.select("provider", "type", "value"), ["provider", "type", "value"], "left_anti")
    return old.unionByName(new.select(*snapshot.columns))


def described(triage: DataFrame, candidates: DataFrame, own: str = "candidate_id") -> DataFrame:
    """triage as it is; a row whose ``own`` is no candidate's raises when it is read."""
    there = candidates.select(F.col(own).alias("_own")).distinct()
    bad = F.raise_error(F.concat(F.lit("triage result "), "triage_id", F.lit(" does not describe a candidate")))
    rows = triage.join(there, F.col(own) == F.col("_own"), "left")
    return rows.withColumn("triage_id", F.when(F.col("_own").isNull(), bad).otherwise(F.col("triage_id"))).drop("_own")
