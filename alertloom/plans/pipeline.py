"""The whole batch plan: raw events to alerts, candidates, scores, routes and incidents, every stage a replaceable function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster as clustering
from ..operators import dedup, normalize, quarantine, triage
from ..operators.graph import persisted


@dataclass
class Stages:
    """The stages; replace any with a function of the same shape."""

    normalize: Callable[[DataFrame], DataFrame] = normalize.normalize
    cluster: Callable[[DataFrame], DataFrame] = clustering.cluster
    enrich: Callable[[DataFrame], DataFrame] = lambda alerts: triage.enriched(triage.indicators(alerts))
    score: Callable = triage.score_candidates
    incidents: Callable[[DataFrame], DataFrame] = clustering.incidents


@dataclass
class Config:
    """Thresholds and switches with the defaults of a deployment."""

    page_at: int = 8
    queue_at: int = 4
    incident_score: int = 8
    promote_paged: bool = True
    fail_fast: bool = False
    destinations: dict[str, str] = field(default_factory=lambda: dict(triage.DESTINATIONS))


def run(raw: DataFrame, assets: DataFrame | None = None, recorded: DataFrame | None = None, seen: DataFrame | None = None, now=None, intel: DataFrame | None = None, stages: Stages | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """alerts, clusters, candidates, enrichments, triage (with routes), queue, incidents, members, errors and marks (dedup keys to add, with ``now``) of raw events.

    Raw events without id or payload object, or with a reader's ``error``, go to errors (stage, id, message), and so does every
    row to which a replaced stage gives a message in a column ``error``; all others go on. They get no mark, so they may come
    again. With ``config.fail_fast`` the first of them ends the run.

    ``intel``: answered provider enrichments of alerts (see ``triage.intel``), which count beside the local ones.
    """
    stages, config = stages or Stages(), config or Config()
    raw, unread = quarantine.split(raw, "read", "id", quarantine.raw_problem(raw), config.fail_fast)
    raw = raw.withColumn("dedup_key", dedup.key("raw", F.col("source"), F.col("id")))
    arrival = [c for c in ("file", "pos") if c in raw.columns]  # readers say where an event came from; what arrived first stays
    raw = dedup.first_wins(raw.withColumn("_key_only", F.col("dedup_key")), ["_key_only"], [*arrival, "event_ts", "payload_json"]).drop("_key_only")
    arrived = raw.select(F.col("id").alias("raw_event_id"), F.struct(*arrival, "event_ts", "payload_json").alias("_arrived")).groupBy("raw_event_id").agg(F.min("_arrived").alias("_arrived"))
    if seen is not None:
        raw = dedup.unseen(raw, seen, now)
    alerts = stages.normalize(raw)
    if "raw_event_id" in alerts.columns:
        alerts = alerts.join(arrived, "raw_event_id", "left")
        alerts = dedup.first_wins(alerts.withColumn("_k", F.col("id")), ["_k"], ["_arrived", "event_ts", "payload_json"]).drop("_k", "_arrived")
    else:
        alerts = dedup.first_wins(alerts.withColumn("_k", F.col("id")), ["_k"], ["event_ts", "payload_json"]).drop("_k")
    alerts, unnormalized = quarantine.split(persisted(alerts.withColumn("entities", clustering.entities(alerts))), "normalize", "id", fail_fast=config.fail_fast)
    clusters = persisted(stages.cluster(alerts))
    candidates = persisted(clustering.candidates(alerts, clusters))
    if assets is not None:
        candidates = triage.with_assets(candidates, assets, "primary_host", F.get("src_ips", F.lit(0)), ("hostname", "owner", "criticality", "internet_facing"))
    enrichments = stages.enrich(alerts)
    if intel is not None:
        enrichments = triage.all_enrichments(enrichments, intel).withColumn("pos", F.when(F.col("provider") == "local", 0).otherwise(1))
    # the texts are searched once for the scores and for the result
    enrichments, unenriched = quarantine.split(persisted(enrichments), "enrich", "target_id", fail_fast=config.fail_fast)
    of = clusters.join(candidates.select("cluster", "candidate_id"), "cluster").select(F.col("id").alias("target_id"), "candidate_id")
    provider = [F.col("provider")] if "provider" in enrichments.columns else []
    once = enrichments.join(of, "target_id").groupBy("candidate_id", "type", F.lower("value").alias("_v"), *provider).agg(F.min_by(F.struct("value", "risk_factors", "severity_hint", "summary"), F.struct("target_id", "pos")).alias("e"))
    added = triage.boosts(once.select(F.col("candidate_id").alias("target_id"), "e.*"))
    scored = triage.described(stages.score(candidates, alerts, clusters, added), candidates)
    if recorded is not None:
        scored = triage.with_recorded(scored, recorded, "candidate_id")
    routes, unscored = quarantine.split(persisted(triage.routed(scored, "candidate_id", config.page_at, config.queue_at, config.destinations)), "score", "candidate_id", fail_fast=config.fail_fast)
    queue = routes.where("routed_action = 'queue_review'").select(F.col("candidate_id").alias("id"), "score", F.col("last_seen").alias("queued_at"), F.lit("open").alias("status"))
    incidents = stages.incidents(clustering.promoted(routes, config.incident_score, config.promote_paged))
    out = {"alerts": alerts, "clusters": clusters, "candidates": candidates, "enrichments": enrichments, "triage": routes, "queue": queue, "incidents": incidents}
    out["members"] = clustering.members(incidents, candidates, alerts, clusters)
    out["errors"] = quarantine.together([unread, unnormalized, unenriched, unscored])
    if now is not None:
        out["marks"] = dedup.marked(raw, now)
    return out


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """Rows of every result."""
    from ..operators.queries import table_counts

    return table_counts(results)
