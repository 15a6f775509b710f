"""Analyst review: verdicts on queued results, their export, and the labelled cases that they become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .triage import verdict_band

#: Fixed value: how a label that a person gave is marked.
PROVENANCE = "analyst_reviewed"


def with_verdicts(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queue items with the last verdict on each (triage_result_id, verdict, analyst_score, notes, reviewed_at).

    A verdict on a result that is not queued, or with a score outside 1..10, raises when the rows are read.
    """
    last = verdicts.groupBy("triage_result_id").agg(F.max_by(F.struct("verdict", "analyst_score", "notes", "reviewed_at"), F.struct("reviewed_at", "verdict")).alias("_v"))
    score = F.col("_v.analyst_score")
    rows = queue.withColumn("_queued", F.lit(True)).join(last, "triage_result_id", "full_outer")
    bad = F.when(F.col("_queued").isNull(), F.concat("triage_result_id", F.lit(" is not in the review queue"))).when(~score.between(1, 10), F.lit("analyst_score must be between 1 and 10"))
    own = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("triage_result_id")).alias("triage_result_id")
    status = F.when(F.col("_v").isNotNull(), "reviewed").otherwise("open").alias("status")
    return rows.select(own, *(c for c in queue.columns if c not in ("triage_result_id", "status")), status, F.col("_v.verdict").alias("analyst_verdict"), score.alias("analyst_score"), F.col("_v.notes").alias("notes"), F.col("_v.reviewed_at").alias("reviewed_at"))


def reviewed(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Judged items, newest first."""
    rows = queue.where("reviewed_at is not null").orderBy(F.desc("reviewed_at"), "triage_result_id")
    return rows if limit is None else rows.limit(limit)


def export_records(queue: DataFrame) -> DataFrame:
    """One exported record a judged item, marked as a person's label."""
    mark = F.lit(PROVENANCE)
    return reviewed(queue).select(mark.alias("label_provenance"), mark.alias("provenance"), "triage_result_id", "target_id", "target_type", F.col("score").alias("triage_score"), F.col("action").alias("triage_action"), "analysis_source", "analyst_verdict", "analyst_score", "notes", "queued_at", "reviewed_at")


def write_export(queue: DataFrame, path: str) -> None:
    """The export as JSON lines; a folder without records is written too."""
    export_records(queue).write.mode("overwrite").json(path)


def labels(queue: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled cases with the events to replay, skipped items): of judged items and the raw events of their targets (target_id, id, source, event_ts, payload_json).

    The band comes from the analyst's score, else from the verdict's direction; expected actions from both ends of the band. An item
    whose events are gone can't be replayed: it is skipped.
    """
    event = F.struct("id", "source", "event_ts", "payload_json")
    events = raw.groupBy("target_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    items = queue.where("reviewed_at is not null")
    low, high = verdict_band(F.col("analyst_verdict"), F.col("score"), F.col("analyst_score"))
    verdict = F.coalesce("analyst_verdict", F.lit("unknown"))
    note = F.concat(F.lit("Analyst recorded '"), verdict, F.lit("' for a triage score of "), F.col("score"), F.lit(" without further notes."))
    slug = F.coalesce(F.nullif(F.trim(F.regexp_replace("triage_result_id", r"[^\p{L}\p{N}_-]", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))
    cases = items.join(events, "target_id").withColumn("score_min", low.cast("int")).withColumn("score_max", high.cast("int"))
    actions = F.array_sort(F.array_distinct(F.array(scoring.action(F.col("score_min")), scoring.action(F.col("score_max")))))
    cases = cases.select(
        F.concat(F.lit("review-"), slug).alias("case_id"), F.lit(PROVENANCE).alias("provenance"), "score_min", "score_max", actions.alias("expected_actions"),
        F.coalesce(F.nullif(F.trim("notes"), F.lit("")), note).alias("rationale"), verdict.alias("source_verdict"), F.col("score").alias("source_triage_score"), F.col("analyst_score").alias("source_analyst_score"), F.col("triage_result_id").alias("source_triage_result_id"), "events",
    )
    return cases, items.join(events, "target_id", "left_anti")
