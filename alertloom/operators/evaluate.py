"""Labelled cases scored from their own events, all cases in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster as clustering
from . import triage
from .graph import persisted


def _own(case: Column, value: Column) -> Column:
    """A key that no two cases share."""
    return F.concat(F.col("case_id"), F.lit("\x1f"), value)


def case_scores(alerts: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = lambda a: triage.enriched(triage.indicators(a)), minutes: int = clustering.WINDOW_MINUTES, cap: int = clustering.CAP) -> DataFrame:
    """(case_id, score, action, candidates_scored) of normalised alerts with a ``case_id``.

    A case of one alert is scored as an alert. The alerts of any other are clustered, within the case, and its score is the highest of
    its candidates (the first of equals in order of creation): a label says what the whole incident deserves. More than one candidate
    means that the case fell apart, and ``candidates_scored`` shows it. Ids may repeat over cases.
    """
    rows = alerts.withColumn("id", _own(F.col("case_id"), F.col("id")))
    sizes = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(sizes, "case_id")
    single, several = rows.where("_n = 1").drop("_n"), rows.where("_n > 1").drop("_n")
    added = lambda a: None if enrich is None else triage.boosts(enrich(a))
    alone = triage.score_alerts(single, added(single)).select("case_id", "score", "action", F.lit(1).cast("bigint").alias("candidates_scored"))
    # an entity of another case is another entity
    apart = several.withColumn("entities", F.transform(clustering.entities(several), lambda e: F.concat(F.col("case_id"), F.lit("\x1f"), e)))
    clusters = persisted(clustering.cluster(apart, minutes, cap))
    candidates = clustering.candidates(apart, clusters)
    extra = None
    if enrich is not None:
        of = clusters.join(candidates.select("cluster", "candidate_id"), "cluster").select(F.col("id").alias("target_id"), "candidate_id")
        found = enrich(several).join(of, "target_id")
        once = found.groupBy("candidate_id", "type", F.lower("value").alias("_v")).agg(F.min_by(F.struct("value", "risk_factors", "severity_hint", "summary"), F.struct("target_id", "pos")).alias("e"))
        extra = triage.boosts(once.select(F.col("candidate_id").alias("target_id"), "e.*"))
    scored = triage.score_candidates(candidates, several, clusters, extra)
    case = F.substring_index("cluster", "\x1f", 1).alias("case_id")
    best = scored.groupBy(case).agg(F.min_by(F.struct("score", "action"), F.struct(-F.col("score"), "first_at")).alias("_b"), F.count(F.lit(1)).alias("candidates_scored"))
    return alone.unionByName(best.select("case_id", "_b.score", "_b.action", "candidates_scored"))


def evaluated_cases(cases: DataFrame, alerts: DataFrame, scorer: Callable[[DataFrame], DataFrame] = case_scores) -> DataFrame:
    """Labelled cases with their scores and failure flags; ``scorer`` may be replaced. A case without a score raises when it is read."""
    scores = scorer(alerts).withColumnRenamed("case_id", "_case")
    rows = cases.join(scores, F.col("case_id") == F.col("_case"), "left")
    missing = F.raise_error(F.concat(F.lit("labelled case yielded no events: "), "case_id"))
    rows = rows.withColumn("score", F.when(F.col("_case").isNull(), missing).otherwise(F.col("score"))).drop("_case")
    return triage.evaluated(rows)


def split_cases(evaluated: DataFrame) -> DataFrame:
    """Cases that fell apart into several candidates."""
    return evaluated.where("candidates_scored > 1").select("case_id", "candidates_scored")


def provenance_counts(evaluated: DataFrame) -> DataFrame:
    """Cases by who labelled them."""
    return evaluated.groupBy("provenance").agg(F.count(F.lit(1)).alias("cases"))
