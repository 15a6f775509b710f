"""Sinks: append-only Parquet logs with a latest view, link tables, NDJSON batches, Markdown reports, dry-run notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordinal import batched, ranked

TRIAGE_FIELDS = ("target_id", "target_type", "score", "action", "classification", "fp_likelihood", "analysis_source", "model", "prompt_version", "summary")
INCIDENT_FIELDS = ("id", "candidate_count", "alert_count", "max_score", "primary_host", "primary_user", "first_seen", "last_seen")


def append(rows: DataFrame, path: str, sequence: Column) -> None:
    """Append a version of each row, with the sequence that orders versions (from the input, never the clock)."""
    rows.withColumn("_version", sequence).write.mode("append").parquet(path)


def latest(log: DataFrame, own: str) -> DataFrame:
    """Insert-or-replace as a view: the last version of each key."""
    columns = [c for c in log.columns if c != "_version"]
    return log.groupBy(own).agg(F.max_by(F.struct(*columns), "_version").alias("_row")).select("_row.*")


def merged(old: DataFrame, new: DataFrame, own: str, columns: list[str]) -> DataFrame:
    """Upsert that changes only ``columns`` of rows that exist already."""
    n = new.select(own, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != own), F.lit(True).alias("_has"))
    both = old.withColumn("_had", F.lit(True)).join(n, own, "full_outer")
    pick = lambda c: F.when(F.col("_had").isNull() | (F.col("_has") & F.lit(c in columns)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(F.col(own) if c == own else pick(c) if c in new.columns else F.col(c) for c in old.columns))


def absent(new: DataFrame, old: DataFrame, own: str) -> DataFrame:
    """The rows to insert where nothing has their key."""
    return new.dropDuplicates([own]).join(old.select(own), own, "left_anti")


def links(rows: DataFrame, parent: str, children: str, child: str) -> DataFrame:
    """A link table, each link once with its position."""
    return rows.select(parent, F.posexplode(F.array_distinct(children)).alias("position", child))


def hec_batches(rows: DataFrame, fields: tuple[str, ...], ts: str, order: list[str], per: int = 100, shard: Column | None = None) -> DataFrame:
    """Envelopes of allowlisted fields (event, sourcetype, time in epoch seconds), numbered in batches of ``per`` in ``order``, which must tell rows apart; with ``shard`` batches are numbered within it.

    A shard that holds most rows is no single task: all rows are numbered by (shard, order), and each shard's first number is taken off.
    """
    have = [F.col(f) for f in fields if f in rows.columns]
    envelope = F.to_json(F.struct(F.struct(*have).alias("event"), F.lit("ai_triage").alias("sourcetype"), (F.unix_micros(ts) / 1_000_000).alias("time")))
    rows = rows.select(*order, *([shard.alias("shard")] if shard is not None else []), envelope.alias("envelope"))
    if shard is None:
        return batched(rows, order, per).select(*order, "batch", "envelope")
    numbered = ranked(rows, ["shard", *order], "_number")
    first = numbered.groupBy(F.col("shard").alias("_shard")).agg(F.min("_number").alias("_first"))
    numbered = numbered.join(first, F.col("shard").eqNullSafe(F.col("_shard")))
    return numbered.select(*order, "shard", F.floor((F.col("_number") - F.col("_first")) / per).cast("bigint").alias("batch"), "envelope")


def incident_events(incidents: DataFrame) -> DataFrame:
    """Incidents with the field names of their exported events."""
    return incidents.withColumn("id", F.col("incident_id")).withColumn("candidate_count", F.size("candidate_ids"))


def write_ndjson(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("append").text(path)


def notifications(triage: DataFrame) -> DataFrame:
    """Subject and body of a notification for each paged result; nothing is sent."""
    level = F.when(F.col("score") >= 8, "critical").when(F.col("score") >= 4, "warning").otherwise("info")
    return triage.where("routed_action = 'page_now'").select("triage_id", level.alias("level"), F.concat(F.lit("["), F.upper(level), F.lit("] "), "message").alias("subject"), F.col("message").alias("body"))


def write_reports(markdown: DataFrame, path: str, own: str = "incident_id") -> None:
    """One folder of text for each report."""
    markdown.select(own, F.col("markdown").alias("value")).write.mode("overwrite").partitionBy(own).text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
