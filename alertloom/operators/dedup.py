"""Deduplication by key: first arrival wins, keys live for a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(kind: str, source: Column, own: Column) -> Column:
    """kind:source:id, trimmed; a blank part raises."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c)).otherwise(F.raise_error(F.lit("dedup key part is empty")))
    return F.concat_ws(":", F.lit(kind), part(source), part(own))


def fingerprint(payload_json: Column) -> Column:
    """Key of a payload's content."""
    return F.concat(F.lit("payload:"), F.sha2(payload_json, 256))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregation that combines before it shuffles."""
    columns = rows.columns
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def unseen(rows: DataFrame, seen: DataFrame, now: datetime) -> DataFrame:
    """Rows whose ``dedup_key`` is not in ``seen`` (dedup_key, expires_at) or is there expired."""
    return rows.join(seen.where(F.col("expires_at") > F.lit(now)).select("dedup_key"), "dedup_key", "left_anti")


def marked(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """The keys to add after a batch, with their expiry; made before normalisation, so a row that fails there stays marked."""
    return rows.select("dedup_key").distinct().withColumn("expires_at", F.lit(now) + F.expr(f"interval {int(hours)} hours"))


def live(seen: DataFrame, now: datetime) -> DataFrame:
    """Keys that are not expired, the latest expiry of each."""
    return seen.groupBy("dedup_key").agg(F.max("expires_at").alias("expires_at")).where(F.col("expires_at") > F.lit(now))
