"""The error channel of a plan: rows that a stage can't handle go aside with the stage and a message, the others go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column by which a stage tells that it can't handle a row: null where it can.
ERROR = "error"


def raw_problem(raw: DataFrame) -> Column:
    """What is wrong with a raw event: its reader's message, no id, or a payload that is no object; null if nothing."""
    told = [F.nullif(F.trim(ERROR), F.lit(""))] if ERROR in raw.columns else []
    no_id = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "raw event has no id")
    no_object = F.when(~F.coalesce(F.ltrim("payload_json").startswith("{"), F.lit(False)), "payload is not an object")
    return F.coalesce(*told, no_id, no_object)


def split(rows: DataFrame, stage: str, own: str, problem: Column | None = None, fail_fast: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows that go on, and (stage, id, message) of those that don't; the second is None if the stage tells of no problem at all.

    ``problem`` is the message or null; without it the stage's own ``error`` column counts. With ``fail_fast`` the first bad row
    that is read ends the job with its message. Neither side has the ``error`` column.
    """
    if problem is None:
        if ERROR not in rows.columns:
            return rows, None
        problem = F.col(ERROR)
    marked = rows.withColumn("_problem", problem)
    bad = F.col("_problem").isNotNull()
    if fail_fast:
        # a filter is never pruned, as a column that nobody reads would be
        told = F.concat(F.lit(f"{stage} failed for "), F.coalesce(F.col(own).cast("string"), F.lit("a row without id")), F.lit(": "), F.col("_problem"))
        good = marked.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    else:
        good = marked.where(~bad)
    errors = marked.where(bad).select(F.lit(stage).alias("stage"), F.col(own).cast("string").alias("id"), F.col("_problem").alias("message"))
    return good.drop("_problem", ERROR), errors


def together(parts: list[DataFrame | None]) -> DataFrame | None:
    """One table of the errors of several stages; None if none of them has a channel."""
    have = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, have) if have else None


def counts(errors: DataFrame) -> DataFrame:
    """How many rows each stage put aside, by message."""
    return errors.groupBy("stage", "message").agg(F.count(F.lit(1)).alias("n"))
