"""The lifecycle of response proposals as a state machine over an event log: each step is taken or refused, and every act has an audit row before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import persisted

#: The states of a proposal (the first: not there yet), and where a step leads from a state.
STATES = ("none", "suggested", "approved", "denied", "executed", "failed", "rolled_back")
STEPS = {
    ("none", "suggested"): "suggested", ("none", "denied"): "denied", ("suggested", "approved"): "approved", ("suggested", "denied"): "denied",
    ("approved", "executed"): "executed", ("approved", "failed"): "failed", ("executed", "rolled_back"): "rolled_back", ("executed", "rollback_failed"): "executed",
}
#: Steps that act on a system, so that a row must be on record before them.
ACTS = ("executed", "failed", "rolled_back", "rollback_failed")


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a range: its first and last proposal, and the state that its steps of the last one lead to from each state."""
    part = first = last = ends = None
    for rows in batches:
        for p, key, step in zip(rows["_part"], rows["proposal_id"], rows["step"], strict=True):
            if p != part:
                if part is not None:
                    yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "ends": [list(ends)]})
                part, first, last, ends = p, key, key, STATES
            elif key != last:
                last, ends = key, STATES
            ends = tuple(STEPS.get((s, step), s) for s in ends)
    if part is not None:
        yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "ends": [list(ends)]})


def _carried(shares: list) -> dict[int, str]:
    """The state in which each range finds its first proposal."""
    out, key, state, any_before = {}, None, "none", False
    for r in sorted(shares, key=lambda r: r["part"]):
        out[r["part"]] = state if any_before and r["first"] == key else "none"
        begins = out[r["part"]] if r["first"] == r["last"] else "none"
        key, state, any_before = r["last"], r["ends"][STATES.index(begins)], True
    return out


def stepped(log: DataFrame, own: str = "seq", parts: int | None = None) -> DataFrame:
    """``log`` (proposal_id, at, step, ``own``, any others) with ``before``, ``after``, ``taken`` and ``reason`` of each step, in order of (at, ``own``).

    A step that its state doesn't allow is refused: it leaves the state and has a reason. A failed rollback leaves its proposal
    executed. Rows with a null or empty proposal_id or with an unknown or null step are refused with a reason of their own; rows that tie in all of
    (proposal_id, at, ``own``) are taken as they come. The log is range-partitioned by (proposal, time), so a proposal with most steps is
    dealt to many tasks: what a range does to the state is a map from states to states, and one such map a range, of its last
    proposal, is all that the driver joins up.
    """
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["proposal_id", "at", own]
    columns = [c for c in log.columns if c not in ("before", "after", "taken", "reason")]
    placed = persisted(log.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    key = F.coalesce(F.col("proposal_id").cast("string"), F.lit(""))
    walked = placed.select("_part", key.alias("proposal_id"), F.coalesce("step", F.lit("")).alias("step"))
    carried = _carried(walked.mapInPandas(_shares, "part int, first string, last string, ends array<string>").collect())  # a row a range

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, state = None, None, "none"
        for rows in batches:
            before, after = [], []
            for p, k, step in zip(rows["_part"], rows["proposal_id"].fillna("").astype(str), rows["step"].fillna(""), strict=True):
                if p != part:
                    part, last, state = p, k, carried[p]
                elif k != last:
                    last, state = k, "none"
                before.append(state)
                state = STEPS.get((state, step), state) if k else state
                after.append(state)
            yield rows[["_row"]].assign(before=before, after=after)

    # only the keys pass Python; the rest of a row meets its states again by its place
    numbered = persisted(placed.withColumn("_row", F.monotonically_increasing_id()))
    states = numbered.select("_part", "_row", F.col("proposal_id").cast("string").alias("proposal_id"), "step").mapInPandas(walk, "_row long, before string, after string")
    known = sorted({s for _, s in STEPS})
    legal = F.concat_ws(">", "before", "step").isin(*(f"{a}>{s}" for a, s in STEPS))
    reason = F.when(F.coalesce(F.col("proposal_id").cast("string"), F.lit("")) == "", "the step names no proposal").when(F.col("step").isNull() | ~F.col("step").isin(*known), F.concat(F.lit("unknown step: "), F.coalesce("step", F.lit("")))).when(~legal, F.concat(F.lit("proposal is "), "before", F.lit(" and can't be "), "step"))
    return numbered.join(states, "_row").withColumn("reason", reason).select(*columns, "before", "after", F.col("reason").isNull().alias("taken"), "reason")


def audit(steps: DataFrame, own: str = "seq") -> DataFrame:
    """Audit rows (proposal_id, at, ``own``, stage, status, step, reason) of ``stepped`` rows, a row a stage, ``turn`` ordering those of a step.

    A step that acts has a row of stage ``pre-execution``, with the state before, ahead of the one with its outcome; a refused step has one row and acts on nothing.
    """
    acts = F.col("taken") & F.col("step").isin(*ACTS)
    row = lambda turn, stage, status: F.struct(F.lit(turn).alias("turn"), F.lit(stage).alias("stage"), F.col(status).alias("status"))
    outcome = F.when(F.col("taken"), row(1, "recorded", "after")).otherwise(row(1, "refused", "before"))
    rows = F.when(acts, F.array(row(0, "pre-execution", "before"), outcome)).otherwise(F.array(outcome))
    return steps.select("proposal_id", "at", own, "step", "reason", F.explode(rows).alias("_r")).select("proposal_id", "at", own, "_r.turn", "_r.stage", "_r.status", "step", "reason")


def current(steps: DataFrame, own: str = "seq") -> DataFrame:
    """The last state of each proposal, and how many of its steps were taken and refused; steps without a proposal are left out."""
    return steps.where("proposal_id is not null").groupBy("proposal_id").agg(F.max_by("after", F.struct("at", own)).alias("status"), F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("refused"))
