"""Steps of response proposals: taken, refused and audited as a sequential fold of the log does it."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import lifecycle


def fold(rows):
    state, out = {}, {}
    for p, at, seq, step in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        before = state.get(p, "none")
        after = lifecycle.STEPS.get((before, step), before) if p else before
        state[p] = after
        out[seq] = (before, after, p is not None and (before, step) in lifecycle.STEPS)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_steps_equal_a_fold(spark, parts):
    rng = random.Random(5)
    steps = [s for _, s in lifecycle.STEPS] + ["nonsense", None]
    # a third of all steps are of one proposal, whose share of ranges runs through several partitions
    rows = [(rng.choice(["hot", "hot", *(f"p{i}" for i in range(40)), None]) if rng.random() < 0.6 else "hot", rng.randrange(200), i, rng.choice(steps)) for i in range(900)]
    log = spark.createDataFrame(rows, "proposal_id string, at int, seq int, step string").withColumn("before", F.lit("clash"))
    got = lifecycle.stepped(log, parts=parts)
    assert {r["seq"]: (r["before"], r["after"], r["taken"]) for r in got.collect()} == fold(rows)
    assert {r["taken"] == (r["reason"] is None) for r in got.collect()} == {True}


def test_audit_and_last_states(spark):
    log = [("a", "suggested"), ("a", "approved"), ("a", "executed"), ("a", "rollback_failed"), ("a", "suggested"), ("b", "denied"), ("b", "executed"), ("c", "suggested"), ("c", "executed"), (None, "suggested")]
    rows = [(p, i, i, s) for i, (p, s) in enumerate(log)]
    steps = lifecycle.stepped(spark.createDataFrame(rows, "proposal_id string, at int, seq int, step string"))
    last = {r["proposal_id"]: (r["status"], r["taken"], r["refused"]) for r in lifecycle.current(steps).collect()}
    assert last == {"a": ("executed", 4, 1), "b": ("denied", 1, 1), "c": ("suggested", 1, 1)}
    seen = [(r["seq"], r["stage"], r["status"]) for r in lifecycle.audit(steps).orderBy("seq", "turn").collect()]
    assert [x for x in seen if x[0] in (2, 3)] == [(2, "pre-execution", "approved"), (2, "recorded", "executed"), (3, "pre-execution", "executed"), (3, "recorded", "executed")]
    assert [x for x in seen if x[0] in (6, 8, 9)] == [(6, "refused", "denied"), (8, "refused", "suggested"), (9, "refused", "none")]
    assert steps.where("seq = 8").first()["reason"] == "proposal is suggested and can't be executed"


def test_empty_log(spark):
    assert lifecycle.stepped(spark.createDataFrame([], "proposal_id string, at int, seq int, step string")).count() == 0
