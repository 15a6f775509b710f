"""Filters of saved search responses: in the search body, in the plan, and again behind a source that returns too much."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, StringStartsWith

from alertloom.sources import pushed, readers

START = datetime(2026, 1, 5, 10, tzinfo=UTC)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "saved"
    at.mkdir()
    for n in range(3):
        found = [{"_id": f"h{n}-{i}", "_source": {"timestamp": (START + timedelta(minutes=10 * i)).isoformat(), "rule": {"level": i}, "n": 1.0}} for i in range(10)]
        found += [{"_source": {"timestamp": START.strftime("%Y-%m-%dT%H:%M:%S.000+0000"), "text": "é", "file": n}}, {"_source": {"timestamp": "yesterday", "rule": {"level": 9}}}, "no object", {"_source": {"rule": {"level": "many"}}}]
        (at / f"page{n}.json").write_text(json.dumps({"hits": {"hits": found}}))
    (at / "none.json").write_text(json.dumps({"took": 1}))
    return str(at)


def test_body():
    clauses = [pushed.clause(f) for f in (GreaterThanOrEqual(("event_ts",), START), GreaterThan(("level",), 3), EqualTo(("level",), 5), EqualTo(("item",), "x"), StringStartsWith(("item",), "x"))]
    assert clauses[3:] == [None, None]
    assert pushed.search_body(clauses[:3], 7) == {
        "query": {"bool": {"filter": [{"range": {"timestamp": {"gte": "2026-01-05T10:00:00+00:00"}}}, {"range": {"rule.level": {"gt": 3}}}, {"term": {"rule.level": 5}}]}},
        "sort": [{"timestamp": {"order": "desc"}}], "size": 7,
    }
    assert pushed.search_body([pushed.clause(GreaterThanOrEqual(("level",), 0))])["query"] == {"bool": {"filter": []}}


@pytest.mark.parametrize("floor", [0, 4])
def test_rows_equal_the_plain_reader(spark, folder, floor):
    since = START + timedelta(minutes=20) if floor else START
    want = readers.wazuh_indexer(spark, folder, since + timedelta(hours=1), 60, floor, None).select("id", "event_ts", "payload_json").collect()
    for applies in (True, False):
        got = pushed.indexer_since(spark, folder, since, floor, None, applies).select("id", "event_ts", "payload_json").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_plan_and_over_returning(spark, folder, capsys):
    rule = F.col("level") >= 5
    rows = pushed.saved_hits(spark, folder).where(rule)
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" in plan and "level" in plan.split("Filter", 1)[1]
    assert len(rows.collect()) == 3 * 6
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 3 * 6  # of 3 * 13: the filter reached the source
    # the source by itself: what it returns before Spark's own filter
    reader = pushed.SavedResponsesReader(folder, True)
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("level",), 5)]))) == 1
    count = lambda r: sum(b.num_rows for p in r.partitions() for b in r.read(p))
    assert count(reader) == 3 * 6
    assert count(pushed.SavedResponsesReader(folder, False)) == 3 * 13
    assert rows.count() == pushed.saved_hits(spark, folder, applies=False).where(rule).count() == 3 * 6


def test_empty_folder(spark, tmp_path):
    assert pushed.indexer_since(spark, str(tmp_path), START).count() == 0
