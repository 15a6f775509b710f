"""Every registered query of the reference's operators against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from alertloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if not math.isnan(float(v)) else "nan"
    return str(v)


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()) == got


@pytest.mark.skipif(not TABLES, reason="no tables here")
def test_multi_entity_clusters_hold_every_alert(spark):
    got = [r["id"] for r in catalog.QUERIES["cluster_multi_entity"](spark, SF).collect()]
    assert sorted(got) == sorted(r["id"] for r in catalog.alerts(spark, SF).select("id").collect())
