"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from scansmith import catalog as C
from scansmith.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer orders documents pages".split()


def rows(names, data):
    fix = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(sorted(zip(names, map(fix, r), strict=True))) for r in data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    out = QUERIES[name](spark, FOLDER)
    found = con.execute(ORACLE[name])
    assert rows(out.columns, map(tuple, out.collect())) == rows([d[0] for d in found.description], found.fetchall())


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == {"obfuscated_scan", "ast_endpoints", "ast_scan"}  # none is expressible in SQL


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_whole_rollups_hold_every_category(spark):
    import __spark_entry__

    found = {r["category"]: r["count"] for r in QUERIES["findings_first_wins"](spark, FOLDER).groupBy("category").count().collect()}
    assert set(found) == set(C.CATEGORIES)
    assert dict(map(tuple, QUERIES["category_totals"](spark, FOLDER).collect())) == found | {"total": sum(found.values())}
    rows = __spark_entry__.entry(spark).collect()
    assert {r["category"]: r["n"] for r in rows} == found
    assert "Critical" in {r["risk"] for r in rows}
