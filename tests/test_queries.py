"""Every query with SQL against DuckDB on the smallest tables, where those are present."""

import math
import os
from decimal import Decimal

import pytest

from lexiloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents embeddings pairs eval_pairs translations mono_docs doc_labels test_passages".split()


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    d = catalog.queries()[name](spark, SF)
    cols = sorted(d.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in d.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    at = [list(r.columns).index(c) for c in cols]
    assert rows == sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
