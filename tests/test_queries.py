"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from curaspark import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6))


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(round(v, 4) if isinstance(v, float) else v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = db.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    left, right = in_order([tuple(r[c] for c in columns) for r in got.collect()]), in_order([tuple(r[c] for c in columns) for r in expected])
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert all(same(a, b) for a, b in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
