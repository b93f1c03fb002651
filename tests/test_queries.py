"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.oracle_sql()[name])
    assert got == rows([x[0] for x in cur.description], cur.fetchall())


def test_wrong_signatures_do_not_hold(spark, monkeypatch):
    right = registry.web.signature_column
    monkeypatch.setattr(registry.web, "signature_column", lambda secret: right("another secret"))
    assert registry.queries()["webhook_signature"](spark, DATA).count() == 0
