"""Every query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

from orrery.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(columns)
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (dict(zip(columns, r))[c] for c in order)]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)
