"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from kinlake.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == plain(db.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall())
