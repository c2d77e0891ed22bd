"""Every registered query agrees with its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from chainloom import catalog_queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and math.isfinite(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_against_sql(name, spark, duck):
    df = catalog_queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog_queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_the_flagship_has_rows(spark):
    assert catalog_queries.flagship(spark, DATA).count() > 0
