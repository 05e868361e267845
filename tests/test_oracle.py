"""Every bound query against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import inkwell.plans.ledger_bindings  # noqa: F401
import inkwell.plans.reader_bindings  # noqa: F401
from inkwell.plans.bindings import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return repr(tuple(float(v) if isinstance(v, Decimal) else None if v != v else v for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(plain(r) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(plain(r) for r in expected)
