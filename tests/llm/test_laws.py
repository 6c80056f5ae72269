"""The subpackage's queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest.llm import queries
from tests.test_queries import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted([tuple(plain(v) for v in r) for r in df.select(*names).collect()], key=repr)
    found = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()], key=repr)
