"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from palimpsest.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return out


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat(" ")
    return round(float(value), 6) if isinstance(value, float) else int(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted([tuple(plain(v) for v in r) for r in df.select(*names).collect()], key=repr)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()], key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_streams_end_where_batches_do(spark):
    for stream, batch in (("stream_hysteresis", "hysteresis"),):
        a, b = (sorted(map(tuple, registry.QUERIES[q](spark, DATA).collect())) for q in (stream, batch))
        assert a == b
    last = {}
    for r in registry.QUERIES["stream_feed_state"](spark, DATA).collect():
        if r.key not in last or r.polls > last[r.key].polls:
            last[r.key] = r
    assert sorted(map(tuple, last.values())) == sorted(map(tuple, registry.QUERIES["feed_states"](spark, DATA).collect()))


def test_the_entry_points():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["stream_whole_lines", "stream_hysteresis", "stream_feed_state", "stream_windows"])
def test_what_streams_write_is_in_files_and_not_with_the_driver(spark, name):
    assert registry.QUERIES[name](spark, DATA).inputFiles()


@pytest.mark.parametrize("flags", ["RA", "AR"])
def test_failures_do_not_depend_on_the_order_of_equal_lines(spark, tmp_path, flags):
    rows = [(1, 2, 3, 4, 1.0, 1.0, flag, "O") for flag in flags]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = registry.QUERIES["log_failures"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("https://h3.example.org/p/2", "Connection refused.", 1)]


def test_index_lines_are_rendered_once(spark):
    """What reads the lines reads their text; a filter on it does not make the JSON again."""
    from palimpsest.plans import indexing
    from palimpsest.sources import lines

    plan = lines.cdxj(indexing._cdxj(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan
