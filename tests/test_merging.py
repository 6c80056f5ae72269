"""Chunks of a sorted index, and tables merged when read, against plain versions."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import clusters
from palimpsest.operators.merging import MergeTable


def test_a_lookup_opens_the_chunks_that_have_the_key(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"org,h{rng.randrange(9)})/{rng.randrange(3000):04d}", f"{i:06d}") for i in range(20_000)] + [("org,hot)/", f"{i:06d}") for i in range(1500)]
    table = spark.createDataFrame(rows, "urlkey string, timestamp string").withColumn("value", F.concat_ws(" ", "urlkey", "timestamp", F.lit('{"u": "é"}'))).repartition(8)
    directory = clusters.write(table, f"file://{tmp_path}/idx", size=100)
    chunks = directory.collect()
    assert sum(c.lines for c in chunks) == len(rows) and sum(c.lines < 100 for c in chunks) <= len({c.path for c in chunks})
    want = sorted(f'{k} {t} {{"u": "é"}}' for k, t in rows)
    found = []
    for c in sorted(chunks, key=lambda c: (c.path, c.offset)):
        with open(c.path.removeprefix("file://"), "rb") as f:
            f.seek(c.offset)
            found += gzip.decompress(f.read(c.length)).decode().split("\n")[:-1]
    assert sorted(found) == want
    for key in (rows[0][0], rows[77][0], "org,none", "org,hot)/"):
        got = sorted(r.value for r in clusters.lookup(directory, [key]).collect())
        assert got == [v for v in want if v.split(" ")[0] == key]
        opened = clusters.holding(directory, [key]).collect()
        assert len(opened) <= max(2, len(got) // 100 + 2) and sum(c.length for c in opened) < sum(c.length for c in chunks) * (0.02 if "hot" not in key else 0.2)
    both = [rows[0][0], rows[1][0], rows[0][0]]
    assert sorted(r.value for r in clusters.lookup(directory, both).collect()) == [v for v in want if v.split(" ")[0] in both]
    for prefix in ("", "org,h3)/", rows[5][0], rows[5][0] + "x", "zzz"):
        got = [r.value for r in clusters.first_at_or_after(directory, prefix).collect()]
        assert got == [v for v in want if v.split(" ")[0] >= prefix][:1]
    path = chunks[0].path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(30)
        f.write(b"damage")
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")) if os.path.exists(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")) else None
    with pytest.raises(Exception, match="not what its directory says"):
        clusters.read(directory.where(F.col("path") == chunks[0].path)).count()
    assert clusters.write(table.limit(0), f"file://{tmp_path}/none").count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "site long, url string, capture long, n int")


def test_merged_reads_are_what_a_rebuilt_table_has(spark, tmp_path):
    rng = random.Random(5)
    table = MergeTable(spark, f"file://{tmp_path}/t", ["site", "url"], 4)
    with pytest.raises(ValueError):
        table.read()
    model: dict = {}

    def batch(n):
        keys = {(rng.choice([1, 2, 3, None]), rng.choice([f"u{rng.randrange(25)}", None])) for _ in range(n)}
        return {k: [(*k, rng.randrange(6), j) for j in range(rng.randrange(1, 3))] for k in sorted(keys, key=str)}

    def check():
        assert sorted(map(tuple, table.read().collect()), key=str) == sorted((r for rows in model.values() for r in rows), key=str)

    for step in range(7):
        new = batch([60, 3, 4, 2, 20, 1, 5][step])
        touched = [k for k in list(model)[:2] if k not in new] if step % 2 else []
        table.upsert(rows_of(spark, [r for rows in new.values() for r in rows]), spark.createDataFrame(touched, "site long, url string") if touched else None)
        model |= new
        for k in touched:
            del model[k]
        check()
        if step in (1, 3, 4):
            column, at = ("capture", 2) if step != 3 else ("site", 0)
            value = rng.randrange(1, 4)
            table.drop(column, spark.createDataFrame([(value,), (None,), (value,)], "x long"))
            model = {k: kept for k, rows in model.items() if (kept := [r for r in rows if r[at] != value])}
            check()
        if step in (2, 4):
            assert table.compact() != [] or step == 2
            check()
    before = table.manifest()
    assert table.compact(0) and not table.manifest().deltas and not table.manifest().gone
    check()
    assert table.manifest().version == before.version + 1 and table.compact() == []
    table.upsert(rows_of(spark, []))
    check()


def test_a_write_is_as_large_as_the_change(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ["site", "url"], 8)
    table.upsert(spark.range(20_000).selectExpr("id % 50 AS site", "concat('u', id) AS url", "id AS capture", "1 AS n"))
    table.compact()
    size = lambda: {os.path.join(p, f): os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = size()
    table.upsert(rows_of(spark, [(1, "u1", -1, 2), (1, "new", -1, 2)]))
    table.drop("capture", spark.createDataFrame([(7,)], "x long"))
    after = size()
    assert set(before) <= set(after) and sum(after.values()) - sum(before.values()) < 0.1 * sum(before.values())
    assert table.read().count() == 20_000 and table.read().where("n = 2").count() == 2 and table.compact() == []
    # another writer was first
    m = table.manifest()
    table.upsert(rows_of(spark, [(1, "u1", -1, 3)]))
    m.version += 1
    with pytest.raises(Exception, match="exist"):
        table._publish(m)
    with open(f"{tmp_path}/t/manifests/{m.version + 1:09d}.json", "w") as f:
        f.write('{"version"')  # a writer that failed
    assert table.manifest().version == m.version and table.read().where("n = 3").count() == 1


def test_one_delta_is_taken_without_comparing_versions(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ["site", "url"], 4)
    table.upsert(rows_of(spark, [(1, "a", 1, 1), (2, "b", 1, 1)]))
    table.compact()
    table.upsert(rows_of(spark, [(1, "a", 2, 2)]))
    rows = table.read()
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.n for r in rows.collect()) == [1, 2]
