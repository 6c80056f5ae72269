"""Lists with ties, nulls, offsets and bounds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import listings

START = datetime(2024, 1, 1)


def test_pages_of_a_list_fit_together_whatever_the_ties(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else START + timedelta(days=rng.randrange(4)), rng.choice(["pending", "captured"])) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, ts timestamp_ntz, status string").repartition(5)
    want = [i for i, t, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[0]), reverse=True)]
    got = [(r.place, r.id) for n in range(0, 230, 23) for r in listings.newest(table, 23, n).orderBy("place").collect()]
    assert got == list(enumerate(want, 1))
    waiting = listings.pending(table.withColumnRenamed("ts", "published"), 60).orderBy("place").collect()
    assert [r.id for r in waiting] == [i for i, t, s in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or START).timestamp(), r[0])) if s == "pending"][:60]
    assert listings.newest(table.limit(0), 5).count() == 0


def test_moments_at_the_bounds(spark):
    now = "2024-03-01 12:00:00"
    at = datetime.fromisoformat(now)
    moments = [at - timedelta(days=1), at, at + timedelta(days=21), at + timedelta(days=21, seconds=1), None, at + timedelta(days=3)]
    profiles = spark.createDataFrame(list(enumerate(moments)), "id long, expires_at timestamp_ntz")
    assert [(r.id, r.expired) for r in listings.expiring(profiles, now).orderBy("place").collect()] == [(0, True), (1, True), (5, False), (2, False)]
    gone = spark.createDataFrame([(0, at - timedelta(days=10, seconds=1)), (1, at - timedelta(days=9, seconds=86399)), (2, at - timedelta(days=99)), (3, None)], "id long, deleted_at timestamp_ntz")
    assert sorted((r.id, r.days_left) for r in listings.trash(gone, now, 30).collect()) == [(0, 20), (1, 21), (2, 0)]
    sites = spark.createDataFrame([(i, "t", s) for i, s in enumerate(["gone", "live", "moved", "unreachable", None] * 5)], "id long, title string, state string")
    assert [r.id for r in listings.vanished(sites).orderBy("place").collect()] == [i for i in range(25) if i % 5 in (0, 2, 3)][:10]


def test_batches(spark):
    rows = spark.range(237).select((F.col("id") % 2).alias("k"), "id")
    sizes = sorted(tuple(r) for r in listings.batches(rows, "k", [F.asc("id")]).groupBy("k", "batch").count().collect())
    assert sizes == [(0, 0, 50), (0, 1, 50), (0, 2, 19), (1, 0, 50), (1, 1, 50), (1, 2, 18)]
