"""Streams with state maps against plain loops, however the input is cut into micro-batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import keyed, machines, tails

_count = itertools.count()


def streamed(spark, tmp_path, batches, schema, build):
    """Rows that a stream writes for a list of batches of rows, one micro-batch each."""
    here = tmp_path / f"s{next(_count)}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{here}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{here}/in")
    run = build(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{here}/cp").trigger(availableNow=True).start(f"file://{here}/out")
    run.awaitTermination()
    return spark.read.parquet(f"file://{here}/out").collect()


def cut(rng, rows, n):
    at = sorted(rng.randrange(len(rows) + 1) for _ in range(n - 1))
    return [p for p in (rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)) if p]


ENTRIES = "feed string, poll long, place long, guid string, canonical string, content_hash string, updated long, baseline boolean"
KNOWN = "feed string, guid string, canonical string, status string, content_hash string, updated long"


@pytest.mark.parametrize("seed", range(2))
def test_items_are_merged_alike_however_polls_are_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    known = [("a", f"k{i}", f"u{i}" if i else None, rng.choice(["captured", "skipped"]), rng.choice([None, "h1"]), rng.choice([None, 5])) for i in range(4)]
    entries = []
    for poll in range(1, 5):
        for feed in ("a", "b"):
            for place, n in enumerate(rng.sample(range(12), 5)):
                entries.append((feed, poll, place, rng.choice([f"k{n}", f"g{n}.{poll}"]), rng.choice([f"u{n}", f"u{n}", None]), rng.choice([None, "h1", "h2", ""]), rng.choice([None, poll, 9 - poll]), poll == 1))
    items: dict = {}
    for feed, guid, *rest in known:
        items[feed, guid] = rest
    by_url = {(f, i[0]): g for (f, g), i in sorted(items.items(), reverse=True) if i[0] is not None}
    for feed, _, _, guid, canonical, digest, updated, baseline in entries:
        at = guid if (feed, guid) in items else by_url.get((feed, canonical)) if canonical is not None else None
        if at is None:
            items[feed, guid] = [canonical, "skipped" if baseline else "pending", digest, updated]
            if canonical is not None:
                by_url[feed, canonical] = guid
            continue
        item = items[feed, at]
        if digest and item[2] and digest != item[2]:
            item[1] = "pending"
        item[2] = digest or item[2]
        item[3] = max((x for x in (item[3], updated) if x is not None), default=None)
    for parts in (1, 4):
        rows = streamed(spark, tmp_path, cut(rng, entries, parts), ENTRIES, lambda s: keyed.merged_items(s, spark.createDataFrame(known, KNOWN)))
        assert len(rows) == len(entries)
        last = {}
        for r in sorted(rows, key=lambda r: (r.poll, r.place)):
            last[r.feed, r.guid] = [r.canonical, r.status, r.content_hash, r.updated]
        assert last == {k: v for k, v in items.items() if k in last} and set(items) - set(last) <= {(f, g) for f, g, *_ in known}


def test_a_key_of_items_has_many_feeds(spark, tmp_path):
    """There are fewer entries of state than items."""
    entries = [(f"f{n % 2000}", 1, n, f"g{n}", f"u{n}", "h", n, False) for n in range(150_000)]
    spark.createDataFrame(entries, ENTRIES).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    run = keyed.merged_items(spark.readStream.schema(ENTRIES).parquet(f"file://{tmp_path}/in")).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    run.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.where("action = 'new' AND feed = concat('f', place % 2000) AND guid = concat('g', place) AND updated = place").select("guid").distinct().count() == got.count() == 150_000
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress) < 150_000


def test_one_poll_merges_as_in_batch(spark, tmp_path):
    rng = random.Random(3)
    known = [("a", f"k{i}", f"u{i}", "captured", f"h{i % 2}", i) for i in range(6)]
    entries = [("a", 1, n, f"k{n}" if n % 2 else f"new{n}", f"u{n}", f"h{n % 3}", n + 1, False) for n in range(12)]
    batch = machines.merge_items(spark.createDataFrame(known, KNOWN), spark.createDataFrame(entries, ENTRIES), False)
    want = {r.guid: (r.canonical, r.status, r.content_hash, r.updated) for r in batch.collect()}
    rows = streamed(spark, tmp_path, cut(rng, entries, 3), ENTRIES, lambda s: keyed.merged_items(s, spark.createDataFrame(known, KNOWN)))
    assert {r.guid: (r.canonical, r.status, r.content_hash, r.updated) for r in rows} == want


@pytest.mark.parametrize("parts", [1, 5])
def test_readers_get_what_is_kept(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows, kept, want, at = [], {}, [], 0
    for i in range(1, 120):
        job, at = rng.choice("xy"), at + 1
        if rng.random() < 0.8:
            kept.setdefault(job, []).append((i, f"d{i}"))
            kept[job] = kept[job][-7:]
            rows.append((job, at, "event", i, f"d{i}"))
        else:
            seen = rng.randrange(max(1, i - 20), i + 1)
            rows.append((job, at, "read", seen, f"r{i}"))
            held = kept.get(job, [])
            oldest = held[0][0] if held else None
            later = [e for e in held if e[0] > seen] or [(None, None)]
            want += [(job, f"r{i}", a, b, oldest, bool(held) and oldest > seen + 1) for a, b in later]
    got = streamed(spark, tmp_path, cut(rng, rows, parts), "job string, at long, kind string, id long, data string", lambda s: keyed.buffered(s.withColumn("ts", F.timestamp_seconds("at")), 7))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(w[5] for w in want)


def test_events_that_nobody_can_read_are_no_state(spark, tmp_path):
    schema = "job string, at long, kind string, id long, data string"
    rows = [*(("x", n, "event", n, None) for n in range(1, 20001)), ("x", 9000, "read", 8990, "early"), ("x", 20001, "read", 0, "late")]
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = keyed.buffered(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in").withColumn("ts", F.timestamp_seconds("at")), 7)
    run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    run.awaitTermination()
    got = sorted((r.reader, r.id, r.oldest) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    early = 9000 if any(g[1] == 9000 for g in got) else 8999  # an event and a read at one place come as they come
    assert got == [*(("early", n, early - 6) for n in range(early - 6, early + 1)), *(("late", n, 19994) for n in range(19994, 20001))]
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress) < 20


def test_a_finished_job_is_forgotten(spark, tmp_path):
    rows = [[("x", 1, "event", 1, "a"), ("x", 2, "finished", 0, None)], [("x", 3, "read", 0, "q")], [("y", 300, "event", 2, "b")], [("y", 301, "event", 3, "b")], [("x", 302, "read", 0, "r")]]
    got = streamed(spark, tmp_path, rows, "job string, at long, kind string, id long, data string", lambda s: keyed.buffered(s.withColumn("ts", F.timestamp_seconds("at")), 7))
    assert sorted(map(tuple, got)) == [("x", "q", 1, "a", 1, False), ("x", "r", None, None, None, False)]


@pytest.mark.parametrize("seed", range(3))
def test_logged_lines_meet_the_index_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = [("log", f"u{rng.randrange(12)}", i % 9, 1000 + i) for i in range(40)]
    index = [("index", f"u{n}", 0, 1000 + n) for n in range(0, 12, 2)] * 2
    rows = log + index
    rng.shuffle(rows)
    batches = [*cut(rng, rows, 4), [("index", "", 0, 10**6)]]
    got = streamed(spark, tmp_path, batches, "kind string, url string, line long, at long", lambda s: keyed.drained(s.withColumn("ts", F.timestamp_seconds("at")), "5 minutes"))
    assert sorted(map(tuple, got)) == sorted((u, line, "written" if int(u[1:]) % 2 == 0 else "lost") for _, u, line, _ in log)


def test_batches_are_of_some_rows_and_some_seconds(spark, tmp_path):
    spark.range(2300).repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    tails.append_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", None).awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.select("id").distinct().count() == out.count() == 2300
    assert max(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()) <= 500
    rate = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    run = tails.append_batches(rate, f"file://{tmp_path}/rate", f"file://{tmp_path}/ratecp", 1)
    run.awaitTermination(6)
    run.stop()
    assert run.exception() is None and len(run.recentProgress) >= 3
    waits = [p["durationMs"]["triggerExecution"] for p in run.recentProgress if p["numInputRows"]]
    assert waits and sorted(waits)[len(waits) // 2] < 2000


def test_a_key_of_the_log_has_many_urls(spark, tmp_path):
    """More lines wait for a URL than its cell holds, and there are fewer entries of state than URLs."""
    many = [("log", f"v{n}", 1, 1000) for n in range(20000)]
    rows = [*many, *(("log", u, n, 1000) for u in ("a", "b") for n in range(700)), ("log", None, 3, 1000), ("log", "a", 5, 1000)]
    schema = "kind string, url string, line long, at long"
    for n, part in enumerate([rows, [("index", "a", 0, 1001), *(("index", f"v{n}", 0, 1001) for n in range(0, 20000, 2))], [("index", "", 0, 10**6)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = keyed.drained(files.withColumn("ts", F.timestamp_seconds("at")), "5 minutes")
    run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    run.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").groupBy("url", "line", "state").count().collect()
    want = {(f"v{n}", 1): ("lost" if n % 2 else "written", 1) for n in range(20000)} | {("b", n): ("lost", 1) for n in range(700)} | {("a", n): ("written", 1 + (n == 5)) for n in range(700)} | {(None, 3): ("lost", 1)}
    assert {(r.url, r.line): (r.state, r["count"]) for r in got} == want and len(got) == len(want)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress) < 20000
