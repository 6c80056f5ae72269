"""Incremental queries: folds of event streams, hysteresis, back-off, windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions import scalars
from palimpsest.plans import model as M
from palimpsest.plans.registry import query
from palimpsest.streaming import keyed, machines, tails


def _seen(rows):
    return rows.select("key", "id", "ts", F.when(F.col("kind") == "error", "gone").otherwise("live").alias("seen"))


@query("event_fold", "SELECT user_id AS key, count(*) FILTER (event_type <> 'view') AS urls, count(*) FILTER (event_type = 'error') AS errors, CAST(coalesce(arg_max(CAST(value * 100 AS BIGINT), event_id) FILTER (event_type = 'view' AND CAST(value * 100 AS BIGINT) <> 0), 0) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def event_fold(spark, d):
    rows = M.observations(spark, d)
    is_url = F.col("kind") != "view"
    typed = rows.select("key", "id", F.when(is_url, "url").otherwise("progress").alias("type"), F.when(F.col("kind") == "error", "timeout").alias("error"), F.lit(200).alias("status"), F.lit(False).alias("revisit"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return machines.folded(typed).select("key", "urls", "errors", "bytes")


@query("status_reconciled", M.SQL + """, j AS (SELECT id, CASE WHEN status = 'running' THEN NULL ELSE status END AS result, id % 3 AS code, id % 7 = 0 AS cancelled FROM captures)
SELECT id, CASE WHEN cancelled THEN CASE WHEN result IS NULL THEN 'cancelled' ELSE 'partial' END WHEN result IS NULL THEN 'failed' WHEN code <> 0 AND result = 'ok' THEN 'partial' ELSE result END AS status FROM j""")
def status_reconciled(spark, d):
    result = F.when(F.col("status") != "running", F.col("status"))
    return M.captures(spark, d).select("id", machines.final_status(result, F.col("id") % 3, F.col("id") % 7 == 0).alias("status"))


_HYSTERESIS = """WITH o AS (SELECT user_id AS key, event_id AS id, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'live' END AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(seen) OVER (PARTITION BY key ORDER BY n) AS before FROM o),
c AS (SELECT * FROM p WHERE n = 1 OR seen = before), d AS (SELECT *, lag(seen) OVER (PARTITION BY key ORDER BY n) AS was FROM c)
SELECT key, id, seen AS changed_to FROM d WHERE was IS NOT NULL AND seen <> was"""


@query("hysteresis", _HYSTERESIS)
def hysteresis(spark, d):
    """Health changes that two observations in a row confirm (with two states, a repeated one is what counts)."""
    return machines.health_changes(_seen(M.observations(spark, d)))


_FEED_STATES = """WITH o AS (SELECT user_id AS key, event_type = 'view' AS ok, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT key, run, count(*) FILTER (NOT ok) AS failures, count(*) AS n FROM o GROUP BY key, run)
SELECT key, CAST(sum(n) AS BIGINT) AS polls, CASE WHEN max(failures) < 10 THEN arg_max(failures, run) ELSE 10 END AS failures, max(failures) < 10 AS enabled,
CASE WHEN max(failures) >= 10 THEN 'disabled' WHEN arg_max(failures, run) > 0 THEN 'failed' WHEN max(run) = 1 THEN 'baseline' ELSE 'polled' END AS last_action FROM r GROUP BY key"""


@query("feed_states", _FEED_STATES)
def feed_states(spark, d):
    return machines.feed_states(M.observations(spark, d).select("key", "id", "ts", (F.col("kind") == "view").alias("ok")))


def _stream(spark, d, build, mode):
    """Run a stream over the events file to its end and return what it wrote, as files: none of it goes through the driver."""
    path, _, _ = f"{d}/events.parquet".rpartition("/")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    typed = rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value")
    out = storage.folder(spark, "streamed")
    built = build(typed)
    writer = built.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").start(f"{out}/rows")
    else:  # what a batch changes is a folder of its own; a complete table takes the last one's place
        run = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={n}")).start()
    run.awaitTermination()
    return spark.read.schema(built.schema).parquet(f"{out}/rows").select(*built.columns)


def _replayed(spark, rows, part, parts, build):
    """Run a stream over ``rows`` in ``parts`` micro-batches, by the column ``part`` (from 0), and return what it wrote."""
    source, out, files = storage.folder(spark, "replayed"), storage.folder(spark, "streamed"), spark.sparkContext.defaultParallelism
    rows = storage.written(rows.withColumn("_part", part), "parts")
    for i in range(parts):
        rows.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(source)
    run = build(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_hysteresis", _HYSTERESIS)
def stream_hysteresis(spark, d):
    return _stream(spark, d, lambda rows: machines.health_stream(_seen(rows)), "append")


@query("stream_feed_state", _FEED_STATES)
def stream_feed_state(spark, d):
    return _stream(spark, d, lambda rows: machines.feed_stream(rows.select("key", "id", "ts", (F.col("kind") == "view").alias("ok"))), "update")


@query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Counts per day and kind with a watermark: an addition, as the archive itself never drops late data."""
    build = lambda rows: rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
    return _stream(spark, d, build, "complete")


@query("stream_batches", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def stream_batches(spark, d):
    """Rows of a stream appended batch by batch: all of them, none twice."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{storage.shared_folder(spark)}/palimpsest-batches-{uuid.uuid4().hex}"
    tails.append_batches(rows.select("event_id", "event_type"), f"{out}/rows", f"{out}/checkpoint", None).awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


_CHUNK = "CASE WHEN event_id % 3 = 0 THEN 'a' || event_id ELSE 'b' || event_id || chr(10) || 'c' END"


@query("stream_whole_lines", f"WITH f AS (SELECT CAST(user_id AS VARCHAR) AS file, string_split(string_agg({_CHUNK}, '' ORDER BY event_id), chr(10)) AS parts FROM events GROUP BY user_id) SELECT file, CAST(unnest(range(len(parts) - 1)) AS BIGINT) AS place, unnest(parts[:-2]) AS line FROM f WHERE len(parts) > 1")
def stream_whole_lines(spark, d):
    """Lines of growing files; the last one is left out until it ends."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("id").cast("string"), F.lit("\nc")))
    return _stream(spark, d, lambda rows: tails.whole_lines(rows.select(F.col("key").cast("string").alias("file"), F.col("id").alias("at"), text.alias("text"))), "append")


@query("log_drain", M.SQL + "SELECT CASE WHEN EXISTS (SELECT 1 FROM capture_urls i WHERE i.url = u.url AND i.error IS NULL) THEN 'written' ELSE 'waiting' END AS state, count(*) AS n FROM capture_urls u GROUP BY 1")
def log_drain(spark, d):
    """Logged rows in two steps: those with an index line are written, the others are carried on."""
    rows = M.capture_urls(spark, d).select("url", "line", "error")
    index = rows.where("error IS NULL")
    first, waiting = tails.drained(index.where("line <= 3"), rows.where("line <= 3").limit(0), rows.where("line <= 3"))
    second, waiting = tails.drained(index, waiting, rows.where("line > 3"))
    state = lambda x, s: x.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return state(first.unionByName(second), "written").unionByName(state(waiting, "waiting"))


@query("sliding_failures", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error'")
def sliding_failures(spark, d):
    rows = M.observations(spark, d).where("kind = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("id", F.expr(f"count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN {6 * 3600 * 1_000_000} PRECEDING AND CURRENT ROW)").alias("n"))


@query("backoff_state", "SELECT user_id AS key, failures, CAST(CASE WHEN failures > 0 THEN least(30 * pow(2, least(failures, 30)), 1440) ELSE 30 END AS BIGINT) AS poll_minutes, CAST(least(10 * pow(2, least(greatest(failures - 1, 0), 30)), 1440) AS BIGINT) AS retry_minutes FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id)")
def backoff_state(spark, d):
    rows = M.observations(spark, d).groupBy("key").agg(F.count_if(F.col("kind") == "error").alias("failures"))
    return rows.select("key", "failures", scalars.backoff_minutes(F.lit(30), F.col("failures")).alias("poll_minutes"), scalars.retry_minutes(F.col("failures")).alias("retry_minutes"))


@query("ring_buffer", "SELECT user_id AS key, count(*) AS kept, min(event_id) AS oldest, min(event_id) > 501 AS gap FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50) GROUP BY user_id")
def ring_buffer(spark, d):
    """The newest events of each job, and whether a reader who has seen up to 500 has missed some."""
    from palimpsest.operators.history import newest_per

    kept = newest_per(M.observations(spark, d), ["key"], [F.desc("id")], 50)
    return kept.groupBy("key").agg(F.count("*").alias("kept"), F.min("id").alias("oldest")).withColumn("gap", F.col("oldest") > 501)


@query("replay_after", "SELECT event_id AS id, user_id AS key FROM events WHERE event_id > 900")
def replay_after(spark, d):
    return M.observations(spark, d).where("id > 900").select("id", "key")


@query("health_summary", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id) SELECT v.state, count(l.user_id) AS n FROM (VALUES ('view'), ('click'), ('error'), ('purchase'), ('signup'), ('unknown')) v(state) LEFT JOIN l ON l.state = v.state GROUP BY v.state""")
def health_summary(spark, d):
    from palimpsest.operators.rollup import counted_by

    last = M.observations(spark, d).groupBy("key").agg(F.max_by("kind", F.struct("ts", "id")).alias("state"))
    return counted_by(last, "state", ["view", "click", "error", "purchase", "signup", "unknown"])


@query("quiet_hours", "SELECT event_id AS id FROM events WHERE hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 390")
def quiet_hours(spark, d):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return M.observations(spark, d).where(scalars.quiet(minute, 23 * 60, 6 * 60 + 30)).select("id")


@query("scalar_times", """SELECT event_id AS id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-full-wget' AS dir, strftime(ts, '%Y%m%d%H%M%S') AS cdx, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS micros FROM events""")
def scalar_times(spark, d):
    micros = scalars.iso_micros(F.col("ts"))
    cdx = scalars.cdx_timestamp(micros)
    return M.observations(spark, d).select("id", scalars.capture_dir(F.col("ts"), F.lit("full"), F.lit("wget")).alias("dir"), cdx.alias("cdx"), scalars.iso_of_cdx(cdx).alias("iso"), micros.alias("micros"))


_MERGE_SQL = """WITH known AS (SELECT event_id AS guid, 'u' || event_id AS canonical, CASE WHEN event_id % 2 = 0 THEN 'captured' ELSE 'skipped' END AS status, 'h' || event_id % 5 AS content_hash, ts AS updated FROM events WHERE event_type = 'view'),
e AS (SELECT CASE WHEN event_id % 4 = 0 THEN -event_id ELSE event_id END AS guid, 'u' || event_id AS canonical, 'h' || event_id % 7 AS content_hash, ts + INTERVAL 1 HOUR AS updated FROM events WHERE event_type IN ('view', 'click'))
SELECT k.guid, CASE WHEN e.content_hash <> k.content_hash THEN 'pending' ELSE status END AS status, coalesce(e.content_hash, k.content_hash) AS content_hash FROM known k LEFT JOIN e USING (canonical)
UNION ALL SELECT guid, 'pending', content_hash FROM e WHERE canonical NOT IN (SELECT canonical FROM known)"""


def _items(spark, d):
    """Known items and the entries of a poll; one guid in four is new for a known address."""
    rows = M.observations(spark, d)
    named = F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical")
    digest = lambda n: F.concat(F.lit("h"), (F.col("id") % n).cast("string")).alias("content_hash")
    known = rows.where("kind = 'view'").select("key", F.col("id").alias("guid"), named, F.when(F.col("id") % 2 == 0, "captured").otherwise("skipped").alias("status"), digest(5), F.col("ts").alias("updated"))
    entries = rows.where("kind IN ('view', 'click')").select("key", F.when(F.col("id") % 4 == 0, -F.col("id")).otherwise(F.col("id")).alias("guid"), named, digest(7), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("updated"), F.col("id").alias("place"))
    return known, entries


@query("feed_merge", _MERGE_SQL)
def feed_merge(spark, d):
    known, entries = _items(spark, d)
    return machines.merge_items(known.drop("key"), entries.drop("key"), False).select("guid", "status", "content_hash")


@query("stream_feed_merge", _MERGE_SQL)
def stream_feed_merge(spark, d):
    """The same merge as entries come in, in several micro-batches; a feed is what events have the key of."""
    known, entries = _items(spark, d)
    feed, text, micros = F.col("key").cast("string").alias("feed"), F.col("guid").cast("string").alias("guid"), F.unix_micros(F.col("updated").cast("timestamp")).alias("updated")
    known = storage.written(known.select(feed, text, "canonical", "status", "content_hash", micros), "known")
    polled = entries.select(feed, F.lit(1).alias("poll"), "place", text, "canonical", "content_hash", micros, F.lit(False).alias("baseline"))
    got = _replayed(spark, polled, F.pmod(F.xxhash64("place"), F.lit(3)), 3, lambda rows: keyed.merged_items(rows, known))
    last = got.groupBy("guid").agg(F.max_by(F.struct("status", "content_hash"), F.struct("poll", "place")).alias("i")).select("guid", "i.*")
    untouched = known.join(last, "guid", "left_anti").select("guid", "status", "content_hash")
    return last.unionByName(untouched).select(F.col("guid").cast("long").alias("guid"), "status", "content_hash")


@query("stream_buffer", """WITH k AS (SELECT event_id AS id, event_type AS job FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500), o AS (SELECT job, min(id) AS oldest FROM k GROUP BY job),
r AS (SELECT job, min(id) AS seen, 'late' AS reader FROM (SELECT event_type AS job, event_id AS id FROM events) GROUP BY job UNION ALL SELECT job, max(id) - 10, 'soon' FROM k GROUP BY job UNION ALL SELECT job, max(id), 'now' FROM k GROUP BY job)
SELECT r.job, reader, k.id, oldest, oldest > seen + 1 AS gap FROM r JOIN o USING (job) LEFT JOIN k ON k.job = r.job AND k.id > seen""")
def stream_buffer(spark, d):
    """The newest 500 events of each job as three readers get them: one who has only seen the first, one who lacks a few, one who has all."""
    rows = M.observations(spark, d).select(F.col("kind").alias("job"), "id")
    events = rows.select("job", F.col("id").alias("at"), F.lit("event").alias("kind"), "id", F.lit(None).cast("string").alias("data"))
    ends = rows.groupBy("job").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    read = lambda seen, name: ends.select("job", (F.col("z") + 1).alias("at"), F.lit("read").alias("kind"), seen.alias("id"), F.lit(name).alias("data"))
    reads = read(F.col("a"), "late").unionByName(read(F.col("z") - 10, "soon")).unionByName(read(F.col("z"), "now"))
    third = rows.agg((F.max("id") / 3 + 1).cast("long").alias("third"))
    part = F.when(F.col("kind") == "read", 2).otherwise(F.least(F.expr("at div third"), F.lit(2))).cast("int")
    timed = events.unionByName(reads).join(F.broadcast(third))  # one row
    got = _replayed(spark, timed.withColumn("p", part).drop("third"), F.col("p"), 3, lambda rows: keyed.buffered(rows.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000))))
    return got.select("job", "reader", "id", "oldest", "gap")


@query("stream_log_drain", M.SQL + "SELECT CASE WHEN EXISTS (SELECT 1 FROM capture_urls i WHERE i.url = u.url AND i.error IS NULL) THEN 'written' ELSE 'lost' END AS state, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM capture_urls u GROUP BY 1")
def stream_log_drain(spark, d):
    """Every logged line against the index, both as they come in; the last rows say that time has gone on."""
    rows = M.capture_urls(spark, d).select("url", "line", "error", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line")).alias("ts"))
    log = rows.select(F.lit("log").alias("kind"), "url", "line", "ts")
    index = rows.where("error IS NULL").select(F.lit("index").alias("kind"), "url", "line", "ts")
    later = spark.range(1).select(F.lit("index").alias("kind"), F.lit("").alias("url"), F.lit(0).cast("long").alias("line"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    part = F.when(F.col("url") == "", 3).otherwise(F.pmod(F.xxhash64("kind", "url", "line"), F.lit(3))).cast("int")
    got = _replayed(spark, log.unionByName(index).unionByName(later), part, 4, lambda rows: keyed.drained(rows))
    return got.groupBy("state").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("block_diff")
def block_diff(spark, d):
    """Each turn of a conversation against the one before it, sentence by sentence."""
    from palimpsest.operators.difference import block_changes

    rows = M.table(spark, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), r"(?<=\.)\s+").alias("after"))
    rows = rows.withColumn("before", F.coalesce(F.expr("lag(after) OVER (PARTITION BY conv_id ORDER BY turn)"), F.array().cast("array<string>")))
    out = block_changes(rows.withColumn("id", F.concat_ws(":", "conv_id", "turn")))
    return out.select("id", F.size("changes").alias("n"), F.round("ratio", 6).alias("ratio"))
