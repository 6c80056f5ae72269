"""Queries for lists: what is pending, polled, expiring, vanished, in the trash, noted, and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import hosts, listings
from palimpsest.plans import model as M
from palimpsest.plans.registry import query

NOW = "1997-06-01"


def _place(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place"


@query("pending_items", f"SELECT event_id AS id, published, {_place('published DESC NULLS LAST, event_id')} FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN ts END AS published FROM events WHERE event_type = 'view') ORDER BY place LIMIT 200")
def pending_items(spark, d):
    """Items of all feeds that wait: views stand for pending ones, one in five has no date."""
    rows = M.observations(spark, d)
    items = rows.select("id", F.when(F.col("id") % 5 > 0, F.col("ts")).alias("published"), F.when(F.col("kind") == "view", "pending").otherwise("captured").alias("status"))
    return listings.pending(items, 200).select("id", "published", "place")


@query("poll_history", f"SELECT event_id AS id, {_place('ts DESC, event_id DESC')} FROM events WHERE event_type = 'click' ORDER BY place LIMIT 50")
def poll_history(spark, d):
    return listings.newest(M.observations(spark, d).where("kind = 'click'"), 50).select("id", "place")


@query("audit_page", f"SELECT * FROM (SELECT event_id AS id, {_place('ts DESC, event_id DESC')} FROM events) WHERE place BETWEEN 51 AND 75")
def audit_page(spark, d):
    """The third page of the newest entries, of twenty-five each."""
    return listings.newest(M.observations(spark, d), 25, 50).select("id", "place")


@query("expiring_profiles", M.SQL + f"SELECT id, started_at <= TIMESTAMP '{NOW}' AS expired, {_place('started_at, id')} FROM captures WHERE started_at <= TIMESTAMP '{NOW}' + INTERVAL 21 DAY ORDER BY place LIMIT 10")
def expiring_profiles(spark, d):
    """Captures as profiles that expire when they were started."""
    return listings.expiring(M.captures(spark, d).withColumnRenamed("started_at", "expires_at"), NOW).select("id", "expired", "place")


@query("vanished_sites", M.SQL + f"SELECT id, title, {_place('title, id')} FROM sites WHERE status IN ('BUILDING', 'MACHINERY') ORDER BY place LIMIT 10")
def vanished_sites(spark, d):
    """Sites of two segments are gone or moved."""
    state = F.when(F.col("status") == "BUILDING", "gone").when(F.col("status") == "MACHINERY", "moved").otherwise("live")
    return listings.vanished(M.sites(spark, d).withColumn("state", state)).select("id", "title", "place")


@query("trash_list", M.SQL + ", t AS (SELECT s.id, max(started_at) AS deleted_at FROM sites s JOIN captures c ON c.site_id = s.id WHERE s.deleted GROUP BY s.id) SELECT id, CAST(greatest(400 - floor(epoch(TIMESTAMP '1998-12-01' - deleted_at) / 86400), 0) AS BIGINT) AS days_left FROM t")
def trash_list(spark, d):
    """Deleted sites went with their last capture and stay for 400 days."""
    last = M.captures(spark, d).groupBy("site_id").agg(F.max("started_at").alias("deleted_at"))
    rows = M.sites(spark, d).where("deleted").join(last, F.col("id") == F.col("site_id"))
    return listings.trash(rows, "1998-12-01", 400).orderBy(F.desc("deleted_at"), "id").select("id", "days_left")


@query("discovered_hosts", M.SQL + f", h AS (SELECT host, host = 'h1.example.org' AS is_seed, count(*) FILTER (line % 2 = 0) AS asset_refs FROM capture_urls GROUP BY host) SELECT host, asset_refs, {_place('is_seed DESC, asset_refs DESC, host')} FROM h")
def discovered_hosts(spark, d):
    """The hosts of one discovery: the seed's first, then by assets."""
    refs = M.capture_urls(spark, d).select("url", F.when(F.col("line") % 2 == 0, "asset").otherwise("link").alias("kind"), F.lit(None).cast("string").alias("mime"))
    found = hosts.statistics(refs, "h1.example.org").withColumn("discovery", F.lit(1))
    return listings.placed(found, "discovery", [F.desc("is_seed"), F.desc("asset_refs"), F.asc("host")]).select("host", "asset_refs", "place")


@query("page_annotations", "SELECT user_id AS page, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, event_id) AS INT) AS place FROM events")
def page_annotations(spark, d):
    """Notes of each page in the order of its blocks."""
    rows = M.observations(spark, d).select(F.col("key").alias("page"), "id", (F.col("id") % 7).alias("block_index"))
    return listings.placed(rows, "page", [F.asc("block_index"), F.asc("id")]).select("page", "id", "place")


@query("site_annotations", f"SELECT event_id AS id, {_place('ts DESC, event_id DESC')} FROM events WHERE event_type <> 'error' ORDER BY place LIMIT 100")
def site_annotations(spark, d):
    return listings.newest(M.observations(spark, d).where("kind <> 'error'"), 100).select("id", "place")


@query("batches_of_fifty", "SELECT user_id AS key, batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch FROM events) GROUP BY 1, 2")
def batches_of_fifty(spark, d):
    rows = listings.batches(M.observations(spark, d).select("key", "id"), "key", [F.asc("id")])
    return rows.groupBy("key", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
