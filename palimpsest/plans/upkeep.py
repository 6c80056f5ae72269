"""Queries about upkeep: dispatch, recaptures, folders, patterns and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import matching
from palimpsest.operators import upkeep
from palimpsest.plans import model as M
from palimpsest.plans.registry import query

_FEEDS = """, feeds AS (SELECT id, id % 5 <> 0 AS enabled, id % 3 <> 0 AS auto_capture, CASE WHEN id % 2 = 0 THEN TIMESTAMP '1998-01-01' + INTERVAL (id % 100) DAY END AS next_capture_at FROM sites)"""


@query("feeds_to_dispatch", M.SQL + _FEEDS + " SELECT DISTINCT f.id FROM feeds f JOIN captures c ON c.site_id = f.id WHERE enabled AND auto_capture AND c.status = 'partial' AND (next_capture_at IS NULL OR next_capture_at <= TIMESTAMP '1998-02-01')")
def feeds_to_dispatch(spark, d):
    day = F.expr("make_dt_interval(CAST(id % 100 AS INT))")
    feeds = M.sites(spark, d).select("id", (F.col("id") % 5 != 0).alias("enabled"), (F.col("id") % 3 != 0).alias("auto_capture"), F.when(F.col("id") % 2 == 0, F.lit("1998-01-01").cast("timestamp_ntz") + day).alias("next_capture_at"))
    items = M.captures(spark, d).select(F.col("site_id").alias("feed_id"), F.when(F.col("status") == "partial", "pending").otherwise("captured").alias("status"))
    return upkeep.to_dispatch(feeds, items, "1998-02-01").select("id")


@query("sites_to_recapture", M.SQL + "SELECT s.id FROM sites s JOIN (SELECT site_id, max(started_at) AS last FROM captures WHERE status <> 'running' GROUP BY site_id) l ON l.site_id = s.id WHERE NOT deleted AND last <= TIMESTAMP '1999-06-01' - INTERVAL 90 DAY AND s.id NOT IN (SELECT site_id FROM captures WHERE status = 'running')")
def sites_to_recapture(spark, d):
    return upkeep.to_recapture(M.sites(spark, d), M.captures(spark, d), "1999-06-01", 90).select("id")


@query("folder_rename", M.SQL + "SELECT id, CASE WHEN path = 'ASIA' OR starts_with(path, 'ASIA/') THEN 'FAR/EAST' || substr(path, 5) ELSE path END AS path FROM folders")
def folder_rename(spark, d):
    return upkeep.renamed(M.folders(spark, d), "ASIA", "FAR/EAST")


@query("folder_deletable", M.SQL + "SELECT (SELECT count(*) FROM folders WHERE starts_with(path, 'ASIA/')) AS below, (SELECT count(*) FROM folders WHERE NOT contains(path, '/')) AS roots, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS trashed, CASE WHEN (SELECT count(*) FROM folders WHERE starts_with(path, 'ASIA/')) > 0 THEN 'has folders' WHEN count(*) > 0 THEN 'has sites' END AS reason FROM sites WHERE folder_id IN (SELECT id FROM folders WHERE path = 'ASIA')")
def folder_deletable(spark, d):
    return upkeep.deletable(M.folders(spark, d), M.sites(spark, d), "ASIA")


@query("clearable_jobs", M.SQL + "SELECT site_id, count(*) AS n FROM captures WHERE status NOT IN ('queued', 'running') AND priority = '1-URGENT' GROUP BY site_id")
def clearable_jobs(spark, d):
    """Jobs that have ended, of one type, by site."""
    return M.captures(spark, d).where(~F.col("status").isin("queued", "running") & (F.col("priority") == "1-URGENT")).groupBy("site_id").agg(F.count("*").alias("n"))


@query("tag_pairs_removed", M.SQL + "SELECT slug, count(*) AS n FROM site_tags WHERE NOT (site_id <= 100 AND slug IN (SELECT slug FROM tags ORDER BY slug LIMIT 2)) GROUP BY slug")
def tag_pairs_removed(spark, d):
    two = M.tags(spark, d).orderBy("slug").limit(2).agg(F.collect_list("slug").alias("slugs"))
    gone = M.sites(spark, d).where("id <= 100").crossJoin(F.broadcast(two)).select(F.col("id").alias("site_id"), F.explode("slugs").alias("slug"))  # one row of two names
    return M.site_tags(spark, d).join(gone, ["site_id", "slug"], "left_anti").groupBy("slug").agg(F.count("*").alias("n"))


@query("reader_index", M.SQL + ", p AS (SELECT url, max(started_at) AS newest FROM capture_urls u JOIN captures c ON c.id = u.capture_id GROUP BY url) SELECT url, strftime(newest, '%Y%m%d%H%M%S') AS timestamp, (SELECT count(*) FROM p) AS total FROM p ORDER BY newest DESC, url LIMIT 200 OFFSET 100")
def reader_index(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    pages = rows.groupBy("url").agg(F.max("started_at").alias("newest"))
    total = pages.agg(F.count("*").alias("total"))
    return pages.orderBy(F.desc("newest"), "url").offset(100).limit(200).crossJoin(F.broadcast(total)).select("url", F.date_format("newest", "yyyyMMddHHmmss").alias("timestamp"), "total")  # one row


@query("media_library", M.SQL + "SELECT capture_id, count(*) AS items, CAST(coalesce(sum(bytes) FILTER (error IS NULL), 0) AS BIGINT) AS bytes FROM capture_urls GROUP BY capture_id")
def media_library(spark, d):
    item = F.struct(F.col("url").alias("filename"), F.when(F.col("error").isNull(), "downloaded").otherwise("refused").alias("status"), "bytes")
    manifest = F.to_json(F.struct(F.struct(F.struct(F.collect_list(item).alias("items")).alias("media")).alias("stats")))
    rows = M.capture_urls(spark, d).groupBy("capture_id").agg(manifest.alias("manifest")).unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS capture_id, '{broken' AS manifest"))
    kept = F.sum(F.when(F.col("status") == "downloaded", F.col("bytes")))
    return upkeep.media_library(rows).groupBy("capture_id").agg(F.count("*").alias("items"), F.coalesce(kept, F.lit(0)).alias("bytes"))


@query("scope_estimate", "SELECT count(*) AS sample, CAST(floor(count(*) FILTER (starts_with(url, 'https')) * 100000.0 / count(*)) AS BIGINT) AS estimate FROM pages")
def scope_estimate(spark, d):
    return upkeep.scaled(M.table(spark, d, "pages"), 100_000, F.startswith("url", F.lit("https")))


@query("script_coverage", "SELECT page_id, (regexp_matches(url, '^https?://([^/]+[.])?example[.](com|net)(/|$)') AND NOT contains(url, '/fr/')) AS runs FROM pages")
def script_coverage(spark, d):
    runs = matching.script_runs(F.col("url"), match=["*://*.example.com/*", "*://*.example.net/*"], exclude=["*/fr/*"])
    return M.table(spark, d, "pages").select("page_id", runs.alias("runs"))


@query("observed_states", "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'click' THEN 'gone' WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN 'moved' ELSE 'live' END AS state FROM events")
def observed_states(spark, d):
    kind = F.col("kind")
    status = F.when(kind == "click", 410).when(kind == "signup", 429).otherwise(200)
    error = F.when(kind == "error", "timeout")
    final = F.when(kind == "purchase", "https://other.example.net/").otherwise("https://www.site.example.org/")
    return M.observations(spark, d).select("id", matching.observed(status, error, F.lit("https://site.example.org/"), final).alias("state"))
