"""Catalogue queries: filters, tags, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import filters, rollup
from palimpsest.plans import model as M
from palimpsest.plans.registry import query

SINCE, UNTIL = "1996-01-01", "1997-01-01"


@query("site_filter_page", M.SQL + "SELECT id, title, status, size_bytes, (SELECT count(*) FROM sites WHERE NOT deleted AND status = 'BUILDING' AND size_bytes >= 10000) AS total FROM sites WHERE NOT deleted AND status = 'BUILDING' AND size_bytes >= 10000 ORDER BY size_bytes DESC, id LIMIT 20 OFFSET 20")
def site_filter_page(spark, d):
    f = filters.SiteFilter(status="BUILDING", min_size=10000, sort="size_bytes", descending=True)
    return filters.page(f.ordered(f.apply(M.sites(spark, d))), 2, 20).select("id", "title", "status", "size_bytes", "total")


@query("site_filter_text", M.SQL + "SELECT id, title FROM sites WHERE NOT deleted AND (contains(lower(title), '00_1') OR contains(lower(title), '#0000001') OR contains(lower(status), 'auto'))")
def site_filter_text(spark, d):
    rows = M.sites(spark, d).where(~F.col("deleted"))
    hit = filters.contains(F.col("title"), "00_1") | filters.contains(F.col("title"), "#0000001") | filters.contains(F.col("status"), "AUTO")
    return rows.where(hit).select("id", "title")


@query("site_filter_folder", M.SQL + "SELECT s.id, f.path FROM sites s JOIN folders f ON s.folder_id = f.id WHERE NOT deleted AND (path = 'EUROPE' OR starts_with(path, 'EUROPE/'))")
def site_filter_folder(spark, d):
    folders = M.folders(spark, d)
    rows = filters.SiteFilter(folder="EUROPE").apply(M.sites(spark, d), folders=folders)
    return rows.join(folders.withColumnRenamed("id", "folder_id"), "folder_id").select("id", "path")


_PICK = "(SELECT slug FROM tags WHERE slug <> 'unused' ORDER BY slug LIMIT 3)"


@query("tag_division_any", M.SQL + f"SELECT id FROM sites WHERE NOT deleted AND id IN (SELECT site_id FROM site_tags WHERE slug IN {_PICK})")
def tag_division_any(spark, d):
    return filters.having_tags(M.sites(spark, d).where(~F.col("deleted")), M.site_tags(spark, d), _first_tags(spark, d), "any").select("id")


@query("tag_division_all", M.SQL + f"SELECT id FROM sites WHERE NOT deleted AND id IN (SELECT site_id FROM site_tags WHERE slug IN {_PICK} GROUP BY site_id HAVING count(*) = 3)")
def tag_division_all(spark, d):
    return filters.having_tags(M.sites(spark, d).where(~F.col("deleted")), M.site_tags(spark, d), _first_tags(spark, d), "all").select("id")


def _first_tags(spark, d):
    """Three tags, as a user would name them."""
    return [r.slug for r in M.tags(spark, d).where("slug <> 'unused'").orderBy("slug").limit(3).collect()]


@query("site_filter_errors", M.SQL + "SELECT id FROM sites WHERE NOT deleted AND id NOT IN (SELECT site_id FROM captures WHERE id IN (SELECT capture_id FROM capture_urls WHERE error IS NOT NULL))")
def site_filter_errors(spark, d):
    return filters.SiteFilter(has_errors=False).apply(M.sites(spark, d), captures=M.captures(spark, d), capture_urls=M.capture_urls(spark, d)).select("id")


@query("site_filter_never_captured", M.SQL + "SELECT id FROM sites WHERE NOT deleted AND id NOT IN (SELECT site_id FROM captures)")
def site_filter_never_captured(spark, d):
    return filters.SiteFilter(never_captured=True).apply(M.sites(spark, d), captures=M.captures(spark, d)).select("id")


@query("site_filter_captured_between", M.SQL + "SELECT id FROM sites WHERE NOT deleted AND id IN (SELECT site_id FROM captures GROUP BY site_id HAVING max(started_at) >= TIMESTAMP '1997-06-01' AND max(started_at) <= TIMESTAMP '1998-03-01')")
def site_filter_captured_between(spark, d):
    return filters.SiteFilter(captured_from="1997-06-01", captured_to="1998-03-01").apply(M.sites(spark, d), captures=M.captures(spark, d)).select("id")


@query("tag_usage_outer", M.SQL + "SELECT t.slug, count(s.id) AS sites FROM tags t LEFT JOIN site_tags st ON st.slug = t.slug LEFT JOIN sites s ON s.id = st.site_id AND NOT s.deleted GROUP BY t.slug")
def tag_usage_outer(spark, d):
    return rollup.tag_usage(M.tags(spark, d), M.site_tags(spark, d), M.sites(spark, d))


@query("site_tag_map", M.SQL + "SELECT s.id AS site_id, coalesce(string_agg(st.slug, ',' ORDER BY st.slug), '') AS tags FROM sites s LEFT JOIN site_tags st ON st.site_id = s.id GROUP BY s.id")
def site_tag_map(spark, d):
    return rollup.tag_lists(M.sites(spark, d), M.site_tags(spark, d)).select("site_id", F.array_join("tags", ",").alias("tags"))


@query("tag_most_used", M.SQL + "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM site_tags GROUP BY site_id)")
def tag_most_used(spark, d):
    return M.site_tags(spark, d).groupBy("site_id").count().agg(F.max("count").alias("n"))


@query("tag_missing_pairs", M.SQL + f"SELECT s.id AS site_id, t.slug FROM sites s CROSS JOIN (SELECT slug FROM tags ORDER BY slug LIMIT 5) t WHERE NOT EXISTS (SELECT 1 FROM site_tags x WHERE x.site_id = s.id AND x.slug = t.slug)")
def tag_missing_pairs(spark, d):
    picked = M.tags(spark, d).orderBy("slug").limit(5).agg(F.collect_list("slug").alias("slugs"))
    wanted = M.sites(spark, d).crossJoin(F.broadcast(picked)).select(F.col("id").alias("site_id"), F.explode("slugs").alias("slug"))  # one row of five names
    return wanted.join(M.site_tags(spark, d), ["site_id", "slug"], "left_anti")


@query("symlink_names", M.SQL + """, named AS (SELECT id, slug, lower(substr(title, 1, 17)) AS name FROM site_tags JOIN sites ON site_id = id WHERE NOT deleted)
SELECT slug, id, CASE WHEN count(*) OVER (PARTITION BY slug, name) > 1 THEN name || '-' || id ELSE name END AS link FROM named""")
def symlink_names(spark, d):
    rows = M.site_tags(spark, d).join(M.sites(spark, d).where(~F.col("deleted")), F.col("site_id") == F.col("id"))
    rows = rows.select("slug", "id", F.lower(F.substring("title", 1, 17)).alias("name"))
    clash = F.expr("count(*) OVER (PARTITION BY slug, name) > 1")
    return rows.select("slug", "id", F.when(clash, F.concat_ws("-", "name", F.col("id").cast("string"))).otherwise(F.col("name")).alias("link"))


@query("folder_rollup", M.SQL + """, own AS (SELECT folder_id, count(*) AS n, sum(size_bytes) AS b FROM sites WHERE NOT deleted GROUP BY folder_id),
each AS (SELECT path, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM folders LEFT JOIN own ON id = folder_id)
SELECT a.path, CAST(a.n AS BIGINT) AS sites, CAST(a.b AS BIGINT) AS bytes, CAST(sum(x.n) AS BIGINT) AS total_sites, CAST(sum(x.b) AS BIGINT) AS total_bytes
FROM each a JOIN each x ON x.path = a.path OR starts_with(x.path, a.path || '/') GROUP BY ALL""")
def folder_rollup(spark, d):
    return rollup.folder_tree(M.sites(spark, d), M.folders(spark, d))


@query("usage_largest", M.SQL + "SELECT * FROM (SELECT id, title, size_bytes FROM sites WHERE NOT deleted ORDER BY size_bytes DESC, id LIMIT 10) WHERE size_bytes > 0")
def usage_largest(spark, d):
    return rollup.largest(M.sites(spark, d))


@query("usage_totals", M.SQL + "SELECT count(*) AS sites, count(*) FILTER (NOT deleted) AS visible, CAST(sum(size_bytes) AS BIGINT) AS bytes, (SELECT count(*) FROM captures) AS captures, CAST((SELECT sum(bytes) FROM captures) AS BIGINT) AS capture_bytes FROM sites")
def usage_totals(spark, d):
    a = M.sites(spark, d).agg(F.count("*").alias("sites"), F.count_if(~F.col("deleted")).alias("visible"), F.sum("size_bytes").alias("bytes"))
    return a.crossJoin(M.captures(spark, d).agg(F.count("*").alias("captures"), F.sum("bytes").alias("capture_bytes")))  # one row each


@query("status_zero_fill", M.SQL + "SELECT v.status, count(c.id) AS n FROM (VALUES ('ok'), ('partial'), ('running'), ('failed'), ('cancelled')) v(status) LEFT JOIN captures c ON c.status = v.status GROUP BY v.status")
def status_zero_fill(spark, d):
    return rollup.counted_by(M.captures(spark, d), "status", ["ok", "partial", "running", "failed", "cancelled"])


@query("metrics_exposition", M.SQL + """, n AS (SELECT v.status, count(c.id) AS n FROM (VALUES ('ok'), ('partial'), ('failed')) v(status) LEFT JOIN captures c ON c.status = v.status GROUP BY v.status)
SELECT 'archive_captures{kind="all",status="' || status || '"} ' || n AS line FROM n UNION ALL SELECT 'archive_sites ' || count(*) FROM sites""")
def metrics_exposition(spark, d):
    n = rollup.counted_by(M.captures(spark, d), "status", ["ok", "partial", "failed"])
    series = n.select(F.lit("archive_captures").alias("name"), F.create_map(F.lit("status"), F.col("status"), F.lit("kind"), F.lit("all")).alias("labels"), F.col("n").cast("double").alias("value"))
    total = M.sites(spark, d).agg(F.count("*").cast("double").alias("value")).select(F.lit("archive_sites").alias("name"), F.expr("map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<string>))").alias("labels"), "value")
    return rollup.exposition(series.unionByName(total))


@query("digest_window", M.SQL + f"SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'running') AS running, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM captures WHERE started_at >= TIMESTAMP '{SINCE}' AND started_at < TIMESTAMP '{UNTIL}'")
def digest_window(spark, d):
    rows = M.captures(spark, d).where(rollup.within("started_at", SINCE, UNTIL))
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "running")]
    return rows.agg(*by, F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query("digest_report", M.SQL + f""", w AS (SELECT * FROM captures WHERE started_at >= TIMESTAMP '{SINCE}' AND started_at < TIMESTAMP '{UNTIL}')
SELECT (SELECT count(*) FROM w) AS captures, (SELECT count(DISTINCT site_id) FROM w) AS sites, (SELECT count(*) FROM capture_urls WHERE capture_id IN (SELECT id FROM w)) AS urls,
CAST((SELECT sum(bytes) FROM captures WHERE started_at < TIMESTAMP '{UNTIL}') - (SELECT sum(bytes) FROM captures WHERE started_at < TIMESTAMP '{SINCE}') AS BIGINT) AS growth""")
def digest_report(spark, d):
    captures = M.captures(spark, d)
    rows = captures.where(rollup.within("started_at", SINCE, UNTIL))
    one = rows.agg(F.count("*").alias("captures"), F.countDistinct("site_id").alias("sites"))
    urls = M.capture_urls(spark, d).select("capture_id").join(rows.select(F.col("id").alias("capture_id")), "capture_id", "left_semi").agg(F.count("*").alias("urls"))
    until = lambda t: F.sum(F.when(F.col("started_at") < F.lit(t).cast("timestamp_ntz"), F.col("bytes")))
    growth = captures.agg((until(UNTIL) - until(SINCE)).alias("growth"))
    return one.crossJoin(urls).crossJoin(growth)  # one row each


@query("digest_failures", M.SQL + f"SELECT c.id, s.title, CAST(CAST(c.started_at AS DATE) AS VARCHAR) AS day FROM captures c LEFT JOIN sites s ON s.id = c.site_id WHERE c.status = 'running' AND started_at >= TIMESTAMP '{SINCE}' AND started_at < TIMESTAMP '{UNTIL}' ORDER BY started_at DESC, c.id DESC LIMIT 10")
def digest_failures(spark, d):
    rows = M.captures(spark, d).where((F.col("status") == "running") & rollup.within("started_at", SINCE, UNTIL)).orderBy(F.desc("started_at"), F.desc("id")).limit(10)
    return rows.join(M.sites(spark, d).select(F.col("id").alias("site_id"), "title"), "site_id", "left").select("id", "title", F.col("started_at").cast("date").cast("string").alias("day"))


@query("quiet_sites", M.SQL + "SELECT s.id, CAST(CAST(max(c.started_at) AS DATE) AS VARCHAR) AS last_day FROM sites s JOIN captures c ON c.site_id = s.id WHERE NOT s.deleted GROUP BY s.id ORDER BY max(c.started_at), s.id LIMIT 10")
def quiet_sites(spark, d):
    last = M.captures(spark, d).groupBy("site_id").agg(F.max("started_at").alias("last"))
    rows = M.sites(spark, d).where(~F.col("deleted")).join(last, F.col("id") == F.col("site_id"))
    return rows.orderBy("last", "id").limit(10).select("id", F.col("last").cast("date").cast("string").alias("last_day"))


@query("stalled_entities", M.SQL + "SELECT s.id, CAST(CAST(m.last AS DATE) AS VARCHAR) AS last_day FROM sites s LEFT JOIN (SELECT site_id, max(started_at) AS last FROM captures GROUP BY site_id) m ON m.site_id = s.id WHERE NOT deleted AND (m.last IS NULL OR m.last < TIMESTAMP '1997-01-01')")
def stalled_entities(spark, d):
    last = M.captures(spark, d).groupBy("site_id").agg(F.max("started_at").alias("last"))
    rows = M.sites(spark, d).where(~F.col("deleted")).join(last, F.col("id") == F.col("site_id"), "left")
    return rows.where(F.col("last").isNull() | (F.col("last") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("id", F.col("last").cast("date").cast("string").alias("last_day"))


@query("due_sites_nulls_first", M.SQL + "SELECT s.id FROM sites s LEFT JOIN (SELECT site_id, max(started_at) AS last FROM captures WHERE status = 'ok' GROUP BY site_id) m ON m.site_id = s.id WHERE NOT deleted AND (last IS NULL OR last <= TIMESTAMP '1998-01-01') ORDER BY last ASC NULLS FIRST, s.id LIMIT 50")
def due_sites_nulls_first(spark, d):
    last = M.captures(spark, d).where("status = 'ok'").groupBy("site_id").agg(F.max("started_at").alias("last"))
    rows = M.sites(spark, d).where(~F.col("deleted")).join(last, F.col("id") == F.col("site_id"), "left")
    due = F.col("last").isNull() | (F.col("last") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.where(due).orderBy(F.col("last").asc_nulls_first(), "id").limit(50).select("id")


@query("capture_url_errors", M.SQL + "SELECT capture_id, line, url FROM capture_urls WHERE (status_code >= 400 OR error IS NOT NULL) AND host = 'h3.example.org' AND contains(lower(url), '/p/1')")
def capture_url_errors(spark, d):
    rows = M.capture_urls(spark, d)
    bad = (F.col("status_code") >= 400) | F.col("error").isNotNull()
    return rows.where(bad & (F.col("host") == "h3.example.org") & filters.contains(F.col("url"), "/P/1")).select("capture_id", "line", "url")


@query("site_capture_stats", M.SQL + "SELECT c.site_id, count(*) AS urls, count(*) FILTER (status_code >= 400 OR error IS NOT NULL) AS errors, CAST(sum(u.bytes) AS BIGINT) AS bytes, count(DISTINCT url) AS distinct_urls FROM capture_urls u JOIN captures c ON c.id = u.capture_id GROUP BY c.site_id")
def site_capture_stats(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "site_id"), "capture_id")
    bad = (F.col("status_code") >= 400) | F.col("error").isNotNull()
    return rows.groupBy("site_id").agg(F.count("*").alias("urls"), F.count_if(bad).alias("errors"), F.sum("bytes").alias("bytes"), F.countDistinct("url").alias("distinct_urls"))


@query("job_list_page", M.SQL + "SELECT id, status FROM captures WHERE status = 'partial' ORDER BY id DESC LIMIT 25 OFFSET 50")
def job_list_page(spark, d):
    return M.captures(spark, d).where("status = 'partial'").orderBy(F.desc("id")).offset(50).limit(25).select("id", "status")


@query("size_rollup_changes", M.SQL + "SELECT count(*) AS changed FROM sites s LEFT JOIN (SELECT site_id, sum(bytes) AS b FROM captures GROUP BY site_id) c ON c.site_id = s.id WHERE coalesce(b, 0) <> size_bytes")
def size_rollup_changes(spark, d):
    own = M.captures(spark, d).groupBy("site_id").agg(F.sum("bytes").alias("b"))
    rows = M.sites(spark, d).join(own, F.col("id") == F.col("site_id"), "left")
    return rows.agg(F.count_if(F.coalesce("b", F.lit(0)) != F.col("size_bytes")).alias("changed"))
