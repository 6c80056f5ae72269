"""Queries over time: diffs, retention, deduplication, queues and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import matching
from palimpsest.operators import history
from palimpsest.plans import model as M
from palimpsest.plans.registry import query

NOW = "1999-01-01"


@query("latest_per_key", M.SQL + "SELECT site_id, id FROM captures QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, id DESC) = 1")
def latest_per_key(spark, d):
    return history.newest_per(M.captures(spark, d), ["site_id"], [F.desc("started_at"), F.desc("id")]).select("site_id", "id")


@query("keep_newest_n", M.SQL + "SELECT site_id, id FROM captures QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, id DESC) <= 4")
def keep_newest_n(spark, d):
    return history.newest_per(M.captures(spark, d), ["site_id"], [F.desc("started_at"), F.desc("id")], 4).select("site_id", "id")


@query("ttl_expired", M.SQL + f"SELECT id FROM captures WHERE started_at < TIMESTAMP '{NOW}' - INTERVAL 1500 DAY")
def ttl_expired(spark, d):
    return M.captures(spark, d).where(F.col("started_at") < F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL '1500' DAY")).select("id")


@query("capture_pair", M.SQL + "SELECT site_id, min_by(id, (started_at, id)) AS before_id, max_by(id, (started_at, id)) AS after_id FROM (SELECT * FROM captures WHERE status <> 'running' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, id DESC) <= 2) GROUP BY site_id HAVING count(*) = 2")
def capture_pair(spark, d):
    two = history.newest_per(M.captures(spark, d).where("status <> 'running'"), ["site_id"], [F.desc("started_at"), F.desc("id")], 2)
    at = F.struct("started_at", "id")
    return two.groupBy("site_id").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n")).where("n = 2").select("site_id", F.col("a.id").alias("before_id"), F.col("b.id").alias("after_id"))


_LAST = """, placed AS (SELECT c.site_id, c.id, c.started_at, u.url FROM captures c JOIN capture_urls u ON u.capture_id = c.id WHERE u.error IS NULL),
held AS (SELECT site_id, capture_id, count(*) AS urls, min(url) AS example FROM (
  SELECT p.site_id, p.url, arg_max(p.id, (p.started_at, p.id)) AS capture_id FROM placed p GROUP BY p.site_id, p.url) l
  WHERE capture_id <> (SELECT arg_max(x.id, (x.started_at, x.id)) FROM placed x WHERE x.site_id = l.site_id) GROUP BY site_id, capture_id)"""


@query("last_copies", M.SQL + _LAST + " SELECT site_id, capture_id, urls, example FROM held")
def last_copies(spark, d):
    return history.last_copies(M.captures(spark, d), M.capture_urls(spark, d))


_SOURCES = """, records AS (SELECT DISTINCT capture_id, url, digest, line >= 5 AS revisit FROM capture_urls),
placed2 AS (SELECT r.*, c.site_id, c.started_at FROM records r JOIN captures c ON c.id = r.capture_id),
first_holder AS (SELECT url, digest, site_id, arg_min(capture_id, (started_at, capture_id)) AS source, min((started_at, capture_id)) AS at FROM placed2 WHERE NOT revisit GROUP BY ALL),
sources AS (SELECT f.source AS capture_id, count(DISTINCT p.capture_id) AS dependents FROM placed2 p JOIN first_holder f ON f.url = p.url AND f.digest = p.digest AND f.site_id = p.site_id
  WHERE p.revisit AND f.at < (p.started_at, p.capture_id) GROUP BY 1)"""


def _records(spark, d):
    return M.capture_urls(spark, d).select("capture_id", "url", "digest", (F.col("line") >= 5).alias("revisit")).distinct()


@query("dedup_sources", M.SQL + _SOURCES + " SELECT capture_id, dependents FROM sources")
def dedup_sources(spark, d):
    return history.dedup_sources(M.captures(spark, d), _records(spark, d))


@query("dedup_first_seen", M.SQL + "SELECT url, digest, capture_id FROM capture_urls u JOIN captures c ON c.id = u.capture_id QUALIFY row_number() OVER (PARTITION BY url, digest ORDER BY started_at DESC, c.id DESC, line) = 1")
def dedup_first_seen(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    return history.newest_per(rows, ["url", "digest"], [F.desc("started_at"), F.desc("capture_id"), F.col("line")]).select("url", "digest", "capture_id")


_RETENTION = M.SQL + _LAST + _SOURCES + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at, id) AS nth, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, id DESC) AS age_rank FROM captures),
monthly AS (SELECT id FROM (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY m DESC) AS mr, row_number() OVER (PARTITION BY site_id, m ORDER BY age_rank) AS im
  FROM (SELECT *, strftime(started_at, '%Y-%m') AS m FROM ranked WHERE age_rank > 3)) WHERE im = 1 AND mr <= 6),
reasoned AS (SELECT r.site_id, r.id AS capture_id, CASE WHEN nth = 1 THEN 'first' WHEN status NOT IN ('ok', 'partial') THEN 'running' WHEN age_rank <= 3 THEN 'newest'
  WHEN r.id IN (SELECT id FROM monthly) THEN 'monthly' WHEN floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(r.started_at)) / 86400000000) < 400 THEN 'min-age'
  WHEN r.id IN (SELECT capture_id FROM held) THEN 'last-copy' WHEN r.id IN (SELECT capture_id FROM sources) THEN 'dedup-source' END AS why FROM ranked r)"""


@query("retention_plan", _RETENTION + " SELECT site_id, capture_id, why IS NOT NULL AS keep, coalesce(why, 'prunable') AS reason FROM reasoned")
def retention_plan(spark, d):
    captures = M.captures(spark, d)
    held = history.last_copies(captures, M.capture_urls(spark, d))
    return history.retention_plan(captures, held, history.dedup_sources(captures, _records(spark, d)), NOW, min_age_days=400)


@query("retention_applied", _RETENTION + " SELECT capture_id, why IS NULL AS deleted FROM reasoned WHERE capture_id % 3 = 0")
def retention_applied(spark, d):
    """Of the captures asked for, those that a plan made anew lets go."""
    asked = M.captures(spark, d).where("id % 3 = 0").select(F.col("id").alias("capture_id"))
    return history.apply_plan(asked, retention_plan(spark, d))


@query("retention_due_sites", _RETENTION + " SELECT DISTINCT site_id FROM reasoned WHERE why IS NULL AND site_id % 2 = 0")
def retention_due_sites(spark, d):
    """Sites whose policy is on and that have a capture to prune."""
    policies = M.sites(spark, d).select(F.col("id").alias("site_id"), (F.col("id") % 2 == 0).alias("on"))
    return history.due_sites(retention_plan(spark, d), policies)


@query("retention_settings", M.SQL + "SELECT id, '{\"keep_last\": ' || CASE WHEN id % 3 = 0 THEN id ELSE 5 END || ', \"keep_monthly\": 6}' AS policy FROM sites")
def retention_settings(spark, d):
    """Settings in layers: the default, the instance's, and the site's where it has some."""
    site = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("keep_last"), F.col("id")))
    layers = [F.create_map(F.lit("keep_last"), F.lit(3).cast("long"), F.lit("keep_monthly"), F.lit(6).cast("long")), F.create_map(F.lit("keep_last"), F.lit(5).cast("long")), site]
    policy = F.array_sort(F.map_entries(matching.overlaid(*layers)))
    text = F.concat(F.lit("{"), F.array_join(F.transform(policy, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string"))), ", "), F.lit("}"))
    return M.sites(spark, d).select("id", text.alias("policy"))


_SNAP = """, snap AS (SELECT url, max(capture_urls.bytes) FILTER (started_at < TIMESTAMP '1995-07-01') AS x, max(capture_urls.bytes) FILTER (started_at >= TIMESTAMP '1995-07-01') AS y FROM capture_urls JOIN captures c ON c.id = capture_id GROUP BY url)"""


@query("capture_diff", M.SQL + _SNAP + " SELECT url, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x = y THEN 'unchanged' ELSE 'changed' END AS change FROM snap")
def capture_diff(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    early = F.col("started_at") < F.lit("1995-07-01").cast("timestamp_ntz")
    snap = lambda c: rows.where(c).groupBy("url").agg(F.max("bytes").alias("bytes"))
    return history.changed_pages(snap(early), snap(~early), "url", "bytes")


_RES = """, newest AS (SELECT url, started_at < TIMESTAMP '1995-07-01' AS early, arg_max(digest, (started_at, capture_id, line, digest)) AS digest FROM capture_urls JOIN captures c ON c.id = capture_id GROUP BY ALL)"""


@query("resource_diff", M.SQL + _RES + """ SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT * FROM newest WHERE early) a FULL JOIN (SELECT * FROM newest WHERE NOT early) b ON a.url = b.url""")
def resource_diff(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    early = F.col("started_at") < F.lit("1995-07-01").cast("timestamp_ntz")
    last = lambda c: rows.where(c).groupBy("url").agg(F.max_by("digest", F.struct("started_at", "capture_id", "line", "digest")).alias("digest"))
    return history.changed_pages(last(early), last(~early), "url", "digest")


@query("host_drift", M.SQL + """, x AS (SELECT DISTINCT key FROM observations WHERE ts < TIMESTAMP '2024-01-03'), y AS (SELECT DISTINCT key FROM observations WHERE ts >= TIMESTAMP '2024-01-30')
SELECT key, 'gone' AS change FROM x WHERE key NOT IN (SELECT key FROM y) UNION ALL SELECT key, 'new' FROM y WHERE key NOT IN (SELECT key FROM x)""")
def host_drift(spark, d):
    rows = M.observations(spark, d)
    moment = lambda t: F.lit(t).cast("timestamp_ntz")
    return history.drift(rows.where(F.col("ts") < moment("2024-01-03")), rows.where(F.col("ts") >= moment("2024-01-30")), "key")


@query("queue_claim", M.SQL + """, jobs AS (SELECT id, CASE WHEN priority = '5-LOW' THEN NULL ELSE site_id END AS host, priority, started_at FROM captures WHERE status = 'partial'),
busy AS (SELECT DISTINCT site_id FROM captures WHERE status = 'running'), free AS (SELECT * FROM jobs WHERE host IS NULL OR host NOT IN (SELECT site_id FROM busy)),
one AS (SELECT * FROM free WHERE host IS NULL UNION ALL (SELECT * FROM free WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority, started_at, id) = 1))
SELECT id, host FROM one ORDER BY priority, started_at, id LIMIT 40""")
def queue_claim(spark, d):
    rows = M.captures(spark, d)
    jobs = rows.where("status = 'partial'").select("id", F.when(F.col("priority") != "5-LOW", F.col("site_id")).alias("host"), "priority", F.col("started_at").alias("queued_at"))
    busy = rows.where("status = 'running'").select(F.col("site_id").alias("host"))
    return history.claimed(jobs, busy, 40).select("id", "host")


@query("index_upsert", M.SQL + """, latest AS (SELECT site_id, url, u.bytes FROM capture_urls u JOIN captures c ON c.id = u.capture_id QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY started_at DESC, c.id DESC, line DESC, u.bytes DESC) = 1)
SELECT site_id, url, bytes FROM latest""")
def index_upsert(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "site_id", "started_at"), "capture_id")
    newest = lambda r: history.newest_per(r, ["site_id", "url"], [F.desc("started_at"), F.desc("capture_id"), F.desc("line"), F.desc("bytes")])
    early = F.col("started_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    out = history.upserted(newest(rows.where(early)), newest(rows.where(~early)), ["site_id", "url"])
    return out.select("site_id", "url", "bytes")


@query("index_drop_capture", M.SQL + ", drop AS (SELECT id FROM captures WHERE status = 'running') SELECT site_id, count(*) AS n FROM capture_urls JOIN captures ON id = capture_id WHERE capture_id NOT IN (SELECT id FROM drop) GROUP BY site_id")
def index_drop_capture(spark, d):
    captures = M.captures(spark, d)
    gone = captures.where("status = 'running'").select(F.col("id").alias("capture_id"))
    rows = M.capture_urls(spark, d).select("capture_id").join(gone, "capture_id", "left_anti")
    return rows.join(captures.select(F.col("id").alias("capture_id"), "site_id"), "capture_id").groupBy("site_id").agg(F.count("*").alias("n"))


@query("unindexed_sites", M.SQL + "SELECT DISTINCT s.id FROM sites s JOIN captures c ON c.site_id = s.id WHERE s.id NOT IN (SELECT site_id FROM captures WHERE status = 'ok')")
def unindexed_sites(spark, d):
    captures = M.captures(spark, d)
    indexed = captures.where("status = 'ok'").select(F.col("site_id").alias("id")).distinct()
    return M.sites(spark, d).select("id").join(captures.select(F.col("site_id").alias("id")), "id", "left_semi").join(indexed, "id", "left_anti")


@query("integrity_findings", M.SQL + """, artifacts AS (SELECT capture_id, 'f' || line AS name, bytes AS size, CASE WHEN line % 4 <> 0 THEN digest END AS sha FROM capture_urls),
files AS (SELECT capture_id, 'f' || line AS name, CASE WHEN status_code = 404 AND line = 2 THEN bytes - 1 ELSE bytes END AS size, CASE WHEN error IS NOT NULL AND line = 3 THEN 'x' ELSE digest END AS sha FROM capture_urls WHERE NOT (error IS NOT NULL AND line = 1)),
f AS (SELECT a.capture_id, a.name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.size <> b.size THEN 'size differs' WHEN a.sha IS NULL THEN 'no checksum' WHEN a.sha <> b.sha THEN 'checksum differs' END AS finding FROM artifacts a LEFT JOIN files b ON a.capture_id = b.capture_id AND a.name = b.name)
SELECT * FROM f WHERE finding IS NOT NULL""")
def integrity_findings(spark, d):
    rows = M.capture_urls(spark, d)
    name = F.concat(F.lit("f"), F.col("line").cast("string")).alias("name")
    artifacts = rows.select("capture_id", name, F.col("bytes").alias("size"), F.when(F.col("line") % 4 != 0, F.col("digest")).alias("sha256"))
    files = rows.where(~(F.col("error").isNotNull() & (F.col("line") == 1)))
    size = F.when((F.col("status_code") == 404) & (F.col("line") == 2), F.col("bytes") - 1).otherwise(F.col("bytes"))
    sha = F.when(F.col("error").isNotNull() & (F.col("line") == 3), "x").otherwise(F.col("digest"))
    return history.integrity(artifacts, files.select("capture_id", name, size.alias("size"), sha.alias("sha256")))


@query("verified_coverage", M.SQL + "SELECT count(*) AS total, count(DISTINCT site_id) FILTER (status = 'ok') AS verified_sites, CAST(arg_min(id, (started_at, id)) FILTER (status <> 'ok') AS BIGINT) AS oldest_unverified FROM captures")
def verified_coverage(spark, d):
    bad = F.col("status") != "ok"
    rows = M.captures(spark, d)
    return rows.agg(F.count("*").alias("total"), F.countDistinct(F.when(~bad, F.col("site_id"))).alias("verified_sites"), F.min(F.when(bad, F.struct("started_at", "id"))).alias("o")).select("total", "verified_sites", F.col("o.id").alias("oldest_unverified"))


@query("partial_reasons", M.SQL + """, s AS (SELECT capture_id, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (status_code >= 400) AS refused, count(*) AS n FROM capture_urls GROUP BY capture_id)
SELECT capture_id, nullif(concat_ws(',', CASE WHEN errors > 0 THEN 'errors' END, CASE WHEN 2 * refused > n THEN 'mostly refused' END, CASE WHEN n = 1 THEN 'single page' END), '') AS reasons FROM s""")
def partial_reasons(spark, d):
    s = M.capture_urls(spark, d).groupBy("capture_id").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("status_code") >= 400).alias("refused"), F.count("*").alias("n"))
    given = F.array_compact(F.array(F.when(F.col("errors") > 0, "errors"), F.when(2 * F.col("refused") > F.col("n"), "mostly refused"), F.when(F.col("n") == 1, "single page")))
    return s.select("capture_id", F.when(F.size(given) > 0, F.array_join(given, ",")).alias("reasons"))
