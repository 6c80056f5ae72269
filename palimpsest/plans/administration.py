"""Queries about scopes, lookups, imports and accounts: one for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import ledger, lookup, scopes, upkeep
from palimpsest.plans import model as M
from palimpsest.plans.registry import query

# Sites are customers.  Every third has no rule; the others have one for each of up to three hosts.
_SCOPES = """, scope_sites AS (SELECT id AS site_id, 'https://h' || (id % 10) || '.example.org/' AS seed_url,
  '{"preset": "' || CASE id % 4 WHEN 0 THEN 'lean' WHEN 1 THEN 'wide' ELSE '' END || '", "max_pages": ' || (id * 10) || CASE WHEN id % 5 = 0 THEN ', "obey_robots": false' ELSE '' END || '}' AS settings FROM sites),
rules AS (SELECT id * 10 + n AS id, id AS site_id, 'h' || ((id + n) % 10) || '.example.org' AS host, n = 0 AS crawl_pages FROM sites, range(3) r(n) WHERE id % 3 <> 0),
patterns AS (SELECT id * 10 + n AS id, id AS site_id, CASE WHEN n % 2 = 0 THEN 'reject' ELSE 'accept' END AS kind, '/p' || n AS pattern FROM sites, range(4) r(n) WHERE id % 2 = 0)"""


def _scope_rows(spark, d):
    ids = M.sites(spark, d).select("id")
    sites = ids.select(
        F.col("id").alias("site_id"),
        F.concat(F.lit("https://h"), (F.col("id") % 10).cast("string"), F.lit(".example.org/")).alias("seed_url"),
        F.concat(F.lit('{"preset": "'), F.when(F.col("id") % 4 == 0, "lean").when(F.col("id") % 4 == 1, "wide").otherwise(""), F.lit('", "max_pages": '), (F.col("id") * 10).cast("string"), F.when(F.col("id") % 5 == 0, ', "obey_robots": false').otherwise(""), F.lit("}")).alias("settings"),
    )
    each = lambda n: ids.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    host = F.concat(F.lit("h"), ((F.col("id") + F.col("n")) % 10).cast("string"), F.lit(".example.org"))
    none = F.lit(None).cast("string")
    rules = each(3).where("id % 3 <> 0").select((F.col("id") * 10 + F.col("n")).alias("id"), F.col("id").alias("site_id"), host.alias("host"), (F.col("n") == 0).alias("crawl_pages"), F.lit(True).alias("fetch_assets"), none.alias("path_prefix"), F.lit(False).alias("allow_extensionless"))
    patterns = each(4).where("id % 2 = 0").select((F.col("id") * 10 + F.col("n")).alias("id"), F.col("id").alias("site_id"), F.when(F.col("n") % 2 == 0, "reject").otherwise("accept").alias("kind"), F.concat(F.lit("/p"), F.col("n").cast("string")).alias("pattern"))
    return sites, rules, patterns


def _scopes(spark, d):
    return scopes.assembled(*_scope_rows(spark, d))


@query("scope_assembled", M.SQL + _SCOPES + """ SELECT s.site_id, coalesce(h.hosts, 'h' || (s.site_id % 10) || '.example.org+') AS hosts, CASE WHEN h.hosts IS NULL THEN '' ELSE coalesce(p.accept, '') END AS accept, CASE WHEN h.hosts IS NULL THEN '' ELSE coalesce(p.reject, '') END AS reject,
CASE WHEN h.hosts IS NOT NULL THEN s.site_id * 10 END AS max_pages, h.hosts IS NULL OR s.site_id % 5 <> 0 AS obey_robots FROM scope_sites s
LEFT JOIN (SELECT site_id, string_agg(host || CASE WHEN crawl_pages THEN '+' ELSE '' END, ' ' ORDER BY id) AS hosts FROM rules GROUP BY 1) h USING (site_id)
LEFT JOIN (SELECT site_id, string_agg(pattern, ' ' ORDER BY id) FILTER (kind = 'accept') AS accept, string_agg(pattern, ' ' ORDER BY id) FILTER (kind = 'reject') AS reject FROM patterns GROUP BY 1) p USING (site_id)""")
def scope_assembled(spark, d):
    hosts = F.array_join(F.transform("hosts", lambda h: F.concat(h["host"], F.when(h["crawl_pages"], "+").otherwise(""))), " ")
    return _scopes(spark, d).select("site_id", hosts.alias("hosts"), F.array_join("accept", " ").alias("accept"), F.array_join("reject", " ").alias("reject"), "max_pages", "obey_robots")


@query("scope_unindexed", M.SQL + "SELECT id AS site_id FROM sites WHERE id % 3 = 0")
def scope_unindexed(spark, d):
    sites, rules, _ = _scope_rows(spark, d)
    return scopes.unindexed(sites, rules).select("site_id")


@query("scope_skip_list", M.SQL + "SELECT id AS site_id, CASE id % 4 WHEN 1 THEN '/b /c' WHEN 2 THEN '/a /b' ELSE '/a /b /c' END AS skip, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS seeds FROM sites")
def scope_skip_list(spark, d):
    """The list for all sites without a site's exceptions; extra seeds are added, the seed itself only once."""
    ids = M.sites(spark, d).select("id")
    seed = F.concat(F.lit("https://h"), (F.col("id") % 10).cast("string"), F.lit(".example.org/"))
    exceptions = ids.where("id % 4 <> 3").select(F.col("id").alias("site_id"), F.when(F.col("id") % 4 == 1, F.array(F.lit("/a"))).when(F.col("id") % 4 == 2, F.array(F.lit("/c"), F.lit("/x"))).alias("exceptions"), F.when(F.col("id") % 2 == 0, F.array(seed, F.lit("https://more.example.org/"))).alias("extra_seeds"))
    return scopes.with_skip_list(_scopes(spark, d), ["/a", "/b", "/c"], exceptions).select("site_id", F.array_join("skip", " ").alias("skip"), F.size("seeds").cast("long").alias("seeds"))


@query("scope_companion", M.SQL + "SELECT id AS site_id, '/page/' AS accept, '/p2' AS reject, CAST(NULL AS BIGINT) AS max_pages FROM sites WHERE id % 3 <> 0 AND id % 4 = 0")
def scope_companion(spark, d):
    """The second pass that a recorded preset offers: its own accept pattern, its rejects lifted, no limit of pages."""
    presets = spark.createDataFrame([("lean", "/page/", ["/p0", "/none"]), ("wide", None, [])], "preset string, accept_pattern string, lifts array<string>")
    return scopes.companions(_scopes(spark, d), presets).select("site_id", F.array_join("accept", " ").alias("accept"), F.array_join("reject", " ").alias("reject"), "max_pages")


_FILES = """, files AS (SELECT CASE id % 4 WHEN 0 THEN 'captures/' || id || '/warc/a.warc.gz' WHEN 1 THEN 'captures/' || id || '/warc/b.warc' WHEN 2 THEN 'sites/captures/' || id || '/warc/c.warc.gz' ELSE 'captures/' || id || '/log.txt' END AS path FROM captures)"""


def _files(spark, d):
    end = F.when(F.col("id") % 4 == 0, "/warc/a.warc.gz").when(F.col("id") % 4 == 1, "/warc/b.warc").when(F.col("id") % 4 == 2, "/warc/c.warc.gz").otherwise("/log.txt")
    return M.captures(spark, d).select(F.concat(F.when(F.col("id") % 4 == 2, "sites/captures/").otherwise("captures/"), F.col("id").cast("string"), end).alias("path"))


@query("capture_files", M.SQL + _FILES + " SELECT path FROM files WHERE ends_with(path, '.warc.gz')")
def capture_files(spark, d):
    return lookup.capture_files(_files(spark, d))


# Index lines, keyed by the URL's number; the file of a capture is named after it.
_LINES = """, lines AS (SELECT DISTINCT printf('%09d', CAST(split_part(url, '/p/', 2) AS INT)) AS urlkey, CAST(capture_id AS VARCHAR) AS timestamp, 'captures/' || capture_id || '/warc/a.warc.gz' AS filename FROM capture_urls)"""


def _lines(spark, d):
    return M.capture_urls(spark, d).select(F.lpad(F.split_part("url", F.lit("/p/"), F.lit(2)), 9, "0").alias("urlkey"), F.col("capture_id").cast("string").alias("timestamp"), F.concat(F.lit("captures/"), F.col("capture_id").cast("string"), F.lit("/warc/a.warc.gz")).alias("filename")).distinct()


@query("index_not_relative", M.SQL + _LINES + " SELECT filename FROM (SELECT * FROM lines ORDER BY urlkey, timestamp LIMIT 1) WHERE CAST(timestamp AS BIGINT) >= 0")
def index_not_relative(spark, d):
    """An index whose files have bare names is refused: here the expected ones are."""
    expected = _lines(spark, d).select(F.lit("a.warc.gz").alias("filename")).distinct()
    return lookup.not_relative(_lines(spark, d), expected)


@query("index_first_at", M.SQL + _LINES + " SELECT urlkey, timestamp FROM lines WHERE urlkey >= '000000077x' ORDER BY urlkey, timestamp LIMIT 1")
def index_first_at(spark, d):
    return lookup.first_at_or_after(_lines(spark, d), "000000077x")


@query("records_from_capture", M.SQL + _LINES + " SELECT count(*) AS n FROM lines WHERE filename LIKE 'captures/1/%'")
def records_from_capture(spark, d):
    backslashed = F.translate("filename", "/", "\\")
    return _lines(spark, d).agg(F.count_if(lookup.from_capture(backslashed, F.lit("1"))).alias("n"))


@query("feed_candidates", M.SQL + "SELECT 'https://f' || capture_id || '.example.org/feed' AS url, count(*) AS entries, count(*) FILTER (host < 'h5') AS in_scope, CAST(least(count(*) FILTER (host >= 'h5'), 5) AS BIGINT) AS listed, array_to_string(list_slice(list('t' || line ORDER BY line, url), 1, 3), ' ') AS titles FROM capture_urls GROUP BY capture_id")
def feed_candidates(spark, d):
    rows = M.capture_urls(spark, d).withColumn("feed", F.concat(F.lit("https://f"), F.col("capture_id").cast("string"), F.lit(".example.org/feed")))
    entries = rows.select(F.col("feed").alias("url"), F.col("line").alias("place"), F.col("url").alias("entry_url"), F.concat(F.lit("t"), F.col("line").cast("string")).alias("title"))
    found = lookup.feed_candidates(rows.select(F.col("feed").alias("url")).distinct(), entries, F.col("entry_url") < "https://h5")
    return found.select("url", "entries", "in_scope", F.size("out_of_scope").cast("long").alias("listed"), F.array_join("titles", " ").alias("titles"))


@query("site_row", M.SQL + "SELECT id, title, status FROM sites WHERE id = 42")
def site_row(spark, d):
    return lookup.row_of(M.sites(spark, d).select("id", "title", "status"), "id", 42)


@query("busy_sites", M.SQL + "SELECT DISTINCT site_id FROM captures WHERE status = 'running' AND site_id <= 50")
def busy_sites(spark, d):
    return lookup.busy(M.sites(spark, d).where("id <= 50").select(F.col("id").alias("site_id")), M.captures(spark, d))


@query("html_records_newest", M.SQL + "SELECT capture_id, line FROM capture_urls WHERE status_code = 200 AND line % 2 = 0 ORDER BY capture_id DESC, line LIMIT 500")
def html_records_newest(spark, d):
    rows = M.capture_urls(spark, d).select("capture_id", F.col("line").alias("place"), F.lit("response").alias("rec_type"), "url", F.col("status_code").alias("status"), F.when(F.col("line") % 2 == 0, "text/HTML; charset=x").otherwise("image/png").alias("content_type"))
    return lookup.html_records(rows, 500, "capture_id").select("capture_id", F.col("place").alias("line"))


@query("artifact_lists", M.SQL + "SELECT id, CASE id % 4 WHEN 0 THEN 'm' || id WHEN 3 THEN NULL ELSE 'r' || id END AS name FROM captures")
def artifact_lists(spark, d):
    """A manifest's list first; an empty or broken one gives way to the catalogue's."""
    name = F.col("id").cast("string")
    manifest = F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"warc_files": [{"name": "m'), name, F.lit('"}]}'))).when(F.col("id") % 4 == 1, '{"warc_files": []}').when(F.col("id") % 4 == 2, "{broken")
    recorded = F.when(F.col("id") % 4 != 3, F.array(F.struct(F.concat(F.lit("r"), name).alias("name"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("sha256"))))
    rows = M.captures(spark, d).select("id", manifest.alias("manifest"), recorded.alias("warc_files"))
    return ledger.artifacts(rows).select("id", F.col("artifacts")[0]["name"].alias("name"))


@query("verifiable_captures", M.SQL + "SELECT id, site_id FROM captures WHERE status IN ('ok', 'partial') AND site_id % 7 = 0")
def verifiable_captures(spark, d):
    return ledger.verifiable(M.captures(spark, d), M.sites(spark, d).where("id % 7 = 0").select(F.col("id").alias("site_id"))).select("id", "site_id")


@query("verification_due", M.SQL + "SELECT id, started_at IS NULL OR TIMESTAMP '1998-01-01' - started_at >= INTERVAL 7 DAY AS due FROM (SELECT id, CASE WHEN id % 9 <> 0 THEN started_at END AS started_at FROM captures)")
def verification_due(spark, d):
    last = F.when(F.col("id") % 9 != 0, F.col("started_at"))
    return M.captures(spark, d).select("id", ledger.verification_due(last, F.lit("1998-01-01").cast("timestamp_ntz"), 7).alias("due"))


@query("expired_trash", M.SQL + "SELECT id FROM captures WHERE id % 3 = 0 AND started_at <= TIMESTAMP '1996-01-01' - INTERVAL 30 DAY")
def expired_trash(spark, d):
    rows = M.captures(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.col("started_at")).alias("deleted_at"))
    return ledger.expired_trash(rows, "1996-01-01", 30).select("id")


@query("live_sessions", M.SQL + "SELECT id FROM captures WHERE NOT (started_at <= TIMESTAMP '1995-01-01' OR (id % 2 = 0 AND started_at - INTERVAL 400 DAY < TIMESTAMP '1995-01-01' - INTERVAL 30 DAY))")
def live_sessions(spark, d):
    rows = M.captures(spark, d).select("id", F.col("started_at").alias("expires_at"), F.when(F.col("id") % 2 == 0, F.col("started_at") - F.expr("INTERVAL '400' DAY")).alias("revoked_at"))
    return ledger.live_sessions(rows, "1995-01-01").select("id")


@query("link_summaries", M.SQL + "SELECT capture_id, CASE WHEN count(*) FILTER (status_code = 404) = 0 THEN 'every one of ' || count(*) || ' in-scope link(s) resolves in the index' ELSE count(*) FILTER (status_code = 404) || ' link target(s) do not resolve in replay, from ' || count(DISTINCT host) || ' archived page(s) — e.g. ' || min(url) FILTER (status_code = 404) END AS summary FROM capture_urls GROUP BY capture_id")
def link_summaries(spark, d):
    dead = F.col("status_code") == 404
    per = M.capture_urls(spark, d).groupBy("capture_id").agg(F.count_if(dead).alias("dead"), F.count("*").alias("links"), F.countDistinct("host").alias("pages"), F.min(F.when(dead, F.col("url"))).alias("example"))
    return per.select("capture_id", ledger.link_summary(F.col("dead"), F.col("links"), F.col("pages"), F.col("example")).alias("summary"))


@query("change_summaries", M.SQL + "SELECT capture_id, coalesce(nullif(concat_ws(', ', CASE WHEN count(*) FILTER (line >= 5) > 0 THEN count(*) FILTER (line >= 5) || ' new' END, CASE WHEN count(error) > 0 THEN count(error) || ' gone' END), ''), 'no change') AS summary FROM capture_urls GROUP BY capture_id")
def change_summaries(spark, d):
    per = M.capture_urls(spark, d).groupBy("capture_id").agg(F.count_if(F.col("line") >= 5).alias("new"), F.count("error").alias("gone"))
    return per.select("capture_id", ledger.change_summary(F.col("new"), F.col("gone")).alias("summary"))


@query("health_report", M.SQL + "SELECT count(*) AS captures, count(*) FILTER (status = 'ok') AS verified, min(started_at) FILTER (status <> 'ok') AS oldest_unverified, max(started_at) FILTER (status = 'ok') AS last_run, (SELECT count(*) FROM capture_urls WHERE error IS NOT NULL) AS findings, TIMESTAMP '1999-01-01' - max(started_at) FILTER (status = 'ok') >= INTERVAL 7 DAY AS due FROM captures")
def health_report(spark, d):
    captures = M.captures(spark, d).select("started_at", F.when(F.col("status") == "ok", F.col("started_at")).alias("verified_at"))
    return ledger.health(captures, M.capture_urls(spark, d).where("error IS NOT NULL"), "1999-01-01", 7)


@query("import_plan", """SELECT CASE g WHEN 9 THEN 'localhost' ELSE 'site' || g || '.com' END AS registrable, CASE WHEN g < 4 THEN CAST(g AS BIGINT) END AS site_id, CASE WHEN g = 9 THEN 'error' WHEN g < 4 THEN 'update' ELSE 'create' END AS action,
CASE WHEN g <> 9 THEN 'incremental' END AS kind, CASE WHEN g <> 9 THEN true END AS only_listed, string_agg('http://' || CASE g WHEN 9 THEN 'localhost' ELSE 'w.site' || g || '.com' END || '/' || p_partkey, ' ' ORDER BY p_partkey DESC) AS urls FROM (SELECT p_partkey, CAST(p_partkey % 10 AS INT) AS g FROM part) GROUP BY g""")
def import_plan(spark, d):
    group = F.col("p_partkey") % 10
    host = F.when(group == 9, "localhost").otherwise(F.concat(F.lit("w.site"), group.cast("string"), F.lit(".com")))
    found = M.table(spark, d, "part").select(F.concat(F.lit("http://"), host, F.lit("/"), F.col("p_partkey").cast("string")).alias("url"), (-F.col("p_partkey")).alias("place"))
    sites = spark.range(4).select("id", F.concat(F.lit("Site"), F.col("id").cast("string"), F.lit(".com")).alias("host"))
    return ledger.import_plan(found, sites).withColumn("urls", F.array_join("urls", " "))


@query("archive_import", "SELECT CASE g WHEN 0 THEN 'unknown' WHEN 1 THEN 'intranet' ELSE 'h' || g || '.org' END AS host, count(*) AS snapshots, CAST(sum(p_size % 3) AS BIGINT) AS files, CASE WHEN g < 2 THEN count(*) ELSE 0 END AS skipped FROM (SELECT *, p_partkey % 10 AS g FROM part) WHERE p_size % 3 > 0 GROUP BY g")
def archive_import(spark, d):
    group = F.col("p_partkey") % 10
    url = F.when(group == 0, "about:blank").when(group == 1, "http://intranet/x").otherwise(F.concat(F.lit("http://h"), group.cast("string"), F.lit(".org/x")))
    rows = M.table(spark, d, "part").select(url.alias("url"), F.array_repeat(F.lit("f"), (F.col("p_size") % 3).cast("int")).alias("files"))
    return ledger.archive_import(rows)


@query("rejected_urls", "SELECT p_partkey AS id, CAST(1 AS INT) AS place, 'http://a.org:' || (60000 + p_partkey * 50) || '/x' AS candidate, 'bad port' AS reason FROM part WHERE 60000 + p_partkey * 50 > 65535 UNION ALL SELECT p_partkey, 2, 'https://', 'no host name' FROM part")
def rejected_urls(spark, d):
    """A good address, one with a port that may be too large, and one without a host."""
    text = F.concat(F.lit("see http://b.org/y, http://a.org:"), (60000 + F.col("p_partkey") * 50).cast("string"), F.lit("/x! and https:// end"))
    return ledger.rejected(M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("script_directives", "SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_name END AS name, CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'document-start' ELSE 'document-idle' END END AS run_at, CASE WHEN p_size % 5 <> 0 THEN '*://*.a.org/* *://b.org/' || p_size END AS matches, CASE WHEN p_size % 5 <> 0 THEN '*/no */never' END AS excludes FROM part")
def script_directives(spark, d):
    head = F.concat(F.lit("// ==UserScript==\n// @name   "), F.col("p_name"), F.lit("\n// @name other\n// @match *://*.a.org/*\n//  @match\t*://b.org/"), F.col("p_size").cast("string"), F.lit(" \n// @matches no\n// @exclude */no\n// @exclude-match */never\n"), F.when(F.col("p_size") % 2 == 0, "// @run-at document-start\n").otherwise("// @run-at\n"), F.when(F.col("p_size") % 5 != 0, "// ==/UserScript==\n").otherwise(""), F.lit("alert(1) // @match late"))
    s = ledger.script_directives(head)
    rows = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))
    return rows.select("id", "s.name", "s.run_at", F.array_join("s.matches", " ").alias("matches"), F.array_join("s.excludes", " ").alias("excludes"))


@query("audit_log", M.SQL + "SELECT kind AS action, count(*) AS n, max(ts) AS last FROM observations GROUP BY kind UNION ALL SELECT 'start', 1, TIMESTAMP '2000-01-01'")
def audit_log(spark, d):
    detail = F.create_map(F.lit("value"), F.col("value").cast("string"))
    log = spark.sql("SELECT TIMESTAMP_NTZ '2000-01-01' AS ts, 'start' AS action, CAST(NULL AS STRING) AS actor, CAST(NULL AS STRING) AS target, CAST(NULL AS MAP<STRING, STRING>) AS detail")
    rows = M.observations(spark, d).select("ts", F.col("kind").alias("action"), F.col("key").cast("string").alias("actor"), F.lit(None).cast("string").alias("target"), detail.alias("detail"))
    return ledger.audited(log, rows).where("detail IS NULL OR element_at(detail, 'value') IS NOT NULL").groupBy("action").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("login_lockouts", M.SQL + "SELECT key AS name, n AS failed, CASE WHEN n >= 8 THEN last + INTERVAL 1 SECOND * least(60 * power(2, least(n - 8, 20)), 3600) END AS locked_until FROM (SELECT key, count(*) AS n, max(ts) AS last FROM observations WHERE kind = 'click' GROUP BY key)")
def login_lockouts(spark, d):
    failures = M.observations(spark, d).where("kind = 'click'").select(F.col("key").alias("name"), "ts")
    accounts = failures.select("name").distinct().withColumn("failed", F.lit(0).cast("long"))
    return ledger.failed_logins(accounts, failures, 8)


@query("report_periods", M.SQL + "SELECT id, TIMESTAMP '1998-01-01' - started_at >= INTERVAL 30 DAY AS due FROM captures")
def report_periods(spark, d):
    """Whether a full period has passed since the last report."""
    return M.captures(spark, d).select("id", scalars.elapsed(F.lit("1998-01-01").cast("timestamp_ntz"), F.col("started_at"), 30).alias("due"))


@query("report_lines", M.SQL + "SELECT site_id, concat_ws('; ', CASE WHEN count(*) FILTER (status = 'ok') = 1 THEN '1 capture' WHEN count(*) FILTER (status = 'ok') > 1 THEN count(*) FILTER (status = 'ok') || ' captures' END, CASE WHEN count(*) FILTER (status = 'running') = 1 THEN '1 failure' WHEN count(*) FILTER (status = 'running') > 1 THEN count(*) FILTER (status = 'running') || ' failures' END) AS text FROM captures GROUP BY site_id")
def report_lines(spark, d):
    per = M.captures(spark, d).groupBy("site_id").agg(F.count_if(F.col("status") == "ok").alias("captures"), F.count_if(F.col("status") == "running").alias("failures"))
    return per.select("site_id", upkeep.report_line("captures", "failures").alias("text"))
