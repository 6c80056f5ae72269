"""Queries about hosts, audits, imports, exports and reading."""

from __future__ import annotations

import sqlite3

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions import urls
from palimpsest.operators import audit, export, extract, gates, hosts, imports, reading
from palimpsest.plans import model as M
from palimpsest.plans.registry import query
from palimpsest.sources import ranges, sqlite

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query("host_statistics", f"""WITH r AS (SELECT {_HOST} AS host, url FROM pages), s AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) AS n FROM (SELECT DISTINCT host, url FROM r))
SELECT host, (SELECT count(*) FROM r WHERE r.host = s.host) AS link_refs, count(*) AS distinct_urls, string_agg(url, ' ' ORDER BY url) FILTER (n <= 5) AS samples FROM s GROUP BY host""")
def host_statistics(spark, d):
    refs = M.table(spark, d, "pages").select("url", F.lit("link").alias("kind"), F.lit(None).cast("string").alias("mime"))
    return hosts.statistics(refs, "none").select("host", "link_refs", "distinct_urls", F.array_join("samples", " ").alias("samples"))


@query("host_roles", M.SQL + """, r AS (SELECT host, count(*) FILTER (line < 4) AS links, count(*) FILTER (line >= 4) AS assets FROM capture_urls GROUP BY host)
SELECT host, CASE WHEN host = 'h1.example.org' THEN 'self' WHEN assets > 0 AND links = 0 THEN 'cdn' ELSE 'unknown' END AS role, CASE WHEN host = 'h1.example.org' THEN 'seed' WHEN host = 'h2.example.org' THEN 'preset off' WHEN assets > 0 AND links = 0 THEN 'assets only' ELSE 'review' END AS reason FROM r""")
def host_roles(spark, d):
    refs = M.capture_urls(spark, d).select("url", F.when(F.col("line") >= 4, "asset").otherwise("link").alias("kind"), F.lit("text/html").alias("mime"))
    return hosts.defaults(hosts.statistics(refs, "h1.example.org"), hosts_off=["h2.example.org"]).select("host", "role", "reason")


@query("missing_by_scope", M.SQL + """SELECT CASE WHEN host NOT IN ('h1.example.org', 'h2.example.org', 'h3.example.org') OR host = 'h4.example.org' OR regexp_matches(url, '/p/7[0-9]*$') OR host = 'h2.example.org' THEN 'excluded' ELSE 'absent' END AS why, count(*) AS n
FROM (SELECT DISTINCT url, host FROM capture_urls WHERE url NOT IN (SELECT url FROM capture_urls WHERE error IS NULL)) GROUP BY 1""")
def missing_by_scope(spark, d):
    """Assets that no capture has, apart by whether somebody chose so; h2 gives only assets and these paths have no ending."""
    rows = M.capture_urls(spark, d)
    scope = hosts.Scope(("http://h1.example.org/",), (hosts.Rule("h1.example.org", True), hosts.Rule("h2.example.org"), hosts.Rule("h3.example.org", True)), (r"/p/7[0-9]*$", "("), ("h4.example.org",))
    missing = audit.missing_assets(rows, rows.where("error IS NULL"))
    return scope.split_missing(missing).groupBy("why").agg(F.count("*").alias("n"))


@query("crawlable_urls", M.SQL + "SELECT count(*) AS n, count(*) FILTER (host IN ('h1.example.org', 'h3.example.org') AND NOT regexp_matches(url, '/p/7[0-9]*$')) AS crawlable FROM capture_urls")
def crawlable_urls(spark, d):
    scope = hosts.Scope(("http://h1.example.org/",), (hosts.Rule("h1.example.org", True), hosts.Rule("h2.example.org"), hosts.Rule("h3.example.org", True)), (r"/p/7[0-9]*$",))
    return M.capture_urls(spark, d).agg(F.count("*").alias("n"), F.count_if(scope.crawlable(F.col("url"))).alias("crawlable"))


@query("gate_counts", "SELECT CAST(0 AS BIGINT) AS gates, count(*) AS scanned, CAST(0 AS BIGINT) AS overlaid, count(*) FILTER (strlen(html) <= 24000 AND regexp_matches(html, '(?i)I understand and wish to continue|content\\s+warning|blog\\s+contains\\s+content\\s+.{0,40}adult|viewer\\s+discretion|you\\s+must\\s+be\\s+(?:18|21|of\\s+legal\\s+age)')) AS blocked FROM pages")
def gate_counts(spark, d):
    return audit.gate_counts(M.table(spark, d, "pages"))


@query("platform_votes", """WITH v AS (SELECT CASE WHEN regexp_matches(html, 'blogger[.]com/(static|dyn-css)|blogblog[.]com|_WidgetManager') THEN 'blogger' WHEN contains(html, '/wp-content/') OR contains(html, '/wp-includes/') THEN 'wordpress'
WHEN regexp_matches(html, 'ghost-sdk|/ghost/api/') THEN 'ghost' WHEN regexp_matches(html, 'substackcdn[.]com|substack[.]com/api') THEN 'substack' WHEN regexp_matches(html, 'SQUARESPACE_CONTEXT|squarespace-cdn[.]com|squarespace[.]com/') THEN 'squarespace'
WHEN regexp_matches(html, 'wgPageName|mw-content-text|/load[.]php[?]') THEN 'mediawiki' WHEN regexp_matches(html, 'discourse-cdn[.]com|/message-bus/|discourse_theme_id') THEN 'discourse' ELSE 'none' END AS platform FROM pages) SELECT platform, count(*) AS n FROM v GROUP BY 1""")
def platform_votes(spark, d):
    none = F.lit(None).cast("string")
    p = hosts.platform(none, F.col("url"), none, F.col("html"))
    return M.table(spark, d, "pages").groupBy(F.coalesce(p["platform"], F.lit("none")).alias("platform")).agg(F.count("*").alias("n"))


@query("backup_coverage", M.SQL + "SELECT CASE WHEN status = 'running' THEN 'missing' ELSE 'present' END AS state, count(*) AS n FROM captures GROUP BY 1 UNION ALL SELECT 'unknown', 1")
def backup_coverage(spark, d):
    rows = M.captures(spark, d)
    name = F.concat(F.lit("c"), F.col("id").cast("string")).alias("dir_name")
    there = rows.where("status <> 'running'").select(name).unionByName(spark.sql("SELECT 'stray' AS dir_name"))
    return audit.backup_coverage(rows.select(name), there).groupBy("state").agg(F.count("*").alias("n"))


@query("log_revisits", M.SQL + "SELECT DISTINCT url FROM capture_urls WHERE url NOT IN (SELECT url FROM capture_urls WHERE line < 5)")
def log_revisits(spark, d):
    from palimpsest.sources import lines

    rows = M.capture_urls(spark, d)
    log = rows.select(F.concat(F.lit("2024-01-01 00:00:00 URL:"), "url", F.lit(' [1/1] -> "x" [1]')).alias("value"))
    return audit.revisits(log.select(lines.log_url(F.col("value")).alias("url")), rows.where("line < 5"))


@query("capture_projection", M.SQL + "SELECT capture_id, round(count(*) * 60.0 / 30, 4) AS per_minute, greatest(10 - count(*), 0) AS remaining, round(greatest(10 - count(*), 0) / (count(*) * 60.0 / 30), 4) AS eta_minutes FROM capture_urls GROUP BY capture_id")
def capture_projection(spark, d):
    rows = M.capture_urls(spark, d).groupBy("capture_id").agg(F.count("*").alias("n"))
    p = audit.projection(F.col("n"), F.lit(30), F.lit(10).cast("bigint"))
    return rows.select("capture_id", F.round(p["per_minute"], 4).alias("per_minute"), p["remaining"].alias("remaining"), F.round(p["eta_minutes"], 4).alias("eta_minutes"))


@query("import_groups", f"SELECT array_to_string(string_split({_HOST}, '.')[-2:], '.') AS registrable, count(DISTINCT regexp_replace(url, '#.*$', '')) AS n, count(DISTINCT {_HOST}) AS hosts, CASE WHEN array_to_string(string_split({_HOST}, '.')[-2:], '.') = 'example.com' THEN CAST(1 AS BIGINT) END AS site_id FROM pages GROUP BY ALL")
def import_groups(spark, d):
    """A pasted list of all page addresses, by the site that each would go to."""
    texts = M.table(spark, d, "pages").select(F.lit(1).alias("id"), F.concat(F.lit("see "), "url", F.lit(" !")).alias("text"))
    found = imports.listed(texts, cap=None).select("url").distinct()
    return imports.grouped(found, spark.sql("SELECT CAST(1 AS BIGINT) AS id, 'www.example.com' AS host")).select("registrable", "n", "hosts", "site_id")


_OWNERS = f"""WITH h AS (SELECT url, {_HOST} AS host, string_split({_HOST}, '.') AS l FROM pages), r AS (SELECT DISTINCT array_to_string(l[-2:], '.') AS rule FROM h WHERE len(l) >= 3),
o AS (SELECT url, host, CASE WHEN array_to_string(l[-2:], '.') NOT IN (SELECT rule FROM r) THEN array_to_string(l[-2:], '.') WHEN len(l) >= 3 THEN array_to_string(l[-3:], '.') ELSE '' END AS registrable FROM h)"""


def _suffixes(spark, d):
    """A suffix list that the pages' hosts make: their last labels, and the last two of those with three or more."""
    labels = F.split(urls.host(F.col("url")), "[.]")
    rows = M.table(spark, d, "pages").select(labels.alias("l")).distinct()
    last = lambda n: F.array_join(F.slice("l", F.size("l") - (n - 1), F.lit(n)), ".").alias("rule")
    return rows.select(F.element_at("l", -1).alias("rule")).unionByName(rows.where(F.size("l") >= 3).select(last(2))).distinct()


@query("import_groups_by_list", _OWNERS + " SELECT registrable, count(DISTINCT regexp_replace(url, '#.*$', '')) AS n, count(DISTINCT host) AS hosts FROM o GROUP BY registrable")
def import_groups_by_list(spark, d):
    """The groups of a pasted list by a suffix list."""
    texts = M.table(spark, d, "pages").select(F.lit(1).alias("id"), F.concat(F.lit("see "), "url", F.lit(" !")).alias("text"))
    found = imports.listed(texts, cap=None).select("url").distinct()
    return imports.grouped(found, found.limit(0).select(F.lit(1).alias("id"), F.col("url").alias("host")), _suffixes(spark, d)).select("registrable", "n", "hosts")


@query("host_owners", _OWNERS + " SELECT host, registrable, count(*) AS link_refs FROM o GROUP BY host, registrable")
def host_owners(spark, d):
    """Hosts of pages with their owners by a suffix list."""
    refs = M.table(spark, d, "pages").select("url", F.lit("link").alias("kind"), F.lit(None).cast("string").alias("mime"))
    return hosts.statistics(refs, "none", _suffixes(spark, d)).select("host", "registrable", "link_refs")


@query("import_snapshots", M.SQL + "SELECT s.id, coalesce(string_agg(st.slug, ',' ORDER BY st.slug), '') AS tags FROM sites s LEFT JOIN site_tags st ON st.site_id = s.id WHERE s.id % 10 <> 0 GROUP BY s.id")
def import_snapshots(spark, d):
    rows = M.sites(spark, d).select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("http://x/"), F.col("id").cast("string"))).alias("url"), F.lit("1700000000.0").alias("timestamp"))
    slugs = M.tags(spark, d).select("slug").distinct()
    ids = slugs.select(F.xxhash64("slug").alias("id"), F.col("slug").alias("name"))
    bridge = M.site_tags(spark, d).select(F.col("site_id").alias("snapshot_id"), F.xxhash64("slug").alias("tag_id"))
    return imports.snapshots(rows, bridge, ids).select("id", F.array_join("tags", ",").alias("tags"))


def _foreign_index(packed: dict) -> bytes:
    """A SQLite file of snapshots (id, url, title, tags) as a foreign archive keeps them."""
    rows = packed["rows"]
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE core_snapshot (id TEXT, timestamp TEXT, url TEXT, title TEXT, added TEXT); CREATE TABLE core_tag (id INTEGER, name TEXT); CREATE TABLE core_snapshot_tags (snapshot_id TEXT, tag_id INTEGER)")
    names = sorted({t for r in rows for t in r["tags"]})
    db.executemany("INSERT INTO core_tag VALUES (?, ?)", enumerate(names))
    db.executemany("INSERT INTO core_snapshot VALUES (?, '1700000000.0', ?, ?, '2024-01-01')", [(str(r["id"]), r["url"], r["title"]) for r in rows])
    db.executemany("INSERT INTO core_snapshot_tags VALUES (?, ?)", [(str(r["id"]), names.index(t)) for r in rows for t in r["tags"]])
    db.commit()
    return db.serialize()


@query("foreign_snapshots", M.SQL + "SELECT s.id, s.title, coalesce(string_agg(st.slug, ',' ORDER BY st.slug), '') AS tags FROM sites s LEFT JOIN site_tags st ON st.site_id = s.id WHERE s.id % 10 <> 0 GROUP BY s.id, s.title")
def foreign_snapshots(spark, d):
    """Snapshots and tags of all sites out of SQLite files, five hundred sites in each; one in ten has no address."""
    url = F.when(F.col("id") % 10 != 0, F.concat(F.lit("http://x/"), F.col("id").cast("string")))
    tags = M.site_tags(spark, d).groupBy(F.col("site_id").alias("id")).agg(F.collect_list("slug").alias("tags"))
    rows = M.sites(spark, d).join(tags, "id", "left").select(F.concat(F.lit("index"), F.expr("id div 500").cast("string"), F.lit(".sqlite3")).alias("file"), "id", url.alias("url"), "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    packed = rows.groupBy("file").agg(F.collect_list(F.struct("id", "url", "title", "tags")).alias("rows"))
    folder = storage.folder(spark, "foreign")
    storage.written(ranges.write_files(packed, folder, "file", [], _foreign_index, []), "files")
    found = sqlite.read_snapshots(spark, folder)
    return found.select(F.col("id").cast("long").alias("id"), "title", F.array_join("tags", ",").alias("tags"))


@query("import_seeds", f"SELECT {_HOST} AS host, arg_min(url, (length(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), url)) AS seed, count(*) AS n FROM pages GROUP BY 1")
def import_seeds(spark, d):
    return imports.seeds(M.table(spark, d, "pages"))


@query("export_names", M.SQL + """, f AS (SELECT 'captures/' || id || '/' || CASE WHEN id % 3 = 0 THEN 'data' ELSE 'd' || id END || '.warc.gz' AS path, CASE WHEN id % 3 = 0 THEN 'data' ELSE 'd' || id END || '.warc.gz' AS base, id FROM captures)
SELECT path, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN id || '-' || base ELSE base END AS name FROM f""")
def export_names(spark, d):
    text = F.col("id").cast("string")
    base = F.when(F.col("id") % 3 == 0, "data").otherwise(F.concat(F.lit("d"), text))
    return export.unique_names(M.captures(spark, d).select(F.concat(F.lit("captures/"), text, F.lit("/"), base, F.lit(".warc.gz")).alias("path")))


@query("export_problems", M.SQL + "SELECT url, CASE WHEN status_code = 404 THEN 'another page there' ELSE 'nothing there' END AS problem FROM (SELECT DISTINCT url, capture_id, line, digest, status_code, error FROM capture_urls) WHERE status_code = 404 OR error IS NOT NULL AND status_code = 200")
def export_problems(spark, d):
    rows = M.capture_urls(spark, d).select("url", "capture_id", "line", "digest", "status_code", "error").distinct()
    place = [F.concat_ws("/", F.col("capture_id").cast("string"), "url", "digest", F.coalesce("error", F.lit("-")), F.col("status_code").cast("string")).alias("filename"), F.col("line").alias("offset")]
    there = rows.where("status_code = 404 OR error IS NULL").select(*place, F.when(F.col("status_code") == 404, "other").otherwise(F.col("url")).alias("target"))
    return export.problems(rows.select("url", *place), there)


@query("export_page_list", M.SQL + """, r AS (SELECT url, strftime(started_at, '%Y%m%d%H%M%S') AS ts FROM capture_urls u JOIN captures c ON c.id = u.capture_id WHERE status_code = 200)
SELECT url, min(ts) AS timestamp, CASE WHEN regexp_matches(url, '1$') THEN 'Title of ' || url ELSE url END AS title FROM r GROUP BY url""")
def export_page_list(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    records = rows.select("url", F.col("url").alias("urlkey"), F.date_format("started_at", "yyyyMMddHHmmss").alias("timestamp"), F.lit("text/html").alias("mime"), F.col("status_code").alias("status"))
    titles = rows.select("url", F.when(F.col("url").rlike("1$"), F.concat(F.lit("Title of "), "url")).otherwise("").alias("title"), "capture_id")
    return reading.page_list(records, titles)


@query("page_versions", M.SQL + "SELECT url, count(DISTINCT capture_id) AS n FROM capture_urls GROUP BY url")
def page_versions(spark, d):
    return reading.versions(M.capture_urls(spark, d), M.captures(spark, d)).groupBy("url").agg(F.count("*").alias("n"))


@query("thumbnail_subject", M.SQL + """, r AS (SELECT url, strftime(started_at, '%Y%m%d%H%M%S') AS timestamp FROM capture_urls u JOIN captures c ON c.id = u.capture_id)
SELECT url, max(timestamp) AS timestamp FROM r WHERE url = (SELECT min(url) FROM r) GROUP BY url""")
def thumbnail_subject(spark, d):
    rows = M.capture_urls(spark, d).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    records = rows.select("url", F.col("url").alias("urlkey"), F.date_format("started_at", "yyyyMMddHHmmss").alias("timestamp"))
    seeds = spark.sql("SELECT 'http://absent/' AS url, 0 AS place").unionByName(records.agg(F.min("url").alias("url")).withColumn("place", F.lit(1)))
    return reading.newest_of_seeds(records, seeds).select("url", "timestamp")


@query("annotation_places")
def annotation_places(spark, d):
    """A quote from each page, looked for in the page."""
    pages = extract.page_blocks(M.table(spark, d, "pages"))
    rows = M.table(spark, d, "pages").select("page_id", "url").join(pages, "page_id").where(F.size("blocks") > 0)
    quote = F.substring(F.element_at("blocks", -1), 3, 8)
    notes = rows.select(F.col("page_id").alias("id"), "url", quote.alias("quote"), F.lit(0).alias("place"), F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    return reading.placed(notes, rows.select("url", "blocks"))


@query("page_comparison")
def page_comparison(spark, d):
    """All pages against themselves with one block changed on some."""
    rows = M.table(spark, d, "pages").select("page_id", "url").join(extract.page_blocks(M.table(spark, d, "pages")), "page_id")
    later = rows.withColumn("blocks", F.when(F.col("page_id") % 3 == 0, F.concat(F.slice("blocks", 1, 1), F.array(F.lit("a new block of text")))).otherwise(F.col("blocks")))
    out = reading.compare_pages(rows.select("url", "title", "blocks"), later.where("page_id % 7 <> 0").select("url", "title", "blocks"))
    return out.select("url", "change", F.round("ratio", 6).alias("ratio"), F.size("changes").alias("n"))


@query("page_line_offsets", M.SQL + "SELECT capture_id, CAST(sum(length('{\"url\":\"' || url || '\",\"bytes\":' || bytes || '}') + 1) AS BIGINT) AS bytes FROM (SELECT DISTINCT capture_id, url, bytes FROM capture_urls) GROUP BY capture_id")
def page_line_offsets(spark, d):
    rows = M.capture_urls(spark, d).select("capture_id", "url", "bytes").distinct()
    return export.page_lines(rows).groupBy("capture_id").agg(F.max(F.col("offset") + F.col("length")).alias("bytes"))


@query("mangled_requests", "SELECT count(*) AS n, count(*) FILTER (contains(text, '%5C') OR contains(text, '%5c') OR contains(text, chr(92))) AS mangled FROM documents")
def mangled_requests(spark, d):
    return M.table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(audit.mangled(F.col("text"))).alias("mangled"))


@query("judged_pages", "SELECT page_id, CASE WHEN contains(html, 'class=\"paywall\"') THEN 'selector' WHEN contains(html, '<article>') THEN 'clear' ELSE 'other' END AS verdict FROM pages")
def judged_pages(spark, d):
    out = gates.judged(F.col("html"), F.col("url"), F.contains("html", F.lit("<article>")), F.contains("html", F.lit('class="paywall"')))
    return M.table(spark, d, "pages").select("page_id", F.when(out.isin("selector", "clear"), out).otherwise("other").alias("verdict"))


@query("registrable_by_list", M.SQL + "SELECT host, CASE host WHEN 'h3.example.org' THEN 'h3.example.org' ELSE CASE WHEN host = 'h4.example.org' THEN '' ELSE 'a.' || host END END AS registrable, count(*) AS n FROM capture_urls GROUP BY host")
def registrable_by_list(spark, d):
    """Owners by a suffix list: each host of the domain gives names below it, but for an exception."""
    rules = spark.createDataFrame([("org",), ("example.org",), ("*.example.org",), ("!h3.example.org",), ("com",)], "rule string")
    rows = M.capture_urls(spark, d)
    named = rows.select("host", F.when(F.col("host") == "h4.example.org", F.col("host")).otherwise(F.concat(F.lit("a."), "host")).alias("name"))
    owners = hosts.registrable_by(named, rules, "name")
    return owners.groupBy("host", "registrable").agg(F.count("*").alias("n"))
