"""Queries about formats and names, one for each reader and scalar: lines, feeds, robots, cookies, patterns and slugs.

The driver's tables have no such files; rows are rendered as what an archive
would hold and read back by the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions import matching, scalars
from palimpsest.operators import hosts, index, upkeep
from palimpsest.plans import model as M
from palimpsest.plans.registry import query
from palimpsest.sources import feeds, lines
from palimpsest.streaming import machines


def _number(column: str):
    return F.col(column).cast("string")


_LOG = """, log AS (SELECT capture_id, url, row_number() OVER (PARTITION BY capture_id ORDER BY line, url) AS n, error FROM capture_urls)"""


def _log(spark, d):
    """Two lines a URL: its address, then what came of it; the second is a whole fetch line in good cases.

    Of one URL twice in a line, failures come first; rows that agree in that too are alike here.
    """
    rows = M.capture_urls(spark, d).withColumn("n", F.expr("row_number() OVER (PARTITION BY capture_id ORDER BY line, url, error NULLS LAST)"))
    first = rows.select("capture_id", (F.col("n") * 2).alias("line"), F.concat("url", F.lit(":")).alias("value"))
    good = F.concat(F.lit("2024-01-01 00:00:00 URL:"), F.col("url"), F.lit(" [12/12] -> x"))
    bad = F.when(F.col("n") % 2 == 0, "2024-01-01 00:00:00 ERROR 404: Not Found. ").otherwise("Connecting failed: Connection refused.")
    second = rows.select("capture_id", (F.col("n") * 2 + 1).alias("line"), F.when(F.col("error").isNull(), good).otherwise(bad).alias("value"))
    return first.unionByName(second)


@query("log_fetched", M.SQL + "SELECT url, count(*) AS n FROM capture_urls WHERE error IS NULL GROUP BY url")
def log_fetched(spark, d):
    return _log(spark, d).select(lines.log_url(F.col("value")).alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))


@query("log_failures", M.SQL + _LOG + " SELECT url, CASE WHEN n % 2 = 0 THEN '404: Not Found.' ELSE 'Connection refused.' END AS reason, count(*) AS n FROM log WHERE error IS NOT NULL GROUP BY 1, 2")
def log_failures(spark, d):
    """Reasons of failures, each with the address of the line before."""
    return lines.log_errors(_log(spark, d), file="capture_id").groupBy("url", "reason").agg(F.count("*").alias("n"))


@query("sitemap_entries", M.SQL + "SELECT 'http://s/' || capture_id AS url, count(*) FILTER (capture_id % 3 <> 0) AS pages, count(*) FILTER (capture_id % 3 = 0) AS children, min(url) AS first FROM capture_urls WHERE capture_id % 4 <> 0 GROUP BY capture_id")
def sitemap_entries(spark, d):
    """Pages and child sitemaps, in whatever namespace; a body of another kind has none."""
    item = lambda kind: F.concat(F.lit(f"<{kind}><loc> "), F.col("url"), F.lit(f" </loc></{kind}>"))
    body = lambda root, kind: F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://x/">'), F.concat_ws("", F.collect_list(item(kind))), F.lit(f"</{root}>"))
    key = F.col("capture_id")
    bodies = M.capture_urls(spark, d).groupBy("capture_id").agg(F.when(key % 4 == 0, "<html><body/></html>").when(key % 3 == 0, body("sitemapindex", "sitemap")).otherwise(body("urlset", "url")).alias("body"))
    rows = feeds.read_sitemaps(bodies.select(F.concat(F.lit("http://s/"), _number("capture_id")).alias("url"), "body"))
    return rows.groupBy("url").agg(F.count_if(~F.col("child")).alias("pages"), F.count_if("child").alias("children"), F.min("loc").alias("first"))


def _walk(spark, d, **bounds):
    """Pages that a root sitemap leads to: it lists indexes of captures, which list a sitemap for each of them."""
    place = lambda n: F.concat(F.lit("http://s/"), F.lpad(n.cast("string"), 12, "0"))
    group = F.expr("capture_id div 2000")
    item = lambda kind, loc: F.concat(F.lit(f"<{kind}><loc>"), loc, F.lit(f"</loc></{kind}>"))
    body = lambda root, items: F.concat(F.lit(f"<{root}>"), F.concat_ws("", F.array_sort(F.collect_list(items))), F.lit(f"</{root}>")).alias("body")
    rows = M.capture_urls(spark, d).select("capture_id", "url", group.alias("g"))
    index = F.concat(F.lit("http://s/i"), F.lpad(F.col("g").cast("string"), 12, "0"))
    sites = rows.groupBy(place(F.col("capture_id")).alias("url")).agg(body("urlset", item("url", F.col("url"))))
    indexes = rows.select("g", "capture_id").distinct().groupBy(index.alias("url")).agg(body("sitemapindex", item("sitemap", place(F.col("capture_id")))))
    root = rows.select("g").distinct().groupBy(F.lit("http://s/root").alias("url")).agg(body("sitemapindex", item("sitemap", index)))
    bodies = storage.written(sites.unionByName(indexes).unionByName(root), "bodies")
    return upkeep.walk_sitemaps(root.select("url"), lambda level: feeds.read_sitemaps(bodies.join(level, "url", "left_semi")), **bounds).select("loc")


@query("sitemap_walk", M.SQL + "SELECT DISTINCT url AS loc FROM capture_urls")
def sitemap_walk(spark, d):
    """All pages below a root sitemap, without a bound."""
    return _walk(spark, d, documents=None, most_urls=None)


@query("sitemap_walk_bounded", M.SQL + ", c AS (SELECT DISTINCT capture_id FROM capture_urls), n AS (SELECT capture_id FROM c QUALIFY row_number() OVER (ORDER BY capture_id) <= 59 - (SELECT count(DISTINCT capture_id // 2000) FROM c)) SELECT DISTINCT url AS loc FROM capture_urls WHERE capture_id IN (SELECT capture_id FROM n)")
def sitemap_walk_bounded(spark, d):
    """The same up to sixty sitemaps, as a polite walk goes: the root, the indexes, and the first captures that they list."""
    return _walk(spark, d)


_FEED_SQL = M.SQL + "SELECT 'http://f/' || capture_id AS url, CASE capture_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'json' END AS kind, "


def _feeds(spark, d):
    rows = M.capture_urls(spark, d)
    link, text = F.col("url"), _number("line")
    rss = F.concat(F.lit("<item><title>T"), text, F.lit("</title><link>"), link, F.lit("</link>"), F.when(F.col("line") > 1, F.concat(F.lit("<guid>g"), text, F.lit("</guid>"))).otherwise(""), F.lit("<pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>T"), text, F.lit('</title><link rel="self" href="http://no/"/><link href="'), link, F.lit('"/>'), F.when(F.col("line") > 1, F.concat(F.lit("<id>g"), text, F.lit("</id>"))).otherwise(""), F.lit("<published>2024-01-01T10:00:00+01:00</published></entry>"))
    item = F.concat(F.lit('{"url": "'), link, F.lit('", "title": "T'), text, F.lit('", "date_published": "2024-01-01T09:00:00Z"'), F.when(F.col("line") > 1, F.concat(F.lit(', "id": "g'), text, F.lit('"'))).otherwise(""), F.lit("}"))
    key = F.col("capture_id")
    items = F.collect_list(F.when(key % 3 == 0, rss).when(key % 3 == 1, atom).otherwise(item))  # a row is in one kind of feed
    body = F.when(key % 3 == 0, F.concat(F.lit("<rss version='2.0'><channel><title>F</title>"), F.concat_ws("", items), F.lit("</channel></rss>")))
    body = body.when(key % 3 == 1, F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title>"), F.concat_ws("", items), F.lit("</feed>"))).otherwise(F.concat(F.lit('{"title": "F", "items": ['), F.concat_ws(", ", items), F.lit("]}")))
    bodies = rows.groupBy("capture_id").agg(body.alias("body")).select(F.concat(F.lit("http://f/"), _number("capture_id")).alias("url"), "body")
    return feeds.read_feeds(bodies)


@query("feed_links", _FEED_SQL + "url AS entry_url FROM capture_urls")
def feed_links(spark, d):
    """The links of entries of three kinds of feeds."""
    return _feeds(spark, d).select("url", "kind", "entry_url")


@query("feed_entries", _FEED_SQL + "CASE WHEN line > 1 THEN 'g' || line ELSE url END AS guid, url AS canonical, 'T' || line AS title, '2024-01-01T09:00:00Z' AS published FROM capture_urls")
def feed_entries(spark, d):
    """Typed entries: an entry without id goes by its canonical URL, and moments are in UTC."""
    return _feeds(spark, d).select("url", "kind", "guid", "canonical", "title", "published")


@query("feed_kinds", M.SQL + "SELECT CASE capture_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'json' END AS kind, count(*) AS n FROM capture_urls GROUP BY 1")
def feed_kinds(spark, d):
    return _feeds(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("robots_rules", "SELECT p_partkey AS id, 'http://s/' || p_size || '.xml' AS sitemaps, CASE WHEN p_size % 2 = 0 THEN '/a' || p_size || ' /b' ELSE '/b' END AS disallowed FROM part")
def robots_rules(spark, d):
    """Sitemaps, and what everyone or nobody named may not fetch."""
    size = _number("p_size")
    agent = F.when(F.col("p_size") % 2 == 0, "*").otherwise("Otherbot")
    text = F.concat(F.lit("Disallow: /b\n\nUser-Agent: "), agent, F.lit("\nDisallow: /a"), size, F.lit("\nDisallow:\n\nUser-agent: x\nDisallow: /x\n\nSITEMAP: http://s/"), size, F.lit(".xml\nSitemap: ftp://no\n"))
    rows = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), lines.robots(text).alias("r"))
    return rows.select("id", F.array_join("r.sitemaps", " ").alias("sitemaps"), F.array_join("r.disallowed", " ").alias("disallowed"))


@query("robots_blocks", "SELECT p_partkey AS id, p_size % 3 = 0 AS blocked FROM part")
def robots_blocks(spark, d):
    rules = F.array(F.lit(""), F.lit("/a"), F.lit("/c/"))
    path = F.when(F.col("p_size") % 3 == 0, "/abc").when(F.col("p_size") % 3 == 1, "/c").otherwise("/b/a")
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), matching.disallowed(path, rules).alias("blocked"))


@query("cookie_report", M.SQL + "SELECT count(*) FILTER (id % 10 <> 9) AS cookies, count(*) FILTER (id % 10 = 9) AS bad_lines, count(*) FILTER (id % 10 = 0) AS session, count(*) FILTER (id % 10 <> 9 AND id % 10 > 0 AND id < 500) AS expired, min(id) FILTER (id % 10 NOT IN (0, 9)) AS earliest, count(DISTINCT id % 3) FILTER (id % 10 <> 9) AS hosts FROM captures")
def cookie_report(spark, d):
    """A cookie jar: an expiry is the row's number, none if it ends in 0; lines that end in 9 have too few fields."""
    expiry = F.when(F.col("id") % 10 == 0, "0").otherwise(_number("id"))
    line = F.concat(F.when(F.col("id") % 2 == 0, "#HttpOnly_").otherwise(""), F.lit(".H"), (F.col("id") % 3).cast("string"), F.lit(".org\tTRUE\t/\tFALSE\t"), expiry, F.lit("\tname\tvalue"))
    value = F.when(F.col("id") % 10 == 9, "half a line").otherwise(line)
    rows = M.captures(spark, d).select(value.alias("value")).unionByName(spark.sql("SELECT explode(array('# a comment', '')) AS value"))
    return lines.cookies(rows, 500)


@query("cookie_warnings", M.SQL + "SELECT array_to_string(list_filter([CASE WHEN count(*) FILTER (id % 10 = 9) > 0 THEN 'bad lines' END, CASE WHEN count(*) FILTER (id % 10 <> 9) = 0 THEN 'no cookies' END, CASE WHEN count(*) FILTER (id % 10 <> 9 AND id % 10 > 0 AND id < 500) > 0 THEN 'expired cookies' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM captures")
def cookie_warnings(spark, d):
    r = cookie_report(spark, d)
    return r.select(lines.cookie_warnings(F.col("cookies"), F.col("bad_lines"), F.col("expired")).alias("warnings"))


@query("json_documents", M.SQL + "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE bytes END AS bytes FROM captures")
def json_documents(spark, d):
    """Manifests as JSON; one that is broken is null."""
    text = F.when(F.col("id") % 3 == 0, "{not json").otherwise(F.concat(F.lit('{"stats": {"bytes": '), _number("bytes"), F.lit("}}")))
    return M.captures(spark, d).select("id", lines.document(text, "stats struct<bytes: bigint>")["stats"]["bytes"].alias("bytes"))


@query("engine_url_rows", M.SQL + "SELECT url, CASE WHEN line % 3 <> 0 THEN status_code END AS status, count(*) AS n FROM capture_urls WHERE line % 5 <> 0 GROUP BY 1, 2")
def engine_url_rows(spark, d):
    """URL rows out of an engine's index: bookkeeping is left out, and a status that is no number is null."""
    key = F.when(F.col("line") % 5 == 0, "metadata:x").otherwise("org,example)/x")
    status = F.when(F.col("line") % 3 == 0, "-").otherwise(_number("status_code"))
    target = F.when(F.col("line") % 5 == 0, "urn:pageinfo").otherwise(F.col("url"))
    value = F.concat(key, F.lit(' 20240101000000 {"url": "'), target, F.lit('", "status": "'), status, F.lit('"}'))
    rows = lines.cdxj(M.capture_urls(spark, d).select(value.alias("value")))
    return rows.where(~index.bookkeeping("urlkey") & ~index.bookkeeping()).groupBy("url", "status").agg(F.count("*").alias("n"))


@query("engine_log_events", M.SQL + "SELECT kind, count(*) AS n FROM observations WHERE kind IN ('click', 'view') GROUP BY kind")
def engine_log_events(spark, d):
    """JSON log lines by type: clicks stand for progress, views for log lines; others are of no known type."""
    known = F.when(F.col("kind") == "click", "progress").when(F.col("kind") == "view", "log").otherwise(F.col("kind"))
    value = F.concat(F.lit('{"type": "'), known, F.lit('", "done": '), _number("id"), F.lit("}"))
    rows = lines.events(M.observations(spark, d).select("kind", value.alias("value")))
    return rows.where("type IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("index_withheld_by_url", M.SQL + "SELECT count(*) AS n FROM capture_urls WHERE NOT regexp_matches(url, '/p/7|[.]org/p/1[0-9]$')")
def index_withheld_by_url(spark, d):
    """Index lines whose URL no pattern refuses, whatever their key says; a pattern that can't be read is left out."""
    rows = M.capture_urls(spark, d).select("url", F.lit("org,example)/p/7").alias("urlkey"))
    return index.without(rows, ["/p/7", "[.]org/p/1[0-9]$", "("]).agg(F.count("*").alias("n"))


@query("index_bookkeeping", M.SQL + "SELECT count(*) FILTER (line % 3 = 0) AS kept_back, count(*) FILTER (line % 3 <> 0) AS shown FROM capture_urls")
def index_bookkeeping(spark, d):
    url = F.when(F.col("line") % 3 == 0, F.when(F.col("line") % 2 == 0, "Metadata:fetch").otherwise("URN:page")).otherwise(F.col("url"))
    rows = M.capture_urls(spark, d).select(url.alias("url"))
    return rows.agg(F.count_if(index.bookkeeping()).alias("kept_back"), F.count_if(~index.bookkeeping()).alias("shown"))


@query("patterns_combined", M.SQL + "SELECT count(*) FILTER (regexp_matches(url, '(^https://h1)|(/p/9$|/p/8$)')) AS hits, count(*) AS n FROM capture_urls")
def patterns_combined(spark, d):
    """Patterns with alternatives of their own stay apart when they are put together."""
    return M.capture_urls(spark, d).agg(F.count_if(F.col("url").rlike(index.combined(["^https://h1", "/p/9$|/p/8$"]))).alias("hits"), F.count("*").alias("n"))


@query("patterns_usable", "WITH b AS (SELECT DISTINCT p_brand AS brand FROM part) SELECT brand AS pattern, CAST(row_number() OVER (ORDER BY brand) - 1 AS INT) AS place FROM b WHERE NOT ends_with(brand, '1')")
def patterns_usable(spark, d):
    """Brands as patterns, with room around them and twice each, some of them broken: trimmed, distinct, readable, in order."""
    brand = F.col("p_brand")
    raw = F.when(F.endswith(brand, F.lit("1")), F.concat(brand, F.lit("("))).otherwise(F.concat(F.lit(" "), brand, F.lit(" ")))
    brands = [r.raw for r in M.table(spark, d, "part").select(brand.alias("b"), raw.alias("raw")).distinct().orderBy("b").collect()]  # a site's patterns: some dozens
    return spark.createDataFrame(list(enumerate(index.usable([*brands, "", *brands]))), "place int, pattern string").select("pattern", "place")


_SLUG = "nullif(trim(left(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 64), '-'), '')"


@query("slugs", f"SELECT c_custkey AS id, {_SLUG} AS slug FROM customer")
def slugs(spark, d):
    return M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.slug("c_name").alias("slug"))


@query("unique_slugs", "SELECT p_partkey AS id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_slugs(spark, d):
    rows = M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), scalars.slug("p_brand").alias("base"))
    return rows.select("id", scalars.unique_slug("base", "id").alias("slug"))


@query("directory_names", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'x' WHEN p_size % 4 = 1 THEN 'A B ' || p_name ELSE rtrim(left(repeat(p_name || ' ', 10), 96), '. ') END AS name FROM part")
def directory_names(spark, d):
    """Device names fall back, what shares can't carry goes, and long names are cut."""
    size = F.col("p_size") % 4
    raw = F.when(size == 0, "LPT1.txt").when(size == 1, F.concat(F.lit("A:B  "), F.col("p_name"), F.lit(". ."))).otherwise(F.repeat(F.concat("p_name", F.lit(" ")), 10))
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), matching.directory_name(raw, F.lit("x")).alias("name"))


@query("capture_dirs", M.SQL + "SELECT id, strftime(started_at, '%Y%m%dT%H%M%SZ') || CASE WHEN id % 2 = 0 THEN '-full-wget' ELSE '-run-engine' END AS name FROM captures")
def capture_dirs(spark, d):
    even = F.col("id") % 2 == 0
    return M.captures(spark, d).select("id", scalars.capture_dir(F.col("started_at"), F.when(even, "Full!").otherwise("?"), F.when(even, "wget-warc").otherwise("-")).alias("name"))


@query("state_sentences", M.SQL + "SELECT id, CASE status WHEN 'ok' THEN 'The live site answers normally.' WHEN 'partial' THEN CASE WHEN id % 2 = 0 THEN 'The live site returns 410. These pages are now only in your archive.' ELSE 'The live site returns 404. These pages are now only in your archive.' END ELSE 'The live site now redirects to http://b.org/. Add it as a second seed to keep archiving it.' END AS text FROM captures")
def state_sentences(spark, d):
    status = F.col("status")
    state = F.when(status == "ok", "live").when(status == "partial", "gone").otherwise("moved")
    return M.captures(spark, d).select("id", matching.described(state, F.when(F.col("id") % 2 == 0, 410), F.lit("http://b.org/")).alias("text"))


@query("names_and_slugs", f"SELECT c_custkey AS id, c_name AS display, {_SLUG} AS slug FROM customer")
def names_and_slugs(spark, d):
    name = F.col("c_name")
    return M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), matching.directory_name(name, F.lit("site")).alias("display"), scalars.slug("c_name").alias("slug"))


@query("content_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, left(sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 32) AS block FROM documents")
def content_digests(spark, d):
    """The digest of a text, and a block's identity: 128 bits of its tidy text."""
    text = F.coalesce("text", F.lit(""))
    return M.table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.substring(F.sha2(scalars.tidy(text), 256), 1, 32).alias("block"))


@query("seed_addresses", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://shop' || c_custkey || '.example.org/' WHEN 1 THEN 'http://shop.example.org:81/A?q' WHEN 2 THEN NULL ELSE 'https://example.org/' || c_custkey END AS url FROM customer")
def seed_addresses(spark, d):
    """Seeds as they are stored; null for what is no address."""
    n = F.col("c_custkey")
    raw = F.when(n % 4 == 0, F.concat(F.lit(" Shop"), n.cast("string"), F.lit(".EXAMPLE.org"))).when(n % 4 == 1, "http://SHOP.example.org:81/A?q#f").when(n % 4 == 2, "ftp://example.org/").otherwise(F.concat(F.lit("https://example.org/"), n.cast("string")))
    return M.table(spark, d, "customer").select(n.alias("id"), matching.seed_address(raw).alias("url"))


@query("url_with_query", M.SQL + "SELECT url || CASE WHEN line % 2 = 0 THEN '?a=1&page=2' ELSE '?page=2' END AS url, count(*) AS n FROM capture_urls GROUP BY 1")
def url_with_query(spark, d):
    url = F.concat("url", F.when(F.col("line") % 2 == 0, "?a=1").otherwise(""))
    return M.capture_urls(spark, d).groupBy(matching.with_query(url, "page=2").alias("url")).agg(F.count("*").alias("n"))


@query("discovery_hosts", M.SQL + "SELECT host, count(*) AS link_refs, count(DISTINCT url) AS distinct_urls, CAST(7 AS INT) AS run FROM capture_urls GROUP BY host")
def discovery_hosts(spark, d):
    """A discovery's rows, one per host, marked with their run."""
    refs = M.capture_urls(spark, d).select("url", F.lit("link").alias("kind"), F.lit(None).cast("string").alias("mime"))
    return hosts.statistics(refs, "h1.example.org").select("host", "link_refs", "distinct_urls", F.lit(7).alias("run"))


@query("new_feeds", M.SQL + "SELECT 'http://f/' || site_id || '/' || CASE WHEN site_id % 2 = 0 THEN 'comments/feed' ELSE 'feed' END AS url, site_id % 2 <> 0 AS enabled FROM (SELECT DISTINCT site_id FROM captures WHERE site_id % 3 <> 0)")
def new_feeds(spark, d):
    """Feeds of sites that are not known yet; feeds of comments arrive switched off."""
    url = F.concat(F.lit("http://f/"), _number("site_id"), F.when(F.col("site_id") % 2 == 0, "/comments/feed").otherwise("/feed"))
    found = M.captures(spark, d).select("site_id", url.alias("url"))
    known = found.where("site_id % 3 = 0").select("url")
    return machines.new_feeds(found, known).select("url", "enabled")
