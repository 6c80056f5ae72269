"""Queries over archived pages: URLs, shapes, text, links and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars, urls
from palimpsest.operators import extract, gates, shapes
from palimpsest.plans import model as M
from palimpsest.plans.registry import query


def _pages(spark, d):
    return M.spread(M.table(spark, d, "pages"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"


@query("url_host_counts", f"SELECT {_HOST} AS host, count(*) AS n, count(DISTINCT {_PATH}) AS paths FROM pages GROUP BY 1")
def url_host_counts(spark, d):
    rows = _pages(spark, d).select(urls.host(F.col("url")).alias("host"), F.coalesce(urls.part(F.col("url"), "PATH"), F.lit("")).alias("path"))
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


_SHAPES = f"""WITH base AS (SELECT page_id, url, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS raw,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({_QUERY}, '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> ''))), '&') AS keys FROM pages),
flat AS (SELECT page_id, unnest(range(1, len(raw) + 1)) AS i, raw FROM base),
seg AS (SELECT page_id, i, raw[i] AS s, list_transform(raw, lambda x: CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 0.6 * length(x) THEN '#' ELSE lower(x) END) AS norms FROM flat),
pos AS (SELECT page_id, i, s, norms[i] AS norm, array_to_string(norms[1:i-1], '/') AS prefix FROM seg),
nodes AS (SELECT prefix, count(*) AS uses, count(DISTINCT norm) AS vals FROM pos GROUP BY prefix),
shown AS (SELECT page_id, i, CASE WHEN norm = '#' THEN '#' WHEN NOT (vals > 8 AND vals > 0.05 * uses) THEN norm WHEN regexp_matches(s, '[.][A-Za-z0-9]{{1,5}}$') THEN '*.' || lower(regexp_extract(s, '[.]([A-Za-z0-9]{{1,5}})$', 1)) ELSE '*' END AS x FROM pos JOIN nodes USING (prefix)),
paths AS (SELECT page_id, string_agg(x, '/' ORDER BY i) AS p FROM shown GROUP BY page_id),
shapes AS (SELECT page_id, url, '/' || coalesce(p, '') || CASE WHEN keys <> '' THEN '?' || keys ELSE '' END AS shape FROM base LEFT JOIN paths USING (page_id))"""


@query("url_shape_top", _SHAPES + " SELECT shape, count(*) AS n, CAST(0 AS BIGINT) AS bytes, arg_min(url, page_id) AS example FROM shapes GROUP BY shape ORDER BY n DESC, shape LIMIT 30")
def url_shape_top(spark, d):
    return shapes.summary(shapes.shaped(_pages(spark, d), key="page_id"), key="page_id")


@query("url_shapes", _SHAPES + " SELECT page_id, url, shape FROM shapes")
def url_shapes(spark, d):
    return shapes.shaped(_pages(spark, d), key="page_id")


@query("capture_url_shapes", M.SQL + "SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '/[0-9]+', '/#', 'g') AS shape, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM capture_urls GROUP BY 1")
def capture_url_shapes(spark, d):
    rows = M.capture_urls(spark, d).select(F.monotonically_increasing_id().alias("id"), "url", "bytes")
    out = shapes.shaped(rows).join(rows.select("id", "bytes"), "id")
    return shapes.summary(out, size="bytes").drop("example")


_KEPT = f"""list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT (starts_with(lower(p), 'utm_') OR list_contains({list(urls.TRACKING)!r}, lower(string_split(p, '=')[1])))))"""
_CANONICAL = f"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/+$', '') ELSE {_PATH} END ||
CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"""


@query("canonical_url_groups", f"SELECT {_CANONICAL} AS canonical, count(*) AS n FROM pages GROUP BY 1")
def canonical_url_groups(spark, d):
    return _pages(spark, d).groupBy(urls.canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"))


@query("canonical_url_exact", f"SELECT page_id, {_CANONICAL} AS canonical FROM pages")
def canonical_url_exact(spark, d):
    return _pages(spark, d).select("page_id", urls.canonical_exact("url").alias("canonical"))


@query("registrable_groups", f"SELECT array_to_string(string_split({_HOST}, '.')[-2:], '.') AS registrable, count(*) AS n, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1")
def registrable_groups(spark, d):
    host = urls.host(F.col("url"))
    return _pages(spark, d).groupBy(urls.registrable(host).alias("registrable")).agg(F.count("*").alias("n"), F.countDistinct(host).alias("hosts"))


@query("host_suffix_coverage", f"SELECT DISTINCT {_HOST} AS host, ({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') OR {_HOST} = 'spam-farm.example.org' OR ends_with({_HOST}, '.spam-farm.example.org')) AS covered FROM pages")
def host_suffix_coverage(spark, d):
    """Hosts that a cookie domain covers, as an equality on exploded suffixes."""
    hosts = _pages(spark, d).select(urls.host(F.col("url")).alias("host")).distinct()
    domains = spark.sql("SELECT explode(array('example.com', 'spam-farm.example.org')) AS suffix")
    hit = hosts.withColumn("suffix", F.explode(urls.suffixes(F.col("host")))).join(domains, "suffix", "left_semi").select("host").distinct().withColumn("covered", F.lit(True))
    return hosts.join(hit, "host", "left").select("host", F.coalesce("covered", F.lit(False)).alias("covered"))


@query("query_key_counts", f"SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split({_QUERY}, '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> ''))) AS key FROM pages) GROUP BY key")
def query_key_counts(spark, d):
    return _pages(spark, d).select(F.explode(urls.query_keys(F.col("url"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_LINKS = f"""WITH links AS (SELECT DISTINCT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || path AS target FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"#>]*)"', 1)) AS path FROM pages))"""


@query("link_edges", _LINKS + " SELECT page_id, target FROM links")
def link_edges(spark, d):
    return _edges(spark, d).select("page_id", "target")


def _edges(spark, d):
    rows = _pages(spark, d)
    refs = extract.page_references(rows)
    return refs.select("page_id", F.explode("links").alias("target")).where(F.startswith("target", F.lit("http")))


@query("dead_links", _LINKS + f""", keys AS (SELECT DISTINCT regexp_replace(lower(url), '[?#].*$', '') AS k FROM pages)
SELECT target, count(DISTINCT page_id) AS n FROM links WHERE lower(target) NOT IN (SELECT k FROM keys) GROUP BY target ORDER BY n DESC, target LIMIT 100""")
def dead_links(spark, d):
    keys = _pages(spark, d).select(F.regexp_replace(F.lower("url"), "[?#].*$", "").alias("k")).distinct()
    dead = _edges(spark, d).withColumn("k", F.lower("target")).join(keys, "k", "left_anti")
    return dead.groupBy("target").agg(F.countDistinct("page_id").alias("n")).orderBy(F.desc("n"), "target").limit(100)


@query("page_blocks")
def page_blocks(spark, d):
    return extract.page_blocks(_pages(spark, d)).select("page_id", "title", F.size("blocks").alias("n"), F.array_join("kinds", ",").alias("kinds"), F.sha2(F.array_join("blocks", "\n"), 256).alias("signal"))


@query("page_text_without_template")
def page_text_without_template(spark, d):
    rows = _pages(spark, d)
    blocks = extract.page_blocks(rows).join(rows.select("page_id", urls.host(F.col("url")).alias("site")), "page_id")
    return extract.without_template(blocks, "site").select("page_id", "site", "dropped", F.size("blocks").alias("n"))


@query("page_references")
def page_references(spark, d):
    out = extract.page_references(_pages(spark, d))
    return out.select("page_id", F.size("links").alias("links"), F.size("assets").alias("assets"), F.size("feeds").alias("feeds"), "canonical", "generator", "lazy")


@query("repeated_blocks", """WITH li AS (SELECT DISTINCT page_id, block FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS block FROM pages)), n AS (SELECT count(*) AS n FROM pages)
SELECT block, count(*) AS df FROM li, n GROUP BY block, n.n HAVING count(*) >= greatest(3, floor(n.n * 0.02))""")
def repeated_blocks(spark, d):
    """List items that are on a share of all pages."""
    rows = _pages(spark, d)
    seen = rows.select("page_id", F.explode(F.array_distinct(F.expr("regexp_extract_all(html, '<li>(.*?)</li>', 1)"))).alias("block")).groupBy("block").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(n)).where(F.col("df") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.02))).select("block", "df")  # n is one row


@query("gate_verdicts", """SELECT page_id, CASE WHEN contains(lower(url), '/interstitial/') OR contains(lower(url), '/content-warning') OR contains(lower(url), 'blogger.com/blogin.g') OR contains(lower(url), '/b/blogger-warning') THEN 'url'
WHEN regexp_matches(html, '(?i)body\\s*\\*\\s*\\{[^}]{0,200}visibility\\s*:\\s*hidden') AND regexp_matches(html, '(?i)<iframe[^>]{0,400}src=["''][^"'']{0,600}(/interstitial/|/content-warning|blogger[.]com/blogin[.]g|/b/blogger-warning)') THEN 'overlay'
WHEN strlen(html) > 24000 THEN 'clear' WHEN regexp_matches(html, '(?i)I understand and wish to continue|content\\s+warning|blog\\s+contains\\s+content\\s+.{0,40}adult|viewer\\s+discretion|you\\s+must\\s+be\\s+(?:18|21|of\\s+legal\\s+age)') THEN 'phrase' ELSE 'clear' END AS verdict FROM pages""")
def gate_verdicts(spark, d):
    return _pages(spark, d).select("page_id", gates.verdict(F.col("html"), F.col("url")).alias("verdict"))


@query("asset_links", f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower({_PATH}), '[.](jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?|css|js|mjs|cjs|map|woff2?|ttf|otf|eot|mp4|webm|ogg|ogv|mp3|wav|m4a|flac|pdf|zip|gz)$')) AS assets FROM pages")
def asset_links(spark, d):
    return _pages(spark, d).agg(F.count("*").alias("n"), F.count_if(gates.is_asset(F.col("url"))).alias("assets"))


@query("text_urls", "SELECT rtrim(u, '.,;:!?') AS target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'https?://[^\\s<>\"'')]+')) AS u FROM documents) GROUP BY 1")
def text_urls(spark, d):
    """URLs in free text, without the marks that end a sentence."""
    rows = M.table(spark, d, "documents").select(F.explode(F.expr(r"""regexp_extract_all(text, 'https?://[^\\s<>"\')]+', 0)""")).alias("u"))
    return rows.groupBy(F.rtrim("u", F.lit(".,;:!?")).alias("target")).agg(F.count("*").alias("n"))


@query("scalar_text", """SELECT doc_id, length(trim(regexp_replace(text, '[\\s]+', ' ', 'g'))) AS tidy_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents""")
def scalar_text(spark, d):
    text = F.col("text")
    return M.table(spark, d, "documents").select("doc_id", F.length(scalars.tidy(text)).cast("long").alias("tidy_chars"), scalars.words(text).cast("long").alias("words"))
