"""Queries over the capture index and over line formats, built from the pages and captures at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions import scalars, urls
from palimpsest.operators import index
from palimpsest.plans import model as M
from palimpsest.plans.registry import query
from palimpsest.sources import lines

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_PATH = "lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1))"
_SURT = f"""array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www[0-9]*[.]', ''), '.')), ',') || ')' || CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/+$', '') WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END
|| CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) <> '' THEN '?' || array_to_string(list_sort(list_filter(string_split(lower(regexp_extract(url, '[?]([^#]*)', 1)), '&'), lambda p: p <> '')), '&') ELSE '' END"""


@query("surt_keys", f"SELECT page_id, {_SURT} AS urlkey FROM pages")
def surt_keys(spark, d):
    return M.table(spark, d, "pages").select("page_id", urls.surt(F.col("url")).alias("urlkey"))


def _cdxj(spark, d):
    """Index lines of all captures, as text.  They are written once: each look at an expression's text would render it again."""
    rows = M.spread(M.capture_urls(spark, d)).join(M.captures(spark, d).select(F.col("id").alias("capture_id"), "started_at"), "capture_id")
    mime = F.when(F.col("line") >= 5, "warc/revisit").when(F.col("line") == 4, "image/png").otherwise("text/html")
    blob = F.to_json(F.struct("url", mime.alias("mime"), F.col("status_code").cast("string").alias("status"), "digest", F.concat(F.lit("captures/"), F.col("capture_id").cast("string"), F.lit("/a.warc.gz")).alias("filename"), F.col("line").cast("string").alias("offset")))
    key = F.concat(F.lit("org,example,"), F.split_part("host", F.lit("."), F.lit(1)), F.lit(")/p/"), F.split_part("url", F.lit("/p/"), F.lit(2)))
    return storage.written(rows.select(F.concat_ws(" ", key, F.date_format("started_at", "yyyyMMddHHmmss"), blob).alias("value")), "cdxj")


_INDEX = M.SQL + """, records AS (SELECT 'org,example,h' || regexp_extract(host, '^h([0-9]+)', 1) || ')/p/' || regexp_extract(url, '([0-9]+)$', 1) AS urlkey, strftime(started_at, '%Y%m%d%H%M%S') AS timestamp, url,
  CASE WHEN line >= 5 THEN 'warc/revisit' WHEN line = 4 THEN 'image/png' ELSE 'text/html' END AS mime, status_code AS status, digest, 'captures/' || capture_id || '/a.warc.gz' AS filename, capture_id
  FROM capture_urls JOIN captures c ON c.id = capture_id)"""


@query("cdxj_records", _INDEX + " SELECT urlkey, timestamp, url, mime, status, digest, filename FROM records")
def cdxj_records(spark, d):
    return lines.cdxj(_cdxj(spark, d)).select("urlkey", "timestamp", "url", "mime", "status", "digest", "filename")


@query("replayable_pages", _INDEX + " SELECT count(*) AS n FROM records WHERE status BETWEEN 200 AND 299 AND (contains(mime, 'html') OR mime = '')")
def replayable_pages(spark, d):
    return lines.cdxj(_cdxj(spark, d)).agg(F.count_if(index.replayable()).alias("n"))


@query("index_withheld", _INDEX + " SELECT url, count(*) AS n FROM records WHERE NOT regexp_matches(url, '(/p/1[0-9]*$)|(h7[.])') GROUP BY url")
def index_withheld(spark, d):
    rows = index.without(lines.cdxj(_cdxj(spark, d)), [r"/p/1[0-9]*$", "(broken", r"h7\.", ""])
    return rows.groupBy("url").agg(F.count("*").alias("n"))


@query("key_versions", _INDEX + " SELECT timestamp, status FROM records WHERE urlkey = (SELECT min(urlkey) FROM records) ORDER BY timestamp")
def key_versions(spark, d):
    text = _cdxj(spark, d)
    first = lines.cdxj(text).agg(F.min("urlkey").alias("urlkey"))
    its = text.join(F.broadcast(first), F.substring_index("value", " ", 1) == F.col("urlkey"), "left_semi")  # one row
    return lines.cdxj(its).select("timestamp", "status")


@query("newest_page_per_url", _INDEX + " SELECT url, max(timestamp) AS timestamp FROM records WHERE status BETWEEN 200 AND 299 AND contains(mime, 'html') GROUP BY url")
def newest_page_per_url(spark, d):
    return lines.cdxj(_cdxj(spark, d)).where(index.replayable()).groupBy("url").agg(F.max("timestamp").alias("timestamp"))


@query("chunk_directory", _INDEX + """, n AS (SELECT urlkey, timestamp, row_number() OVER (ORDER BY urlkey, timestamp) - 1 AS i FROM records)
SELECT i // 3000 AS chunk, arg_min(urlkey, i) AS urlkey, arg_min(timestamp, i) AS timestamp, count(*) AS lines, sha256(string_agg(urlkey || ' ' || timestamp, chr(10) ORDER BY urlkey || ' ' || timestamp)) AS digest FROM n GROUP BY 1""")
def chunk_directory(spark, d):
    return index.chunks(lines.cdxj(_cdxj(spark, d)))


@query("index_files_missing", _INDEX + " SELECT DISTINCT filename FROM records WHERE capture_id NOT IN (SELECT id FROM captures WHERE status <> 'running')")
def index_files_missing(spark, d):
    there = M.captures(spark, d).where("status <> 'running'").select(F.concat(F.lit("captures/"), F.col("id").cast("string"), F.lit("/a.warc.gz")).alias("filename"))
    return lines.cdxj(_cdxj(spark, d)).select("filename").distinct().join(there, "filename", "left_anti")


@query("captures_of_files", _INDEX + " SELECT split_part(filename, '/', 2) AS capture, count(*) AS n FROM records GROUP BY 1")
def captures_of_files(spark, d):
    return lines.cdxj(_cdxj(spark, d)).groupBy(scalars.capture_of(F.col("filename")).alias("capture")).agg(F.count("*").alias("n"))


@query("cdx_lines", M.SQL + "SELECT url, CASE WHEN error IS NULL THEN status_code END AS status, digest FROM capture_urls")
def cdx_lines(spark, d):
    dash = F.lit("-")
    status = F.when(F.col("error").isNull(), F.col("status_code").cast("string")).otherwise("-")
    line = F.concat_ws(" ", "url", F.lit("20240101000000"), "url", F.lit("text/html"), status, "digest", dash, dash, F.lit("0"), F.lit("a.warc.gz"), F.lit("<urn:uuid:0>"))
    rows = M.capture_urls(spark, d).select(line.alias("value")).unionByName(spark.sql("SELECT explode(array(' CDX a b a m s k r M V g u', 'too short')) AS value"))
    return lines.cdx(rows).select("url", "status", "digest")


@query("event_lines", "SELECT event_type = 'error' AS failed, count(*) AS n FROM events GROUP BY 1")
def event_lines(spark, d):
    """Engine events written as JSON lines and read back; what is no event is counted apart and left out here."""
    rows = M.observations(spark, d)
    error = F.when(F.col("kind") == "error", "timeout")
    line = F.to_json(F.struct(F.lit("url").alias("type"), F.concat(F.lit("https://x.org/"), F.col("id").cast("string")).alias("url"), error.alias("error")))
    text = rows.select(line.alias("value")).unionByName(spark.sql("SELECT explode(array('{broken', '{\"type\": \"other\"}')) AS value"))
    return lines.events(text).where("type IS NOT NULL").groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("seed_union", _INDEX.replace("records AS", "recs AS") + """, s AS (SELECT url, 1 AS src FROM recs WHERE status = 200 UNION ALL SELECT url, 2 FROM pages UNION ALL SELECT url, 3 FROM recs WHERE status <> 200), f AS (SELECT url, min(src) AS src FROM s GROUP BY url)
SELECT src AS source, count(*) AS n FROM f GROUP BY src""")
def seed_union(spark, d):
    """Distinct URLs of several sources; each counts for the first source that has it."""
    rows = M.capture_urls(spark, d)
    part = lambda r, n: r.select("url", F.lit(n).alias("source"))
    both = part(rows.where("status_code = 200"), 1).unionByName(part(M.table(spark, d, "pages"), 2)).unionByName(part(rows.where("status_code <> 200"), 3))
    return both.groupBy("url").agg(F.min("source").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
