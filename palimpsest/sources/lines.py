"""Line formats of an archive, as columns: CDXJ, CDX, JSON lines, crawl logs, engine events, robots, cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CDXJ = "url string, mime string, status string, digest string, filename string, offset string, length string"
EVENTS = "type string, ts string, level string, msg string, url string, status int, mime string, size long, digest string, revisit boolean, error string, done long, total long, bytes long, path string, code string, stats map<string,long>"
EVENT_TYPES = ("artifact", "log", "progress", "result", "started", "url", "warning")
PAGE = "url string, title string, blocks array<string>, kinds array<string>, ts string"


def cdxj(lines: DataFrame, column: str = "value") -> DataFrame:
    """``urlkey``, ``timestamp`` and the JSON's fields; lines that can't be read are dropped."""
    parts = F.split(column, " ", 3)
    blob = F.trim(F.get(parts, 2))
    # The JSON is read once a line: filters look at the text, so that none of them is a second parse.
    rows = lines.where(F.startswith(blob, F.lit("{")) & F.endswith(blob, F.lit("}"))).select(parts.alias("p"))
    rows = rows.select(F.get("p", 0).alias("urlkey"), F.get("p", 1).alias("timestamp"), F.from_json(F.get("p", 2), CDXJ, {"mode": "PERMISSIVE"}).alias("j"))
    whole = lambda c: F.coalesce(F.col(f"j.{c}").try_cast("bigint"), F.lit(0))
    return rows.select("urlkey", "timestamp", F.coalesce("j.url", F.lit("")).alias("url"), "j.mime", F.col("j.status").try_cast("int").alias("status"), "j.digest", F.coalesce("j.filename", F.lit("")).alias("filename"), whole("offset").alias("offset"), whole("length").alias("length"))


def cdx(lines: DataFrame, column: str = "value") -> DataFrame:
    """The classic eleven fields; ``-`` and empty are null, short lines and the header are dropped."""
    parts = F.split(column, " ")
    field = lambda i: F.when(~F.get(parts, i).isin("-", ""), F.get(parts, i))
    rows = lines.where((F.size(parts) >= 11) & ~F.startswith(column, F.lit(" CDX")))
    return rows.select(F.get(parts, 0).alias("url"), field(3).alias("mime"), field(4).try_cast("int").alias("status"), field(5).alias("digest"), field(6).alias("redirect"), field(8).alias("offset"))


def page(text: Column) -> Column:
    """An extracted page out of its JSON; a struct of nulls where it can't be read."""
    return F.from_json(text, PAGE)


def pages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Extracted pages out of lines that have their places (``ranges.read_lines``); bad lines are dropped, and took up their room."""
    rows = lines.withColumn("p", page(F.col(column))).where("p.url IS NOT NULL")
    return rows.select(*[c for c in lines.columns if c != column], "p.*")


def log_url(line: Column) -> Column:
    """The URL of a successful fetch in a crawl log, else null."""
    found = F.regexp_extract(F.trim(line), r"^(?:\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} )?URL:(\S+) ", 1)
    return F.when(found != "", found)


def log_errors(lines: DataFrame, order: str = "line", column: str = "value", file: str = "file") -> DataFrame:
    """(``url``, ``reason``) of failures: the URL stands on the line before in the same ``file``."""
    text = F.trim(column)
    reason = F.when(F.contains(text, F.lit(" ERROR ")), F.trim(F.regexp_replace(text, "^.*? ERROR ", ""))).when(F.contains(text, F.lit(" failed: ")), F.trim(F.regexp_replace(text, "^.* failed: ", "")))
    reason = reason.when(F.contains(F.lower(text), F.lit("unable to resolve host address")), text)
    rows = lines.withColumn("before", F.expr(f"lag({column}) OVER (PARTITION BY {file} ORDER BY {order})")).withColumn("reason", reason)
    return rows.where("reason IS NOT NULL").select(F.regexp_replace(F.trim("before"), ":$", "").alias("url"), "reason")


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Engine events with their own columns; what is no event of a known type has a null ``type``."""
    rows = lines.withColumn("e", F.from_json(column, EVENTS))
    known = F.col("e.type").isin(*EVENT_TYPES)
    return rows.select(*lines.columns, F.when(known, F.col("e.type")).alias("type"), *[F.when(known, F.col(f"e.{c}")).alias(c) for c in ("ts", "url", "status", "size", "digest", "revisit", "error", "bytes", "path", "stats")])


def robots(text: Column) -> Column:
    """Struct of ``sitemaps`` and of sorted distinct ``disallowed`` from blocks for everyone or for nobody named."""
    each = F.split(text, r"\n\s*\n")
    names = lambda b: F.regexp_extract_all(b, F.lit(r"(?im)^\s*user-agent\s*:\s*(.*?)\s*$"), F.lit(1))
    ours = F.filter(each, lambda b: (F.size(names(b)) == 0) | F.array_contains(names(b), "*"))
    rules = F.flatten(F.transform(ours, lambda b: F.regexp_extract_all(b, F.lit(r"(?im)^\s*disallow\s*:[ \t]*(\S*)[ \t]*$"), F.lit(1))))
    maps = F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)\s*$"), F.lit(1))
    return F.struct(F.filter(maps, lambda m: m.rlike("^https?://")).alias("sitemaps"), F.array_sort(F.array_distinct(F.filter(rules, lambda r: r != ""))).alias("disallowed"))


def cookies(lines: DataFrame, now: int, column: str = "value") -> DataFrame:
    """One row about a cookie jar: counts of cookies, bad lines, session and expired ones, earliest expiry, hosts."""
    plain = lines.where((F.trim(column) != "") & (~F.startswith(column, F.lit("#")) | F.startswith(column, F.lit("#HttpOnly_"))))
    parts = F.split(F.regexp_replace(column, "^#HttpOnly_", ""), "\t")
    good = (F.size(parts) == 7) & F.try_to_number(F.get(parts, 4), F.lit("999999999999")).isNotNull()
    expires = F.get(parts, 4).try_cast("bigint")
    host = F.ltrim(F.lower(F.get(parts, 0)), F.lit("."))
    return plain.agg(
        F.count_if(good).alias("cookies"),
        F.count_if(~good).alias("bad_lines"),
        F.count_if(good & (expires == 0)).alias("session"),
        F.count_if(good & (expires > 0) & (expires < now)).alias("expired"),
        F.min(F.when(good & (expires > 0), expires)).alias("earliest"),
        F.countDistinct(F.when(good, host)).alias("hosts"),
    )


def cookie_warnings(cookies_: Column, bad_lines: Column, expired: Column) -> Column:
    """What is to be said of a jar, from its counts."""
    return F.concat_ws(", ", F.when(bad_lines > 0, "bad lines"), F.when(cookies_ == 0, "no cookies"), F.when(expired > 0, "expired cookies"))


def document(text: Column, schema: str) -> Column:
    """A JSON document by a schema; null where it can't be read."""
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.when(parsed["_corrupt"].isNull(), parsed)
