"""Keeping an archive: sitemap walks, dispatch, recaptures, folders, media and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions import urls

DEPTH, DOCUMENTS, URLS = 4, 60, 100_000


def walk_sitemaps(roots: DataFrame, fetched: Callable[[DataFrame], DataFrame], depth: int = DEPTH, documents: int | None = DOCUMENTS, most_urls: int | None = URLS) -> DataFrame:
    """Distinct (``loc``, ``lastmod``) of all sitemaps that ``roots`` (``url``) lead to, level by level.

    ``fetched`` turns a level's URLs into (``url``, ``loc``, ``lastmod``, ``child``,
    ``place``) rows, as ``read_sitemaps`` gives them.  A sitemap is read once,
    whatever its spelling.  Sitemaps come in the order in which a walk meets
    them: roots by URL, then by the document that names them and the place in
    it.  At most ``documents`` are asked for, and none once ``most_urls`` URLs
    are found, as the walk is polite (None: no bound).
    """
    first = lambda rows: rows.groupBy("key").agg(F.min_by("url", F.struct("at", "url")).alias("url"), F.min("at").alias("at"))
    level = first(roots.select("url", urls.visited_key(F.col("url")).alias("key"), F.col("url").alias("at")))
    seen, pages, read, count = None, None, 0, 0
    for _ in range(depth + 1):
        if documents is not None:
            level = level.orderBy("at", "url").limit(max(0, documents - read))
        if most_urls is not None and count >= most_urls:
            break
        level = storage.written(level, "level")
        n = level.count()
        if n == 0:
            break
        read += n
        seen = level.select("key") if seen is None else seen.unionByName(level.select("key"))
        rows = storage.written(fetched(level.select("url")), "sitemaps")  # each is asked for once
        if most_urls is not None:
            # of the documents with URLs no more than that many are needed
            sizes = rows.groupBy("url").agg(F.count_if(~F.col("child")).alias("n")).join(level, "url")
            some = sizes.where("n > 0").orderBy("at", "url").limit(most_urls - count)
            late = some.withColumn("before", F.expr("sum(n) OVER (ORDER BY at, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).where(F.col("before") >= most_urls - count)
            cut = late.agg(F.min(F.struct("at", "url")).alias("cut")).first().cut
            total = sizes.agg(F.sum("n")).first()[0] or 0
            if cut is not None or total >= most_urls - count:
                kept = level if cut is None else level.where(F.struct("at", "url") < F.struct(F.lit(cut["at"]).alias("at"), F.lit(cut["url"]).alias("url")))
                rows, count = rows.join(kept.select("url"), "url", "left_semi"), most_urls
            else:
                count += total
        found = rows.where(~F.col("child")).select("loc", "lastmod")
        pages = found if pages is None else pages.unionByName(found)
        named = rows.where("child").join(level.select("url", "at"), "url")
        named = named.select(F.col("loc").alias("url"), urls.visited_key(F.col("loc")).alias("key"), F.concat_ws(" ", "at", F.lpad(F.col("place").cast("string"), 10, "0")).alias("at"))
        level = first(named.join(seen, "key", "left_anti"))
    if pages is None:
        return roots.limit(0).select(F.col("url").alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    return pages.groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def to_dispatch(feeds: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """Feeds that are on, capture by themselves, have pending items and are not waiting after a failure."""
    moment = F.lit(now).cast("timestamp_ntz")
    ready = feeds.where(F.col("enabled") & F.col("auto_capture") & (F.col("next_capture_at").isNull() | (F.col("next_capture_at") <= moment)))
    return ready.join(items.where("status = 'pending'").select(F.col("feed_id").alias("id")), "id", "left_semi")


def to_recapture(sites: DataFrame, captures: DataFrame, now: str, days: int) -> DataFrame:
    """Sites whose last capture is older than ``days`` and that have no job running."""
    last = captures.where("status <> 'running'").groupBy("site_id").agg(F.max("started_at").alias("last"))
    busy = captures.where("status = 'running'").select(F.col("site_id").alias("id"))
    rows = sites.where(~F.col("deleted")).join(last, F.col("id") == F.col("site_id"))
    return rows.where(F.col("last") <= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{int(days)}' DAY")).join(busy, "id", "left_anti").select("id", "last")


def renamed(folders: DataFrame, old: str, new: str) -> DataFrame:
    """``folders`` with the subtree of ``old`` below ``new``; raises if ``new`` is taken."""
    inside = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    if old != new and not folders.where((F.col("path") == new) & ~inside).isEmpty():
        raise ValueError(f"there is a folder at {new!r}")
    return folders.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 10_000))).otherwise(F.col("path")))


def deletable(folders: DataFrame, sites: DataFrame, path: str) -> DataFrame:
    """One row: ``below`` (folders), ``live`` and ``trashed`` sites, ``roots`` in all, and ``reason`` (null: it may go)."""
    below = folders.where(F.startswith("path", F.lit(path + "/"))).agg(F.count("*").alias("below"))
    roots = folders.agg(F.count_if(~F.contains("path", F.lit("/"))).alias("roots"))
    own = sites.join(folders.where(F.col("path") == path).select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    held = own.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("trashed"))
    one = below.crossJoin(roots).crossJoin(held)  # one row each
    last_root = F.lit("/" not in path) & (F.col("roots") == 1)
    reason = F.when(last_root, "last top-level folder").when(F.col("below") > 0, "has folders").when(F.col("live") + F.col("trashed") > 0, "has sites")
    return one.withColumn("reason", reason)


def next_place(folders: DataFrame, parent: str | None) -> DataFrame:
    """The next free ``sort_order`` among siblings; a null parent is a parent like any other."""
    mine = F.col("parent").eqNullSafe(F.lit(parent).cast("string"))
    return folders.agg((F.coalesce(F.max(F.when(mine, F.col("sort_order"))), F.lit(0)) + 1).alias("next"))


def media_library(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Items of the captures' manifests (``capture_id`` and JSON): ``capture_id``, ``filename``, ``status``, ``bytes``; bad JSON has none."""
    schema = "stats struct<media: struct<items: array<struct<filename: string, status: string, bytes: bigint>>>>"
    rows = manifests.select("capture_id", F.explode(F.from_json(column, schema)["stats"]["media"]["items"]).alias("i"))
    return rows.select("capture_id", "i.filename", "i.status", F.coalesce("i.bytes", F.lit(0)).alias("bytes"))


def sizes_on_disk(files: DataFrame) -> DataFrame:
    """(``capture_id``, ``bytes``): sums of file sizes, links left out."""
    return files.where(~F.col("is_link")).groupBy("capture_id").agg(F.sum("size").alias("bytes"))


def scaled(pages: DataFrame, found: int, matches) -> DataFrame:
    """One row: of a sample of URLs how many match, scaled up to ``found``."""
    return pages.agg(F.count("*").alias("sample"), F.count_if(matches).alias("hits")).select("sample", F.when(F.col("sample") > 0, F.floor(F.col("hits") * F.lit(float(found)) / F.col("sample"))).otherwise(0).cast("long").alias("estimate"))


def report_line(*counts: str):
    """Columns of counts as words; one is singular, and nothing is said of zeros."""
    words = {c: c.replace("_", " ") for c in counts}
    one = lambda w: w[:-1] if w.endswith("s") else w
    said = [F.when(F.col(c) == 1, f"1 {one(w)}").when(F.col(c) != 0, F.concat(F.col(c).cast("string"), F.lit(f" {w}"))) for c, w in words.items()]
    return F.concat_ws("; ", *said)


def report_text(report: DataFrame) -> list[str]:
    """The lines of a one-row report."""
    text = report.select(report_line(*report.columns)).first()[0]
    return text.split("; ") if text else []
