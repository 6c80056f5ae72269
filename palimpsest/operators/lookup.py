"""Looking things up in an archive: files, index lines, records, and rows of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import matching


def capture_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The compressed WARC files of all captures of a site, oldest capture first (names sort by time)."""
    return files.where(F.col(path).rlike("(^|/)captures/[^/]+/warc/[^/]+[.]warc[.]gz$")).orderBy(path)


def not_relative(lines: DataFrame, expected: DataFrame, order: tuple[str, ...] = ("urlkey", "timestamp")) -> DataFrame:
    """The first line's ``filename`` if it is none of the ``expected`` ones; no row for an index that may be used."""
    first = lines.orderBy(*order).limit(1).where("filename <> ''")
    return first.join(expected.select("filename"), "filename", "left_anti").select("filename")


def first_at_or_after(lines: DataFrame, prefix: str, key: str = "urlkey", then: str = "timestamp") -> DataFrame:
    """The first line of the sorted index whose key is ``prefix`` or greater.

    A filter on the key prunes row groups of a sorted index, and the least is a
    minimum: nothing is sorted and no file is searched by halves.
    """
    return lines.where(F.col(key) >= prefix).agg(F.min(F.struct(key, then)).alias("line")).where("line IS NOT NULL").select("line.*")


def from_capture(filename: Column, capture_dir: Column) -> Column:
    """The file was written by the capture of that directory."""
    return F.startswith(F.translate(filename, "\\", "/"), F.concat(F.lit("captures/"), capture_dir, F.lit("/")))


def feed_candidates(feeds: DataFrame, entries: DataFrame, in_scope: Column) -> DataFrame:
    """What each found feed offers: ``entries``, up to three ``titles``, how many lie in scope, five that don't, and ``problem``.

    ``feeds``: ``url``; ``entries``: ``url`` (the feed's), ``place``, ``entry_url``, ``title``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "entry_url", "title", in_scope.alias("inside"))))
    per = entries.groupBy("url").agg(F.slice(ordered, 1, 3).alias("head"), F.count("*").alias("entries"), F.count_if(in_scope).alias("inside"), F.slice(F.filter(ordered, lambda e: ~e["inside"]), 1, 5).alias("outside"))
    rows = feeds.join(per, "url", "left")
    text = lambda c, field: F.coalesce(F.transform(F.filter(c, lambda e: e[field].isNotNull()), lambda e: e[field]), F.array().cast("array<string>"))
    none = F.lit(0).cast("long")
    return rows.select("url", matching.comment_feed(F.col("url")).alias("comments"), F.coalesce("entries", none).alias("entries"), text("head", "title").alias("titles"), F.coalesce("inside", none).alias("in_scope"), text("outside", "entry_url").alias("out_of_scope"), F.when(F.col("entries").isNull(), "no entries").alias("problem"))


def row_of(rows: DataFrame, key: str, value) -> DataFrame:
    """The one row of a key, or none."""
    return rows.where(F.col(key) == value).limit(1)


def busy(sites: DataFrame, jobs: DataFrame) -> DataFrame:
    """Those of the sites (``site_id``) that a job is queued or running for: they may not be moved."""
    return sites.join(jobs.where(F.col("status").isin("queued", "running")).select("site_id"), "site_id", "left_semi")


def html_records(records: DataFrame, budget: int | None, capture: str = "path") -> DataFrame:
    """HTML responses to be checked, newest capture first, as they lie in its files; ``budget`` at most (None: all)."""
    good = (F.col("rec_type") == "response") & F.startswith("url", F.lit("http")) & F.col("status").between(200, 299) & F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    ordered = records.where(good).orderBy(F.desc(capture), "place")
    return ordered if budget is None else ordered.limit(budget)
