"""Audits of a finished capture: missing assets, gates, mangled requests, revisits and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import gates


def missing_assets(references: DataFrame, captured: DataFrame) -> DataFrame:
    """Distinct referenced assets (``url``) that were not captured."""
    return references.select("url").distinct().join(captured.select("url"), "url", "left_anti")


def gate_counts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row: ``gates`` (documents at a gate's address), ``scanned``, ``overlaid``, ``blocked``; the buckets are disjoint."""
    v = gates.verdict(F.col(html), F.col(url))
    return pages.select(v.alias("v")).agg(F.count_if(F.col("v") == "url").alias("gates"), F.count_if(F.col("v") != "url").alias("scanned"), F.count_if(F.col("v") == "overlay").alias("overlaid"), F.count_if(F.col("v") == "phrase").alias("blocked"))


def mangled(url: Column) -> Column:
    """A request for a style sheet's escape that nobody decoded."""
    return F.contains(url, F.lit("%5C")) | F.contains(url, F.lit("%5c")) | F.contains(url, F.lit("\\"))


def intended_host(url: Column) -> Column:
    """The host that a mangled URL was meant for, or null."""
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(url), url), r"\\([^0-9A-Fa-f\s])", "$1")
    found = F.regexp_extract(F.regexp_replace(plain, "^[^/]*//", ""), r"https?://([^/\s\\]+)", 1)
    return F.when(found != "", found)


def revisits(logged: DataFrame, indexed: DataFrame) -> DataFrame:
    """URLs that the log says were fetched and the index has no record of: they were seen before."""
    return logged.select("url").where("url IS NOT NULL").distinct().join(indexed.select("url"), "url", "left_anti")


def backup_coverage(captures: DataFrame, copied: DataFrame) -> DataFrame:
    """(``dir_name``, ``state``): present, missing or unknown to the catalogue."""
    x, y = captures.select("dir_name", F.lit(True).alias("_x")).distinct(), copied.select("dir_name", F.lit(True).alias("_y")).distinct()
    state = F.when(F.col("_x").isNull(), "unknown").when(F.col("_y").isNull(), "missing").otherwise("present")
    return x.join(y, "dir_name", "full_outer").select("dir_name", state.alias("state"))


def projection(done: Column, seconds: Column, cap: Column) -> Column:
    """Struct of ``per_minute``, ``remaining`` and ``eta_minutes``; null where it can't be known."""
    rate = F.try_divide(done * F.lit(60.0), seconds)
    left = F.greatest(cap - done, F.lit(0))
    return F.struct(rate.alias("per_minute"), left.alias("remaining"), F.try_divide(left.cast("double"), F.when(rate > 0, rate)).alias("eta_minutes"))
