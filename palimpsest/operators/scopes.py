"""What a site's captures may fetch, put together from rows: host rules, patterns, settings, skip lists and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls

SETTINGS = "preset string, max_bytes bigint, max_pages bigint, max_depth int, obey_robots boolean, exclude_hosts array<string>, path_prefix string"
HOSTS = "array<struct<host: string, crawl_pages: boolean, fetch_assets: boolean, path_prefix: string, allow_extensionless: boolean>>"


def _in_order(rows: DataFrame, key: str, *fields: str) -> Column:
    """The rows of a group as an array of ``fields``, by ``key``."""
    sorted_ = F.array_sort(F.collect_list(F.struct(key, F.struct(*fields).alias("x"))))
    return F.transform(sorted_, lambda r: r["x"])


def assembled(sites: DataFrame, rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per site: ``site_id``, ``seeds``, ``hosts``, ``accept``, ``reject``, the settings, and whether it has rules (``indexed``).

    ``sites``: ``site_id``, ``seed_url``, ``settings`` (JSON); ``rules``: ``id``,
    ``site_id`` and the fields of a host; ``patterns``: ``id``, ``site_id``,
    ``kind``, ``pattern``.  A site without rules has its seed's host alone, and
    neither patterns nor settings.  Robots are obeyed unless a setting says not.
    """
    fields = ("host", "crawl_pages", "fetch_assets", "path_prefix", "allow_extensionless")
    hosts = rules.groupBy("site_id").agg(_in_order(rules, "id", *fields).alias("hosts"))
    lists = patterns.groupBy("site_id").agg(_in_order(patterns, "id", "kind", "pattern").alias("patterns"))
    rows = sites.join(hosts, "site_id", "left").join(lists, "site_id", "left").withColumn("indexed", F.col("hosts").isNotNull())
    of_kind = lambda kind: F.transform(F.filter(F.coalesce("patterns", F.array().cast("array<struct<kind: string, pattern: string>>")), lambda p: p["kind"] == kind), lambda p: p["pattern"])
    none, stored = F.array().cast("array<string>"), F.from_json("settings", SETTINGS)
    seed = F.struct(urls.host(F.col("seed_url")), F.lit(True), F.lit(True), F.lit(None).cast("string"), F.lit(False))
    when = lambda x, otherwise: F.when(F.col("indexed"), x).otherwise(otherwise)
    return rows.select(
        "site_id",
        "indexed",
        F.array("seed_url").alias("seeds"),
        F.coalesce("hosts", F.array(seed).cast(HOSTS)).alias("hosts"),
        when(of_kind("accept"), none).alias("accept"),
        when(of_kind("reject"), none).alias("reject"),
        *[when(stored[n], F.lit(None)).alias(n) for n in ("preset", "max_bytes", "max_pages", "max_depth", "path_prefix")],
        when(F.coalesce(stored["obey_robots"], F.lit(True)), F.lit(True)).alias("obey_robots"),
        when(F.coalesce(stored["exclude_hosts"], none), none).alias("exclude_hosts"),
    )


def unindexed(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Sites that nobody chose hosts for."""
    return sites.join(rules.select("site_id"), "site_id", "left_anti")


def with_skip_list(scopes: DataFrame, skip: list[str], exceptions: DataFrame) -> DataFrame:
    """``scopes`` with ``seeds`` of all the site's addresses and ``skip``: the list for all sites but for the site's ``exceptions``.

    ``exceptions``: ``site_id``, ``exceptions`` and ``extra_seeds`` (arrays or null).
    """
    none, listed = F.array().cast("array<string>"), F.array(*map(F.lit, skip)).cast("array<string>")
    rows = scopes.join(exceptions, "site_id", "left")
    kept = F.filter(listed, lambda p: ~F.array_contains(F.coalesce("exceptions", none), p))
    return rows.withColumn("skip", kept).withColumn("seeds", F.array_distinct(F.concat("seeds", F.coalesce("extra_seeds", none)))).drop("exceptions", "extra_seeds")


def companions(scopes: DataFrame, presets: DataFrame) -> DataFrame:
    """The scope of the second pass that a site's recorded preset offers; sites without one have none.

    ``presets``: ``preset``, ``accept_pattern``, ``lifts`` (array), a row each.
    The pass follows only the accept pattern, rejects what the site rejects but
    for what it lifts, and has no limit of pages.
    """
    rows = scopes.join(presets.where("accept_pattern IS NOT NULL"), "preset")
    kept = F.filter("reject", lambda p: ~F.array_contains("lifts", p))
    return rows.withColumn("accept", F.array("accept_pattern")).withColumn("reject", kept).withColumn("max_pages", F.lit(None).cast("bigint")).drop("accept_pattern", "lifts")
