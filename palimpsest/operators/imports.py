"""Lists and foreign archives to be taken in: grouping URLs and snapshots by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.operators.hosts import with_owner

MOST_URLS = 5000


def listed(texts: DataFrame, text: str = "text", key: str = "id", cap: int | None = MOST_URLS) -> DataFrame:
    """(``key``, ``url``, ``place``): distinct URLs of each pasted text in order of first appearance, ``cap`` at most.

    The cap is per text and belongs to the import form; None takes all.
    """
    raw = F.regexp_extract_all(F.col(text), F.lit(r"""https?://[^\s<>"'\])]+"""), F.lit(0))
    rows = texts.select(key, F.posexplode(raw).alias("place", "u")).withColumn("u", F.rtrim("u", F.lit(".,;:!?")))
    port = F.regexp_extract(F.coalesce(urls.part(F.col("u"), "AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    path, query = F.coalesce(urls.part(F.col("u"), "PATH"), F.lit("")), urls.part(F.col("u"), "QUERY")
    url = F.concat(F.lower(urls.part(F.col("u"), "PROTOCOL")), F.lit("://"), urls.host(F.col("u")), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))
    first = rows.where(urls.host(F.col("u")) != "").groupBy(key, url.alias("url")).agg(F.min("place").alias("place"))
    if cap is None:
        return first
    return first.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY place)")).where(F.col("_n") <= cap).drop("_n")


def grouped(found: DataFrame, sites: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(``registrable``, ``n``, ``hosts``, ``site_id``): URLs by registered domain, with the site that has it already.

    ``sites``: ``id``, ``host``; ``suffixes``: a public suffix list.
    """
    rows = with_owner(found.select("url", urls.host(F.col("url")).alias("host")), "host", suffixes)
    per = rows.groupBy("registrable").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))
    known = with_owner(sites.select("id", F.lower("host").alias("host")), "host", suffixes).groupBy("registrable").agg(F.min("id").alias("site_id"))
    return per.join(known, "registrable", "left")


def snapshots(rows: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """Snapshots of a foreign index with their sorted tags; those without URL or time are dropped.

    ``rows``: ``id``, ``url``, ``timestamp``, ``added``; ``bridge``: ``snapshot_id``, ``tag_id``; ``tags``: ``id``, ``name``.
    """
    lists = bridge.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("snapshot_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    good = rows.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("timestamp", F.lit("")) != ""))
    return good.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def seeds(found: DataFrame) -> DataFrame:
    """The shortest path of each host's snapshots, ties by URL."""
    rows = found.select(urls.host(F.col("url")).alias("host"), "url")
    return rows.groupBy("host").agg(F.min_by("url", F.struct(F.length(F.coalesce(urls.part(F.col("url"), "PATH"), F.lit("/"))), "url")).alias("seed"), F.count("*").alias("n"))
