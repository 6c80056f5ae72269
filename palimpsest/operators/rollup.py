"""Roll-ups, reports and usage over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path and every path above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_tree(sites: DataFrame, folders: DataFrame) -> DataFrame:
    """Sites and bytes of each folder alone and with all below it; folders without sites have zeros.

    Sums go by folder first, so what is multiplied by the depth is one row a folder.
    """
    own = sites.where(~F.col("deleted")).groupBy("folder_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    each = folders.join(own, F.col("id") == F.col("folder_id"), "left").select("id", "path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b", F.lit(0)).alias("b"))
    total = each.select(F.explode(ancestors(F.col("path"))).alias("path"), "n", "b").groupBy("path").agg(F.sum("n").alias("total_sites"), F.sum("b").alias("total_bytes"))
    return each.join(total, "path").select("path", F.col("n").alias("sites"), F.col("b").alias("bytes"), "total_sites", "total_bytes")


def counted_by(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Count of each word of a fixed vocabulary, zero where it doesn't occur."""
    words = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias(column))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return words.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def within(column: str, since: str, until: str) -> Column:
    """The half-open window [since, until)."""
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    return (F.col(column) >= moment(since)) & (F.col(column) < moment(until))


def tag_usage(tags: DataFrame, site_tags: DataFrame, sites: DataFrame) -> DataFrame:
    """Visible sites of every tag; tags without any stay, as the condition is part of the join."""
    visible = sites.where(~F.col("deleted")).select(F.col("id").alias("site_id"))
    used = site_tags.join(visible, "site_id", "left_semi").groupBy("slug").agg(F.count("*").alias("n"))
    return tags.join(used, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("sites"))


def tag_lists(sites: DataFrame, site_tags: DataFrame) -> DataFrame:
    """The sorted tags of every site, an empty list where there are none."""
    lists = site_tags.groupBy("site_id").agg(F.array_sort(F.collect_set("slug")).alias("tags"))
    return sites.select(F.col("id").alias("site_id")).join(lists, "site_id", "left").select("site_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def largest(sites: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest sites; those of size zero are dropped only after the cut."""
    return sites.where(~F.col("deleted")).orderBy(F.desc("size_bytes"), "id").limit(n).where("size_bytes > 0").select("id", "title", "size_bytes")


def exposition(series: DataFrame) -> DataFrame:
    """``name{label="x"} value`` lines of (``name``, ``labels`` map, ``value`` double), labels sorted, whole values as integers."""
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))).otherwise("")
    value = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    return series.select(F.concat("name", labels, F.lit(" "), value).alias("line"))
