"""Reading archived pages: versions, articles, anchored quotes and page comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.difference import block_changes
from palimpsest.operators.history import newest_per

CONTEXT = 40


def versions(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """(``url``, ``capture_id``, ``started_at``): captures whose text has the URL, each once."""
    rows = pages.select("url", "capture_id").distinct()
    return rows.join(captures.select(F.col("id").alias("capture_id"), "started_at"), "capture_id")


def newest_of_seeds(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """The newest page of the first seed that has one, else the first page in key order: one row.

    ``seeds``: ``url``, ``place``.
    """
    found = records.join(seeds, "url").orderBy("place", F.desc("timestamp")).limit(1).select("urlkey", "timestamp", "url", F.lit(0).alias("_way"))
    other = records.orderBy("urlkey", "timestamp").limit(1).select("urlkey", "timestamp", "url", F.lit(1).alias("_way"))
    return found.unionByName(other).orderBy("_way").limit(1).drop("_way")


def page_list(records: DataFrame, titles: DataFrame) -> DataFrame:
    """The first good HTML record of each URL with its title, or its URL for want of one.

    ``titles``: ``url``, ``title``, ``capture_id``; the first capture with a title counts.
    """
    good = records.where(F.contains(F.lower("mime"), F.lit("html")) & F.col("status").between(200, 299) & (F.col("url") != ""))
    first = newest_per(good, ["url"], [F.col("urlkey"), F.col("timestamp")]).select("url", "timestamp")
    named = newest_per(titles.where("title <> ''"), ["url"], [F.col("capture_id")]).select("url", "title")
    return first.join(named, "url", "left").select("url", "timestamp", F.coalesce("title", "url").alias("title"))


def placed(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(``id``, ``block``, ``start``, ``found``) of notes in pages (``url``, ``blocks``); a lost one has block -1.

    ``notes``: ``id`` (one each), ``url``, ``quote``, ``place``, ``prefix``, ``suffix``.  The quote's
    first place in its own block is best, then the first whose context agrees
    (for notes that have some), then the first of all.
    """
    rows = notes.join(pages.select("url", "blocks"), "url", "left").select("id", "quote", F.col("place").cast("int").alias("place"), F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"), F.posexplode_outer("blocks").alias("block", "text"))
    size, text = F.length("quote"), F.col("text")
    last = F.length(text) - size + 1
    starts = F.when(last > 0, F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(text, at, size) == F.col("quote")))
    hits = rows.withColumn("at", F.explode_outer(starts))
    before = F.substring(text, F.greatest(F.col("at") - CONTEXT, F.lit(1)), F.least(F.col("at") - 1, F.lit(CONTEXT)))
    agrees = ((F.col("prefix") != "") | (F.col("suffix") != "")) & F.endswith(before, F.col("prefix")) & F.startswith(F.substring(text, F.col("at") + size, F.lit(CONTEXT)), F.col("suffix"))
    rank = F.when(F.col("block") == F.col("place"), 0).when(agrees, 1).otherwise(2)
    best = hits.groupBy("id").agg(F.min(F.when(F.col("at").isNotNull(), F.struct(rank.alias("rank"), "block", "at"))).alias("best"))
    return best.select("id", F.coalesce("best.block", F.lit(-1)).alias("block"), F.coalesce(F.col("best.at") - 1, F.lit(0)).alias("start"), F.col("best").isNotNull().alias("found"))


def compare_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(``url``, ``change``, ``ratio``, ``changes``) of two captures' pages (``url``, ``title``, ``blocks``); a new title is a change too."""
    x = before.select("url", F.col("title").alias("t0"), F.col("blocks").alias("before"), F.lit(True).alias("in0"))
    y = after.select("url", F.col("title").alias("t1"), F.col("blocks").alias("after"), F.lit(True).alias("in1"))
    both = x.join(y, "url", "full_outer")
    made = block_changes(both.select(F.col("url").alias("id"), "before", "after")).withColumnRenamed("id", "url")
    out = made.join(both.select("url", "t0", "t1", "in0", "in1"), "url")
    retitled = F.coalesce("t0", F.lit("")) != F.coalesce("t1", F.lit(""))
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when((F.size("changes") > 0) | retitled, "changed").otherwise("unchanged")
    return out.select("url", change.alias("change"), "ratio", "changes")
