"""Comparisons over time: what changed between captures, what may be pruned, what depends on what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_per(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ranks are cut before they are sorted fully."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def changed_pages(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``change`` (added, removed, changed, unchanged) of two snapshots."""
    x = before.select(F.col(key), F.col(value).alias("_x"), F.lit(True).alias("_in_x"))
    y = after.select(F.col(key), F.col(value).alias("_y"), F.lit(True).alias("_in_y"))
    change = F.when(F.col("_in_x").isNull(), "added").when(F.col("_in_y").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "unchanged").otherwise("changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change"))


def _numbered(captures: DataFrame) -> DataFrame:
    """(``site_id``, ``capture_id``, ``nth``): captures of a site in order, so that facts can be compared by a number."""
    nth = F.expr("row_number() OVER (PARTITION BY site_id ORDER BY started_at, id)")
    return captures.select("site_id", F.col("id").alias("capture_id"), nth.cast("long").alias("nth"))


def last_copies(captures: DataFrame, urls: DataFrame) -> DataFrame:
    """(``site_id``, ``capture_id``, ``urls``, ``example``): captures with URLs that no later capture of the site has.

    Only rows without an error count as held (whatever their status code).  The
    newest capture that holds anything never counts.  No row is compared with
    another: the last holder of each URL is a maximum of numbers, which is
    summed up before and after the shuffle without a sort.
    """
    order = _numbered(captures)
    placed = order.join(urls.where(F.col("error").isNull()).select("capture_id", "url"), "capture_id")
    last = placed.groupBy("site_id", "url").agg(F.max("nth").alias("nth"))
    newest = placed.groupBy("site_id").agg(F.max("nth").alias("newest"))
    rows = last.join(newest, "site_id").where(F.col("nth") < F.col("newest"))
    held = rows.groupBy("site_id", "nth").agg(F.count("*").alias("urls"), F.min("url").alias("example"))
    return held.join(order, ["site_id", "nth"]).select("site_id", "capture_id", "urls", "example")


def dedup_sources(captures: DataFrame, records: DataFrame) -> DataFrame:
    """(``capture_id``, ``dependents``): captures that later revisits resolve into.

    ``records``: ``capture_id``, ``url``, ``digest``, ``revisit``.  For each URL
    and digest the first capture that holds the payload is the source of all
    later revisits, so a minimum is enough and rows are not paired up.
    """
    order = _numbered(captures)
    rows = records.join(order, "capture_id")
    first = rows.where(~F.col("revisit")).groupBy("site_id", "url", "digest").agg(F.min("nth").alias("first"))
    hits = rows.where("revisit").join(first, ["site_id", "url", "digest"]).where(F.col("first") < F.col("nth"))
    used = hits.groupBy("site_id", F.col("first").alias("nth")).agg(F.countDistinct("capture_id").alias("dependents"))
    return used.join(order, ["site_id", "nth"]).select("capture_id", "dependents")


#: Reasons in order of precedence: the first that applies is the one given.
REASONS = ("first", "running", "newest", "monthly", "min-age", "last-copy", "dedup-source")


def retention_plan(captures: DataFrame, held: DataFrame, sources: DataFrame, now: str, keep_last: int = 3, keep_monthly: int = 6, min_age_days: int = 0) -> DataFrame:
    """(``site_id``, ``capture_id``, ``keep``, ``reason``) for every capture.

    ``held`` and ``sources`` have the ``capture_id`` of last copies and of
    deduplication sources.
    """
    from pyspark.sql import Window

    old = Window.partitionBy("site_id").orderBy("started_at", "id")
    new = Window.partitionBy("site_id").orderBy(F.desc("started_at"), F.desc("id"))
    rows = captures.select("site_id", "id", "started_at", "status", F.row_number().over(old).alias("nth"), F.row_number().over(new).alias("age_rank"))
    month = F.date_format("started_at", "yyyy-MM")
    # Months count among captures beyond the newest: the newest of each, the latest months first.
    beyond = F.when(F.col("age_rank") > keep_last, month)
    in_month = Window.partitionBy("site_id", "month").orderBy("age_rank")
    months = Window.partitionBy("site_id", F.col("month").isNull()).orderBy(F.desc("month"))
    rows = rows.withColumn("month", beyond).withColumn("in_month", F.row_number().over(in_month)).withColumn("month_rank", F.dense_rank().over(months))
    rows = rows.join(held.select(F.col("capture_id").alias("id"), F.lit(True).alias("_held")), "id", "left")
    rows = rows.join(sources.select(F.col("capture_id").alias("id"), F.lit(True).alias("_source")), "id", "left")
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(86_400_000_000))
    tests = {
        "first": F.col("nth") == 1,
        "running": ~F.col("status").isin("ok", "partial"),
        "newest": F.col("age_rank") <= keep_last,
        "monthly": F.col("month").isNotNull() & (F.col("in_month") == 1) & (F.col("month_rank") <= keep_monthly),
        "min-age": age < min_age_days if min_age_days else F.lit(False),
        "last-copy": F.col("_held").isNotNull(),
        "dedup-source": F.col("_source").isNotNull(),
    }
    reason = F.coalesce(*[F.when(tests[r], r) for r in REASONS])
    return rows.select("site_id", F.col("id").alias("capture_id"), reason.isNotNull().alias("keep"), F.coalesce(reason, F.lit("prunable")).alias("reason"))


def apply_plan(asked: DataFrame, plan: DataFrame) -> DataFrame:
    """Of the captures asked for, (``capture_id``, ``deleted``): only what the plan lets go."""
    allowed = plan.where(~F.col("keep")).select("capture_id", F.lit(True).alias("_ok"))
    return asked.join(allowed, "capture_id", "left").select("capture_id", F.col("_ok").isNotNull().alias("deleted"))


def due_sites(plan: DataFrame, policies: DataFrame) -> DataFrame:
    """Sites (``site_id``) whose policy is ``on`` and that the plan has something to prune for."""
    return policies.where("on").join(plan.where(~F.col("keep")), "site_id", "left_semi").select("site_id")


def drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of one run that the other lacks, with ``change``."""
    x, y = before.select(key).distinct(), after.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("change", F.lit("gone")).unionByName(y.join(x, key, "left_anti").withColumn("change", F.lit("new")))


def claimed(jobs: DataFrame, busy: DataFrame, capacity: int) -> DataFrame:
    """Jobs to start: by priority and time, one per host, none on a busy host; jobs without a host are free of that."""
    rows = jobs.join(busy.select("host").where("host IS NOT NULL").distinct(), "host", "left_anti")
    with_host = newest_per(rows.where("host IS NOT NULL"), ["host"], [F.col("priority"), F.col("queued_at"), F.col("id")])
    return with_host.unionByName(rows.where("host IS NULL")).orderBy("priority", "queued_at", "id").limit(capacity)


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``table`` with the same keys."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def integrity(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(``capture_id``, ``name``, ``finding``) of artifacts that are missing, differ or have no checksum."""
    found = files.select("capture_id", "name", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    rows = artifacts.join(found, ["capture_id", "name"], "left")
    finding = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("size") != F.col("_size"), "size differs").when(F.col("sha256").isNull(), "no checksum").when(F.col("sha256") != F.col("_sha"), "checksum differs")
    )
    return rows.select("capture_id", "name", finding.alias("finding")).where("finding IS NOT NULL")
