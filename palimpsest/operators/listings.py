"""Lists that people look at: the first rows in an order that ties cannot change, pages of them, and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days ahead that a profile counts as expiring, rows of such a list, and rows of a batch.
SOON_DAYS, SHORT, BATCH = 21, 10, 50
#: States of a site that a report names.
NOTABLE = ("gone", "moved", "unreachable")


def first_of(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset`` in ``order``, with their ``place`` from 1.

    ``order`` must end in a unique column.  Only the best rows of each partition
    meet in one task; places are given to what is left.
    """
    best = rows.orderBy(*order).limit(offset + limit)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.where(F.col("place") > offset)


def newest(rows: DataFrame, limit: int, offset: int = 0, moment: str = "ts", key: str = "id") -> DataFrame:
    """The newest rows, of the same moment those with the greatest key first."""
    return first_of(rows, [F.desc_nulls_last(moment), F.desc(key)], limit, offset)


def pending(items: DataFrame, limit: int) -> DataFrame:
    """Pending items, the newest ``published`` first, those without a date last, then by ``id``."""
    return first_of(items.where(F.col("status") == "pending"), [F.desc_nulls_last("published"), F.asc("id")], limit)


def expiring(profiles: DataFrame, now: str, days: int = SOON_DAYS, limit: int = SHORT) -> DataFrame:
    """Profiles whose ``expires_at`` is over or comes within ``days``, soonest first, with ``expired``."""
    moment = F.lit(now).cast("timestamp_ntz")
    soon = profiles.where(F.col("expires_at") <= moment + F.expr(f"INTERVAL '{int(days)}' DAY")).withColumn("expired", F.col("expires_at") <= moment)
    return first_of(soon, [F.asc("expires_at"), F.asc("id")], limit)


def vanished(sites: DataFrame, limit: int = SHORT) -> DataFrame:
    """The first sites by title, then id, in a state that a report names."""
    return first_of(sites.where(F.col("state").isin(*NOTABLE)), [F.asc("title"), F.asc("id")], limit)


def trash(sites: DataFrame, now: str, keep_days: int) -> DataFrame:
    """Deleted sites with the whole ``days_left`` until they go, never below 0; the caller sorts them, last deleted first."""
    elapsed = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("deleted_at").cast("timestamp"))) / F.lit(86_400_000_000))
    return sites.where(F.col("deleted_at").isNotNull()).withColumn("days_left", F.greatest(F.lit(keep_days) - elapsed, F.lit(0)).cast("long"))


def placed(rows: DataFrame, within: str, order: list) -> DataFrame:
    """``rows`` with their ``place`` from 1 in the list of each ``within``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def batches(rows: DataFrame, within: str, order: list, size: int = BATCH) -> DataFrame:
    """``rows`` with the number of their ``batch`` of ``size``, from 0, in each ``within``."""
    return placed(rows, within, order).withColumn("batch", F.expr(f"(place - 1) div {int(size)}"))
