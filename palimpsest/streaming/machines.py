"""State machines of watched things: one pure step each, used by batch and streaming queries alike.

State is kept per key and never expires, as what is watched is watched until it
is removed; a stream's state is bounded by the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palimpsest.functions import matching

#: Observations in a row that must agree before a state changes; failures in a row before a feed is disabled.
CONFIRMATIONS, MOST_FAILURES = 2, 10


def health_step(state: tuple | None, seen: str) -> tuple[tuple, str | None]:
    """(state, pending, consecutive) after an observation, and the new state if it changed.

    The first observation is the baseline; one that agrees with the state clears
    the counter.
    """
    if state is None:
        return (seen, None, 0), None
    now, pending, n = state
    if seen == now:
        return (now, None, 0), None
    n = n + 1 if pending == seen else 1
    return ((seen, None, 0), seen) if n >= CONFIRMATIONS else ((now, seen, n), None)


def feed_step(state: tuple | None, ok: bool) -> tuple[tuple, str]:
    """(failures, enabled, seen_before) after a poll, and what it did."""
    failures, enabled, before = state or (0, True, False)
    if not enabled:
        return (failures, enabled, before), "disabled"
    if ok:
        return (0, True, True), "polled" if before else "baseline"
    failures += 1
    enabled = failures < MOST_FAILURES
    return (failures, enabled, before), "failed" if enabled else "disabled"


HEALTH = "key long, id long, changed_to string"
FEED = "key long, polls long, failures long, enabled boolean, last_action string"


def _health_rows(key, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    out = []
    for i, seen in zip(rows["id"], rows["seen"], strict=True):
        state, changed = health_step(state, seen)
        if changed:
            out.append((key, i, changed))
    return out, state


def health_changes(observations: DataFrame) -> DataFrame:
    """State changes of each key, in batch.  ``observations``: ``key``, ``id``, ``ts``, ``seen``.

    A state holds from its ``CONFIRMATIONS``-th observation in a row, the first
    of all from the start; a change is where what holds differs from what held.
    """
    order = "OVER (PARTITION BY key ORDER BY ts, id)"
    agrees = " AND ".join(f"seen = lag(seen, {n}) {order}" for n in range(1, CONFIRMATIONS)) or "true"
    rows = observations.withColumn("holds", F.expr(f"coalesce({agrees}, false) OR row_number() {order} = 1")).where("holds")
    rows = rows.withColumn("held", F.expr(f"lag(seen) {order}"))
    return rows.where("held IS NOT NULL AND held <> seen").select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("seen").alias("changed_to"))


def health_stream(observations: DataFrame) -> DataFrame:
    """The same over a stream: state per key is carried from one micro-batch to the next."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = None
        if state.exists:
            a, b, n = state.get
            now = (a, b or None, n)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out, now = _health_rows(key[0], rows, now)
        state.update((now[0], now[1] or "", now[2]))
        yield pd.DataFrame(out, columns=["key", "id", "changed_to"])

    return observations.groupBy("key").applyInPandasWithState(run, HEALTH, "state string, pending string, consecutive long", "append", GroupStateTimeout.NoTimeout)


def feed_states(polls: DataFrame) -> DataFrame:
    """Where each feed stands after its polls.  ``polls``: ``key``, ``id``, ``ts``, ``ok``.

    Failures since the same success are a run; a run of ``MOST_FAILURES`` disables for good.
    """
    run = F.expr("count_if(ok) OVER (PARTITION BY key ORDER BY ts, id)")
    runs = polls.withColumn("run", run).groupBy("key", "run").agg(F.count_if(~F.col("ok")).alias("failures"), F.count("*").alias("n"))
    per = runs.groupBy("key").agg(F.sum("n").alias("polls"), F.max("failures").alias("worst"), F.max_by("failures", "run").alias("last"), F.max("run").alias("successes"))
    enabled = F.col("worst") < MOST_FAILURES
    did = F.when(~enabled, "disabled").when(F.col("last") > 0, "failed").when(F.col("successes") == 1, "baseline").otherwise("polled")
    return per.select(F.col("key").cast("long").alias("key"), "polls", F.when(enabled, F.col("last")).otherwise(F.lit(MOST_FAILURES)).cast("long").alias("failures"), enabled.alias("enabled"), did.alias("last_action"))


def feed_stream(polls: DataFrame) -> DataFrame:
    """The same over a stream, an updated row per key and micro-batch."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, now, did = 0, None, ""
        if state.exists:
            n, failures, enabled, before = state.get
            now = (failures, enabled, before)
        for ok in pd.concat(list(batches)).sort_values(["ts", "id"])["ok"]:
            n, (now, did) = n + 1, feed_step(now, bool(ok))
        state.update((n, *now))
        yield pd.DataFrame([(key[0], n, now[0], now[1], did)], columns=["key", "polls", "failures", "enabled", "last_action"])

    return polls.groupBy("key").applyInPandasWithState(run, FEED, "polls long, failures long, enabled boolean, before boolean", "update", GroupStateTimeout.NoTimeout)


def merge_items(known: DataFrame, entries: DataFrame, first_poll: bool) -> DataFrame:
    """Items of a feed after a poll: ``guid``, ``canonical``, ``status``, ``content_hash``, ``updated``.

    An entry is an item known by its guid, or else by its canonical URL.  New
    ones are pending, or skipped if this is the baseline; a changed content hash
    makes an item pending again; ``updated`` never goes back.  Of several entries
    with one guid the first (by ``place``) counts.
    """
    from palimpsest.operators.history import newest_per

    entries = newest_per(entries, ["guid"], [F.col("place")])
    by_guid = known.select(F.col("guid"), F.col("guid").alias("_g1"))
    by_url = newest_per(known, ["canonical"], [F.col("guid")]).select("canonical", F.col("guid").alias("_g2"))
    hit = entries.join(by_guid, "guid", "left").join(by_url, "canonical", "left").withColumn("item", F.coalesce("_g1", "_g2"))
    seen = newest_per(hit.where("item IS NOT NULL"), ["item"], [F.col("place")]).select("item", F.col("content_hash").alias("_hash"), F.col("updated").alias("_updated"))
    changed = F.col("_hash").isNotNull() & F.col("content_hash").isNotNull() & (F.col("_hash") != F.col("content_hash"))
    old = known.join(seen, F.col("guid") == F.col("item"), "left").select(
        "guid", "canonical", F.when(changed, "pending").otherwise(F.col("status")).alias("status"), F.coalesce("_hash", "content_hash").alias("content_hash"), F.greatest("updated", "_updated").alias("updated")
    )
    new = newest_per(hit.where("item IS NULL"), ["canonical"], [F.col("place")])
    return old.unionByName(new.select("guid", "canonical", F.lit("skipped" if first_poll else "pending").alias("status"), "content_hash", "updated"))


def mark_gone(items: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """Items a complete read no longer lists; an incomplete read says nothing."""
    return items.join(seen.select("guid"), "guid", "left_anti").select("guid") if complete else items.limit(0).select("guid")


def folded(events: DataFrame, key: str = "key", order: str = "id") -> DataFrame:
    """One row per job of its events: ``urls``, ``errors``, ``revisits``, ``bytes`` (last that is not zero), ``malformed``."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("status", F.lit(0)) >= 400)
    url = F.col("type") == "url"
    last = F.max_by(F.col("bytes"), F.when((F.col("type") == "progress") & (F.coalesce("bytes", F.lit(0)) != 0), F.col(order)))
    return events.groupBy(key).agg(
        F.count_if(url).alias("urls"), F.count_if(url & failed).alias("errors"), F.count_if(url & F.coalesce("revisit", F.lit(False))).alias("revisits"), F.coalesce(last, F.lit(0)).alias("bytes"), F.count_if(F.col("type").isNull()).alias("malformed")
    )


def final_status(result, returncode, cancelled):
    """The status of a finished job, as a column: what the engine says and how it ended must agree."""
    return F.when(cancelled, F.when(result.isNull(), "cancelled").otherwise("partial")).when(result.isNull(), "failed").when((returncode != 0) & (result == "ok"), "partial").otherwise(result)


def new_feeds(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct found feeds (``url``) that are not ``known``, with ``enabled``: those of comments arrive switched off."""
    rows = found.dropDuplicates(["url"]).join(known.select("url"), "url", "left_anti")
    return rows.withColumn("enabled", ~matching.comment_feed(F.col("url")))
