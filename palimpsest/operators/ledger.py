"""Keeping account of an archive: what was verified, expired, imported, reported and refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scalars, urls
from palimpsest.operators.hosts import with_owner

#: Keys that an audit entry's detail may not have.
FORBIDDEN = "password token secret cookies totp_secret recovery_codes session".split()
FILES = "array<struct<name: string, size: bigint, sha256: string>>"


def artifacts(captures: DataFrame) -> DataFrame:
    """``captures`` with ``artifacts``: the files that the capture's ``manifest`` (JSON) lists, else the ones on record (``warc_files``), else null."""
    listed = F.from_json("manifest", f"warc_files {FILES}")["warc_files"]
    some = lambda c: F.when(F.size(c) > 0, F.filter(c, lambda f: f.isNotNull()))
    return captures.withColumn("artifacts", F.coalesce(some(listed), some(F.col("warc_files"))))


def verifiable(captures: DataFrame, sites: DataFrame) -> DataFrame:
    """Finished captures (whole or partial) of some sites, by site and time."""
    return captures.where(F.col("status").isin("ok", "partial")).join(sites.select("site_id"), "site_id", "left_semi").orderBy("site_id", "started_at")


def verification_due(last: Column, now: Column, days: int) -> Column:
    """A verification is due when ``days`` have passed since the last, or there was none; never if ``days`` is not positive."""
    return scalars.elapsed(now, last, days) if days > 0 else F.lit(False)


def expired_trash(sites: DataFrame, now: str, days: int) -> DataFrame:
    """Deleted rows whose time in the trash is over."""
    return sites.where(F.col("deleted_at") <= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{max(int(days), 0)}' DAY"))


def live_sessions(sessions: DataFrame, now: str) -> DataFrame:
    """Sessions without those expired, and those revoked more than thirty days ago."""
    moment = F.lit(now).cast("timestamp_ntz")
    gone = (F.col("expires_at") <= moment) | F.coalesce(F.col("revoked_at") < moment - F.expr("INTERVAL '30' DAY"), F.lit(False))
    return sessions.where(~gone)


def link_summary(dead: Column, in_scope: Column, pages: Column, example: Column) -> Column:
    """One sentence about a link check."""
    number = lambda c: c.cast("string")
    fine = F.concat(F.lit("every one of "), number(in_scope), F.lit(" in-scope link(s) resolves in the index"))
    bad = F.concat(number(dead), F.lit(" link target(s) do not resolve in replay, from "), number(pages), F.lit(" archived page(s) — e.g. "), example)
    return F.when(dead == 0, fine).otherwise(bad)


def change_summary(new: Column, gone: Column) -> Column:
    """What a poll of a feed found, in words."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    text = F.concat_ws(", ", part(new, "new"), part(gone, "gone"))
    return F.when(text == "", "no change").otherwise(text)


def health(captures: DataFrame, findings: DataFrame, now: str, days: int) -> DataFrame:
    """One row for the report: ``captures``, ``verified``, ``oldest_unverified``, ``last_run``, ``findings``, ``due``.

    ``captures``: ``started_at``, ``verified_at``; ``findings``: a row each of the last run.
    """
    one = captures.agg(F.count("*").alias("captures"), F.count("verified_at").alias("verified"), F.min(F.when(F.col("verified_at").isNull(), F.col("started_at"))).alias("oldest_unverified"), F.max("verified_at").alias("last_run"))
    many = findings.agg(F.count("*").alias("findings"))
    return one.crossJoin(many).withColumn("due", verification_due(F.col("last_run"), F.lit(now).cast("timestamp_ntz"), days))  # one row each


def import_plan(found: DataFrame, sites: DataFrame, crawl: bool = False, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per group of an import: ``registrable``, ``site_id``, ``action`` (create, update or error), ``kind``, ``only_listed`` and ``urls``.

    ``found``: ``url``, ``place``; ``sites``: ``id``, ``host``; ``suffixes``: a public suffix list.  A group without a
    domain that can be registered is an error of its own and stops no other.  A
    listed page is captured alone unless ``crawl`` asks for its site.
    """
    rows = with_owner(found.withColumn("_host", urls.host(F.col("url"))), "_host", suffixes)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda r: r["url"])
    per = rows.groupBy("registrable").agg(listed.alias("urls"))
    known = with_owner(sites.select("id", F.lower("host").alias("host")), "host", suffixes).groupBy("registrable").agg(F.min("id").alias("site_id"))
    action = F.when(~F.contains("registrable", F.lit(".")), "error").when(F.col("site_id").isNotNull(), "update").otherwise("create")
    rows = per.join(known, "registrable", "left").withColumn("action", action)
    queued = F.col("action") != "error"
    return rows.select("registrable", "site_id", "action", F.when(queued, "full" if crawl else "incremental").alias("kind"), F.when(queued, F.lit(not crawl)).alias("only_listed"), "urls")


def archive_import(snapshots: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """One row per host of a foreign archive: ``host``, ``snapshots``, ``files``, ``skipped``.

    ``snapshots``: ``url``, ``files`` (array).  Snapshots without files are left
    out, and hosts not asked for; a host that can't be a site is counted as skipped.
    """
    rows = snapshots.where(F.size(F.coalesce("files", F.array().cast("array<string>"))) > 0).withColumn("host", urls.host(F.col("url")))
    if hosts:
        rows = rows.where(F.col("host").isin([h.lower() for h in hosts]))
    name = F.when(F.col("host") == "", "unknown").otherwise(F.col("host"))
    per = rows.groupBy(name.alias("host")).agg(F.count("*").alias("snapshots"), F.sum(F.size("files")).alias("files"))
    return per.withColumn("skipped", F.when(F.contains("host", F.lit(".")), 0).otherwise(F.col("snapshots")).cast("long")).orderBy("host")


def rejected(texts: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(``key``, ``place``, ``candidate``, ``reason``): what looked like a URL in a pasted list and is none."""
    raw = F.regexp_extract_all(F.col(text), F.lit(r"""https?://[^\s<>"'\])]*"""), F.lit(0))
    rows = texts.select(key, F.posexplode(raw).alias("place", "u")).withColumn("candidate", F.rtrim("u", F.lit(".,;:!?")))
    port = F.regexp_extract("candidate", r"^https?://[^/?#]*:([^/?#@]*)", 1)
    bad_port = (port != "") & (~port.rlike("^[0-9]{1,5}$") | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535))
    reason = F.when(bad_port, "bad port").when(urls.host(F.col("candidate")) == "", "no host name")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(key, "place", F.substring("candidate", 1, 120).alias("candidate"), "reason")


def script_directives(text: Column) -> Column:
    """Struct of a user script's metadata: first ``name`` and ``description``, last ``version``, ``namespace`` and ``run_at``, and lists of the others; null without a block."""
    block = F.regexp_extract(text, r"(?s)//\s*==UserScript==(.*?)//\s*==/UserScript==", 1)
    of = lambda *keys: F.regexp_extract_all(block, F.lit(rf"(?im)^\s*//\s*@(?:{'|'.join(keys)})(?=\s|$)[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
    first = lambda values: F.try_element_at(F.filter(values, lambda x: x != ""), F.lit(1))
    last = lambda values: F.try_element_at(values, F.lit(-1))
    run_at = F.coalesce(F.nullif(last(of("run-at")), F.lit("")), F.lit("document-idle"))
    lists = {"matches": of("match"), "includes": of("include"), "excludes": of("exclude", "exclude-match"), "grants": of("grant"), "requires": of("require"), "resources": of("resource")}
    made = F.struct(first(of("name")).alias("name"), first(of("description")).alias("description"), last(of("version")).alias("version"), last(of("namespace")).alias("namespace"), run_at.alias("run_at"), *[v.alias(k) for k, v in lists.items()])
    return F.when(text.rlike(r"(?s)//\s*==UserScript==.*?//\s*==/UserScript=="), made)


def audited(log: DataFrame, events: DataFrame) -> DataFrame:
    """``log`` with ``events`` (``ts``, ``action``, ``actor``, ``target``, ``detail`` map) added; a detail that tells a secret ends the job."""
    leaks = F.arrays_overlap(F.map_keys("detail"), F.array(*map(F.lit, FORBIDDEN)))
    checked = F.when(F.coalesce(leaks, F.lit(False)), F.raise_error(F.lit("an audit entry's detail has a secret key")).cast("map<string,string>")).otherwise(F.col("detail"))
    return log.unionByName(events.withColumn("detail", checked))


def failed_logins(accounts: DataFrame, failures: DataFrame, allowed: int = 5) -> DataFrame:
    """``accounts`` (``name``, ``failed``) with a run of failures (``name``, ``ts``) counted in: ``failed`` and ``locked_until``."""
    new = failures.groupBy("name").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rows = accounts.join(new, "name", "left").withColumn("failed", F.col("failed") + F.coalesce("n", F.lit(0)))
    until = F.col("last") + F.make_dt_interval(secs=scalars.lockout_seconds(F.col("failed"), allowed))
    return rows.select("name", "failed", F.when((F.col("failed") >= allowed) & F.col("last").isNotNull(), until).alias("locked_until"))
