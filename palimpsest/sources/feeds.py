"""Feeds and sitemaps: bytes to entries."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.urls import canonical_text

MOST_TITLE = 500
#: Entries that are handed to Spark together, and those of one feed.
TOGETHER = 10_000
#: Names of tags and moments that were read already, so many of each (functions go to executors by value, as ``lru_cache`` can't).
MOST_KNOWN = 10_000
_names: dict[str, str] = {}
_moments: dict[str, str | None] = {}


def _local(tag: str) -> str:
    if tag not in _names:
        if len(_names) >= MOST_KNOWN:
            _names.clear()
        _names[tag] = tag.rpartition("}")[2].lower()
    return _names[tag]


def _moment(text: str | None) -> str | None:
    if not text:
        return None
    if text not in _moments:
        if len(_moments) >= MOST_KNOWN:
            _moments.clear()
        _moments[text] = _read_moment(text)
    return _moments[text]


def _read_moment(text: str) -> str | None:
    for read in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            at = read(text.strip())
            return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        except (TypeError, ValueError):
            continue
    return None


def _tree(body: bytes) -> ET.Element | None:
    if b"<!DOCTYPE" in body[:2000] and b"<!ENTITY" in body:
        return None  # entities are not expanded
    try:
        return ET.fromstring(body)
    except (ET.ParseError, ValueError):
        return None


def sitemap(body: bytes) -> dict:
    """``pages`` (loc, lastmod), ``children`` and ``ok`` of a urlset or sitemapindex in any namespace."""
    root = _tree(body or b"")
    kind = _local(root.tag) if root is not None else ""
    rows = [{_local(x.tag): (x.text or "").strip() for x in item} for item in root] if kind in ("urlset", "sitemapindex") else []
    locs = [(r["loc"], r.get("lastmod") or None) for r in rows if r.get("loc")]
    return {"ok": kind in ("urlset", "sitemapindex"), "pages": locs if kind == "urlset" else [], "children": [u for u, _ in locs] if kind == "sitemapindex" else []}


def feed(body: bytes) -> dict:
    """``kind`` (rss, atom, json, unknown), ``title`` and ``entries`` of a feed.

    An entry has guid (its id, else its canonical URL), url, canonical, title,
    published and updated; one without a link is no entry.
    """
    body = body or b""
    if body.lstrip()[:1] == b"{":
        try:
            data = json.loads(body)
        except ValueError:
            data = None
        if not isinstance(data, dict) or "items" not in data:
            return {"kind": "unknown", "title": None, "entries": []}
        rows = [(i.get("id"), i.get("url") or i.get("external_url"), i.get("title"), i.get("date_published"), i.get("date_modified")) for i in data["items"] if isinstance(i, dict)]
        return {"kind": "json", "title": data.get("title"), "entries": _entries(rows)}
    root = _tree(body)
    kind = {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(_local(root.tag), "unknown") if root is not None else "unknown"
    if kind == "unknown":
        return {"kind": kind, "title": None, "entries": []}

    def texts(item) -> dict[str, str]:
        """The first text of each name in ``item``; blank ones don't count."""
        out: dict[str, str] = {}
        for x in item:
            if x.text and (found := x.text.strip()):
                out.setdefault(_local(x.tag), found)
        return out

    def link(item) -> str | None:
        return next((x.get("href") for x in item if _local(x.tag) == "link" and x.get("rel", "alternate") == "alternate"), None)

    rows = []
    for x in root.iter():
        if _local(x.tag) in ("item", "entry"):
            has = texts(x)
            some = lambda *names: next((has[n] for n in names if n in has), None)  # noqa: B023, E731
            rows.append((some("guid", "id"), has.get("link") if kind == "rss" else link(x), has.get("title"), some("pubdate", "published", "date"), some("updated", "modified")))
    head = next((x for x in root if _local(x.tag) == "channel"), root)
    return {"kind": kind, "title": texts(head).get("title"), "entries": _entries(rows)}


def _entries(rows) -> list[tuple]:
    out = []
    for guid, url, title, published, updated in rows:
        if url and str(url).strip():
            canonical = canonical_text(str(url))
            out.append((str(guid).strip() if guid and str(guid).strip() else canonical, str(url).strip(), canonical, str(title)[:MOST_TITLE] if title else None, *(_moment(m) if isinstance(m, str) else None for m in (published, updated))))
    return out


def read_feeds(bodies: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """One row per entry of each feed: ``key``, ``kind``, guid, url, canonical, title, published, updated."""
    names = [key, "kind", "guid", "entry_url", "canonical", "title", "published", "updated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = feed(b)
                out += [(k, f["kind"], *e) for e in f["entries"]]
                if len(out) >= TOGETHER:
                    yield made()
                    out = []
        if out:
            yield made()

    return bodies.select(F.col(key).cast("string").alias("k"), F.col(body).cast("binary").alias("b")).mapInArrow(run, ", ".join(f"{n} string" for n in names))


def read_sitemaps(bodies: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """One row per page or child sitemap: ``key``, ``loc``, ``lastmod``, ``child`` and ``place`` (in its document, pages first)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, b in zip(rows["k"], rows["b"], strict=True):
                s = sitemap(b)
                found = [(k, u, m, False) for u, m in s["pages"]] + [(k, u, None, True) for u in s["children"]]
                out += [(*row, i) for i, row in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "loc", "lastmod", "child", "place"])

    return bodies.select(F.col(key).alias("k"), F.col(body).cast("binary").alias("b")).mapInPandas(run, f"{key} string, loc string, lastmod string, child boolean, place long")
