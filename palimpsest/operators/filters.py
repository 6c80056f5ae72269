"""Catalogue filters: a declarative filter that becomes chained DataFrame conditions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("title", "status", "size_bytes", "url_count", "last_capture_at", "created_at")
MOST_TAGS = 20


def contains(column: Column, text: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` are ordinary characters."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def in_subtree(path: Column, root: str) -> Column:
    """A folder's path is ``root`` or lies below it."""
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def having_tags(rows: DataFrame, site_tags: DataFrame, slugs: list[str], mode: str = "any", key: str = "id") -> DataFrame:
    """Rows with any of the tags, or with all of them (relational division by one aggregation)."""
    slugs = list(dict.fromkeys(slugs))[:MOST_TAGS]
    held = site_tags.where(F.col("slug").isin(slugs))
    if mode == "all":
        held = held.groupBy("site_id").agg(F.countDistinct("slug").alias("n")).where(F.col("n") == len(slugs))
    return rows.join(held.select(F.col("site_id").alias(key)).distinct(), key, "left_semi")


@dataclass(frozen=True)
class SiteFilter:
    """Conditions that must all hold; None means no condition."""

    folder: str | None = None
    tags: tuple[str, ...] = ()
    tag_mode: str = "any"
    status: str | None = None
    q: str | None = None
    never_captured: bool | None = None
    has_errors: bool | None = None
    captured_from: str | None = None
    captured_to: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    sort: str = "title"
    descending: bool = False

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ValueError(f"unknown sort {self.sort!r}")
        if self.tag_mode not in ("any", "all"):
            raise ValueError(f"unknown tag mode {self.tag_mode!r}")

    @classmethod
    def from_params(cls, params: dict) -> SiteFilter:
        """From text parameters; "true" and "false" are tri-state with absence, empty values are absent."""
        flags = {"never_captured", "has_errors", "descending"}
        got = {}
        for f in fields(cls):
            value = params.get(f.name)
            if value is None or value == "":
                continue
            if f.name in flags:
                value = str(value).lower() in ("1", "true", "yes")
            elif f.name in ("min_size", "max_size"):
                value = int(value)
            elif f.name == "tags":
                value = tuple(value.split(",")) if isinstance(value, str) else tuple(value)
            got[f.name] = value
        return cls(**got)

    def to_dict(self) -> dict:
        """Only what differs from the defaults; ``from_params`` reads it back."""
        plain = SiteFilter()
        return {k: (list(v) if isinstance(v, tuple) else v) for k, v in asdict(self).items() if v != getattr(plain, k)}

    def apply(self, sites: DataFrame, folders: DataFrame | None = None, site_tags: DataFrame | None = None, captures: DataFrame | None = None, capture_urls: DataFrame | None = None) -> DataFrame:
        """``sites`` that meet every condition; soft-deleted ones never do."""
        out = sites.where(~F.col("deleted"))
        if self.status is not None:
            out = out.where(F.col("status") == self.status)
        if self.q:
            out = out.where(contains(F.col("title"), self.q) | contains(F.col("status"), self.q))
        if self.min_size is not None:
            out = out.where(F.col("size_bytes") >= self.min_size)
        if self.max_size is not None:
            out = out.where(F.col("size_bytes") <= self.max_size)
        if self.folder is not None:
            below = folders.where(in_subtree(F.col("path"), self.folder)).select(F.col("id").alias("folder_id"))
            out = out.join(below, "folder_id", "left_semi")
        if self.tags:
            out = having_tags(out, site_tags, list(self.tags), self.tag_mode)
        if self.never_captured is not None:
            how = "left_anti" if self.never_captured else "left_semi"
            out = out.join(captures.select(F.col("site_id").alias("id")).distinct(), "id", how)
        if self.captured_from or self.captured_to:
            last = captures.groupBy("site_id").agg(F.max("started_at").alias("last"))
            if self.captured_from:
                last = last.where(F.col("last") >= F.lit(self.captured_from).cast("timestamp_ntz"))
            if self.captured_to:
                last = last.where(F.col("last") <= F.lit(self.captured_to).cast("timestamp_ntz"))
            out = out.join(last.select(F.col("site_id").alias("id")), "id", "left_semi")
        if self.has_errors is not None:
            failing = capture_urls.where(F.col("error").isNotNull()).select(F.col("capture_id").alias("c")).distinct()
            bad = captures.join(failing, F.col("id") == F.col("c"), "left_semi").select(F.col("site_id").alias("id")).distinct()
            out = out.join(bad, "id", "left_semi" if self.has_errors else "left_anti")
        return out

    def ordered(self, rows: DataFrame) -> DataFrame:
        """By the sort column and then id; nulls count as smallest."""
        column = F.col(self.sort)
        return rows.orderBy(column.desc_nulls_last() if self.descending else column.asc_nulls_first(), "id")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one page (from 1) of an ordered DataFrame, with the total of all pages' rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
