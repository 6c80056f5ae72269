"""The capture index: sorted keys, chunks, withholding and lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import storage

CHUNK = 3000


def usable(patterns: list[str]) -> list[str]:
    """Trimmed distinct patterns that compile, in order."""
    out = []
    for p in dict.fromkeys(x.strip() for x in patterns):
        try:
            re.compile(p)
        except re.error:
            continue
        if p:
            out.append(p)
    return out


def combined(patterns: list[str]) -> str | None:
    """One pattern for all, each in a group of its own; None if none is usable."""
    good = usable(patterns)
    return "|".join(f"(?:{p})" for p in good) if good else None


def without(records: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    """Records whose URL (not its key) matches no pattern."""
    pattern = combined(patterns)
    return records if pattern is None else records.where(~F.coalesce(F.col(url), F.lit("")).rlike(pattern) | (F.coalesce(F.col(url), F.lit("")) == ""))


def bookkeeping(url: str = "url"):
    """Records that an engine keeps for itself."""
    low = F.lower(url)
    return F.startswith(low, F.lit("metadata:")) | F.startswith(low, F.lit("urn:"))


def replayable():
    """A page that can be shown: 2xx and HTML, or no type given."""
    mime = F.coalesce("mime", F.lit(""))
    return F.col("status").between(200, 299) & (F.contains(F.lower(mime), F.lit("html")) | (mime == ""))


def chunks(lines: DataFrame, key: str = "urlkey", then: str = "timestamp", size: int = CHUNK) -> DataFrame:
    """The directory of chunks of ``size`` lines of the sorted index: ``chunk``, first key, lines and a digest.

    The index is sorted by ranges and written once, a file a range.  A line's
    number is its place in its file, after all lines of the files before: no
    partition waits for another's rows and nothing is sorted twice.
    """
    ordered = storage.written(lines.select(key, then).orderBy(key, then), "index")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    placed = ordered.select(key, then, file.alias("file"), F.col("_metadata.row_index").alias("place"))
    # One count a file comes to the driver.
    counts = {r.file: r["count"] for r in placed.groupBy("file").count().collect()}
    before, start = {}, 0
    for f in sorted(counts):
        before[f], start = start, start + counts[f]
    first = F.element_at(F.create_map(*[F.lit(x) for f, n in before.items() for x in (f, n)]), F.col("file")) if before else F.lit(0)
    rows = placed.groupBy(((first + F.col("place")) / size).cast("long").alias("chunk"))
    line = F.concat_ws(" ", key, then)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)
    return rows.agg(F.min(F.struct(key, then)).alias("first"), F.count("*").alias("lines"), digest.alias("digest")).select("chunk", f"first.{key}", f"first.{then}", "lines", "digest")
