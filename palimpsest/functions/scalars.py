"""Text, time and number scalars as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import tables


def tidy(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(collapse(text))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def words(text: Column) -> Column:
    """Number of words; blank text has none."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def cdx_timestamp(iso: Column) -> Column:
    """The 14 digits of an ISO time."""
    return F.substring(F.regexp_replace(iso, "[^0-9]", ""), 1, 14)


def iso_of_cdx(digits: Column) -> Column:
    """ISO time of up to 14 digits, padded with zeros."""
    p = F.rpad(digits, 14, "0")
    s = lambda a, n: F.substring(p, a, n)
    return F.concat(s(1, 4), F.lit("-"), s(5, 2), F.lit("-"), s(7, 2), F.lit("T"), s(9, 2), F.lit(":"), s(11, 2), F.lit(":"), s(13, 2), F.lit("Z"))


def _ascii_slug(value: Column, fallback: str) -> Column:
    """``slug_text`` of plain words, in the JVM."""
    words = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.concat_ws("-", words), F.lit("")), F.lit(fallback))


def capture_dir(started: Column, kind: Column, engine: Column) -> Column:
    """Directory name of a capture: time, kind, and the engine's name up to its first hyphen."""
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), _ascii_slug(kind, "run"), _ascii_slug(F.split_part(engine, F.lit("-"), F.lit(1)), "engine"))


def iso_micros(moment: Column) -> Column:
    """ISO time with six decimals; sorts as text."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def number_text(value: Column) -> Column:
    """Whole values without decimals."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def backoff_minutes(interval: Column, failures: Column, least: int = 5, most: int = 1440) -> Column:
    """Minutes to the next poll: doubled by each failure in a row, at most a day (before jitter of a tenth)."""
    base = F.greatest(interval, F.lit(least))
    return F.when(failures > 0, F.least(base * F.pow(F.lit(2), F.least(failures, F.lit(30))), F.lit(most))).otherwise(base).cast("long")


def retry_minutes(failures: Column, first: int = 10, most: int = 1440) -> Column:
    """Minutes until a failed capture may be tried again."""
    return F.least(F.lit(first) * F.pow(F.lit(2), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30))), F.lit(most)).cast("long")


def lockout_seconds(failures: Column, allowed: int = 5, most: int = 3600) -> Column:
    """Seconds of lock-out after too many failures: a minute, doubled by each more."""
    over = failures - allowed
    return F.when(over < 0, 0).otherwise(F.least(60 * F.pow(F.lit(2), F.least(over, F.lit(20))), F.lit(most))).cast("long")


def quiet(minute: Column, start: int, end: int) -> Column:
    """Minute of the day inside a window that may go past midnight; an empty window never is."""
    if start == end:
        return F.lit(False)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def elapsed(now: Column, last: Column, days: int) -> Column:
    """``days`` have passed since ``last``; true where there is no last."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= F.lit(days * 86_400_000_000), F.lit(True))


def slug_text(value: str | None, fallback: str = "site") -> str:
    """ASCII letters and digits in runs joined by hyphens, 64 characters at most; a device's name gets an ending."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()
    name = "-".join(re.findall("[a-z0-9]+", plain.lower()))[:64].strip("-")
    return f"{name}-x" if name in tables.RESERVED_NAMES else name or fallback


@F.pandas_udf(T.StringType())
def slug(value: pd.Series) -> pd.Series:
    """``slug_text`` of a column."""
    return value.map(slug_text)


def unique_slug(base: str, order: str) -> Column:
    """First come, first served: the second of a name gets -2, and so on."""
    n = F.expr(f"row_number() OVER (PARTITION BY {base} ORDER BY {order})")
    return F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string")))


def capture_of(filename: Column) -> Column:
    """The capture's directory of a path below captures/, else an empty string."""
    parts = F.split(filename, "/")
    return F.when((F.size(parts) > 2) & (F.get(parts, 0) == "captures"), F.get(parts, 1)).otherwise("")
