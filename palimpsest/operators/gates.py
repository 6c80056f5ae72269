"""Pages that stand in front of the page: by address, by overlay, by wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import tables, urls

#: A longer page is an article that happens to use the words.
MOST_BYTES = 24_000


def by_address(url: Column) -> Column:
    """The address has a marker."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(False)
    for m in tables.GATE_MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out


def overlaid(html: Column) -> Column:
    """The page frames a gate and hides its own body: both, whatever its length.

    A frame is one if the address that it shows has a marker; the body is hidden
    by a style rule for all that is in it.
    """
    low = F.lower(html)
    shown = lambda tag: F.regexp_extract(tag, r"\bsrc\s*=\s*[\"']([^\"']*)", 1)
    frames = F.regexp_extract_all(low, F.lit(r"<iframe\b[^>]*"), F.lit(0))
    selector = lambda rule: F.trim(F.regexp_replace(F.substring_index(rule, "{", 1), r"\s+", " "))
    declared = lambda rule: F.regexp_replace(F.substring_index(rule, "{", -1), r"\s+", "")
    rules = F.regexp_extract_all(low, F.lit(r"[^{}<>]*\{[^{}]*"), F.lit(0))
    hides = lambda rule: selector(rule).rlike(r"(^|[ ,>/])body ?\*$") & F.contains(declared(rule), F.lit("visibility:hidden"))
    return F.contains(low, F.lit("visibility")) & F.exists(frames, lambda tag: by_address(shown(tag))) & F.exists(rules, hides)


def verdict(html: Column, url: Column) -> Column:
    """``url``, ``overlay``, ``phrase`` or ``clear``, in that order but that long pages are clear before wording counts."""
    return F.when(by_address(url), "url").when(overlaid(html), "overlay").when(F.octet_length(html) > MOST_BYTES, "clear").when(html.rlike("(?i)" + "|".join(tables.GATE_PHRASES)), "phrase").otherwise("clear")


def judged(html: Column, url: Column, success: Column, gate: Column, must_not: str | None = None) -> Column:
    """As ``verdict``, but what a site's own selectors and pattern say comes first."""
    out = F.when(gate, "selector").when(success, "clear")
    if must_not:
        out = out.when(html.rlike(must_not), "pattern")
    return out.otherwise(verdict(html, url))


def is_asset(url: Column) -> Column:
    """The path ends in an asset's extension."""
    return F.coalesce(F.lower(urls.part(url, "PATH")).rlike(r"\.(" + "|".join(tables.ASSET_ENDINGS) + ")$"), F.lit(False))
