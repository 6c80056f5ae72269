"""URL scalars as column expressions; exact forms that need percent-decoding are Arrow functions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.tables import TRACKING

#: Suffixes under which names are registered one label deeper.
DEEP_SUFFIXES = ("ac.uk", "blogspot.com", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "github.io", "gov.uk", "org.au", "org.uk", "wordpress.com")


def part(url: Column, name: str) -> Column:
    """A part as ``parse_url`` gives it; null for what is no URL."""
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-cased host name without user and port, or an empty string."""
    return F.coalesce(F.lower(part(F.trim(url), "HOST")), F.lit(""))


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")


def pairs(url: Column) -> Column:
    """The query as an array of (key, value) in order; blank values stay."""
    items = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    return F.transform(items, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")))


def query_keys(url: Column) -> Column:
    """Sorted distinct non-empty query keys."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(pairs(url), lambda p: p["key"]), lambda k: k != "")))


def canonical(url: Column) -> Column:
    """The form two URLs are compared in, for queries without percent escapes (see ``canonical_exact``).

    Lower-cased scheme and host, no default port, user, fragment, trailing slash
    or tracking parameter, and the query sorted.  What is no URL is only trimmed.
    """
    u = F.trim(url)
    scheme, name = F.lower(part(u, "PROTOCOL")), F.lower(part(u, "HOST"))
    port = F.regexp_extract(F.coalesce(part(u, "AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "") | (port == "0")
    path = F.coalesce(part(u, "PATH"), F.lit(""))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    kept = F.filter(pairs(u), lambda p: ~(F.lower(p["key"]).isin(*TRACKING) | F.startswith(F.lower(p["key"]), F.lit("utm_"))))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    out = F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isNotNull() & name.isNotNull(), out).otherwise(u)


#: An address that has nothing to be changed but slashes at its end: what most are.
_PLAIN = re.compile(r"(https?://[a-z0-9][a-z0-9.-]*)((?:/[A-Za-z0-9_.~%+-]*)*)", re.ASCII)


def canonical_text(url: str | None) -> str | None:
    """``canonical`` with percent escapes decoded and encoded again."""
    if url is None:
        return None
    url = url.strip()
    if plain := _PLAIN.fullmatch(url):
        return plain[1] + (plain[2].rstrip("/") if len(plain[2]) > 1 else plain[2])
    try:
        p = urlsplit(url)
        port = p.port
    except ValueError:
        return url
    scheme, name = p.scheme.lower(), (p.hostname or "").lower()
    if not (scheme and name):
        return url
    if port and (scheme, port) not in (("http", 80), ("https", 443)):
        name += f":{port}"
    path = p.path.rstrip("/") if len(p.path) > 1 else p.path
    query = sorted(x for x in parse_qsl(p.query, keep_blank_values=True) if not (x[0].lower() in TRACKING or x[0].lower().startswith("utm_")))
    return urlunsplit((scheme, name, path, urlencode(query), ""))


@F.pandas_udf(T.StringType())
def canonical_exact(url: pd.Series) -> pd.Series:
    """``canonical_text`` of a column."""
    return url.map(canonical_text)


def numberish(segment: Column) -> Column:
    """All digits, or six in ten of the characters at least."""
    digits = F.length(F.regexp_replace(segment, "[^0-9]", ""))
    return (F.length(segment) > 0) & (digits >= F.length(segment) * F.lit(0.6))


def extension(segment: Column) -> Column:
    """Lower-cased 1 to 5 letters or digits after the last dot, or an empty string."""
    return F.lower(F.regexp_extract(segment, r"\.([A-Za-z0-9]{1,5})$", 1))


def surt(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, without www, then path and sorted query, all lower-cased."""
    u = F.lower(F.trim(url))
    labels = F.reverse(F.split(F.regexp_replace(host(u), r"^www\d*\.", ""), r"\."))
    port = F.regexp_extract(F.coalesce(part(u, "AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    default = port.isin("", "80", "443")
    path = F.coalesce(part(u, "PATH"), F.lit(""))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).when(path == "", "/").otherwise(path)
    query = F.array_join(F.array_sort(F.filter(F.split(F.coalesce(part(u, "QUERY"), F.lit("")), "&"), lambda p: p != "")), "&")
    return F.concat(F.array_join(labels, ","), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.lit(")"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def registrable(name: Column) -> Column:
    """The registered domain: two labels, or three under a suffix of ``DEEP_SUFFIXES``."""
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - F.lit(n - 1), F.lit(1)), F.lit(n)), ".")
    return F.when(last(2).isin(*DEEP_SUFFIXES), last(3)).otherwise(last(2))


def suffixes(name: Column) -> Column:
    """The name and every domain above it: makes "is under" an equality."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under(name: Column, pattern: str) -> Column:
    """``*.x`` matches x and all below; other patterns match themselves."""
    if pattern.startswith("*."):
        return (name == pattern[2:]) | F.endswith(name, F.lit(pattern[1:]))
    return name == pattern


def visited_key(url: Column) -> Column:
    """Lower-cased scheme and authority, path without its trailing slash."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), path)


def absolute(base: str, value: str | None) -> str | None:
    """``value`` as an http(s) URL without fragment, seen from ``base``; None for anything else."""
    value = (value or "").strip()
    if not value or value.lower().startswith(("data:", "javascript:", "mailto:", "tel:", "about:", "blob:", "#")):
        return None
    try:
        out = urljoin(base, value)
    except ValueError:
        return None
    return out.partition("#")[0] if out.startswith(("http://", "https://")) else None
