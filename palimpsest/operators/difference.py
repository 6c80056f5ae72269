"""Block and word differences between two versions of a text."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import storage

MOST_WORD_CHARS = 20_000
CHANGE = "struct<kind: string, before: string, after: string, words: array<struct<op: string, before: string, after: string>>>"


def gaps(before: list[str], after: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """What lies on either side between the runs that two lists have in common."""
    at = to = 0
    for run in SequenceMatcher(None, before, after, False).get_matching_blocks():
        if at < run.a or to < run.b:
            yield before[at : run.a], after[to : run.b]
        at, to = run.a + run.size, run.b + run.size


def _edit(x: list[str], y: list[str]) -> dict:
    return {"op": "replace" if x and y else "delete" if x else "insert", "before": " ".join(x), "after": " ".join(y)}


def changes(before: list[str], after: list[str], most_word_chars: int | None = MOST_WORD_CHARS) -> tuple[list[dict], float]:
    """Changed blocks in order and the share that changed; blocks replaced in one place are paired by position.

    Pairs say which words changed, unless one of them has more than ``most_word_chars`` (None: always).
    """
    out, gone = [], 0
    for left, right in gaps(before, after):
        gone += len(left)
        for x, y in zip_longest(left, right, fillvalue=""):
            kind = "changed" if x and y else "removed" if x else "added"
            words = [_edit(*g) for g in gaps(x.split(), y.split())] if kind == "changed" and (most_word_chars is None or max(len(x), len(y)) <= most_word_chars) else []
            out.append({"kind": kind, "before": x, "after": y, "words": words})
    longest = max(len(before), len(after))
    return out, (longest - len(before) + gone) / longest if longest else 1.0


def block_changes(rows: DataFrame, key: str = "id", before: str = "before", after: str = "after", most_word_chars: int | None = MOST_WORD_CHARS) -> DataFrame:
    """``key``, ``changes`` and ``ratio`` of two arrays of blocks per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [changes(list(x) if x is not None else [], list(y) if y is not None else [], most_word_chars) for x, y in zip(part["x"], part["y"], strict=True)]
            yield pd.DataFrame({key: part["k"], "changes": [m[0] for m in made], "ratio": [m[1] for m in made]})

    storage.small_batches(rows.sparkSession)
    return rows.select(F.col(key).alias("k"), F.col(before).alias("x"), F.col(after).alias("y")).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, changes array<{CHANGE}>, ratio double")
