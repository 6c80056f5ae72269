"""Runs of words that repeat with a period, found on the harmonic grid.

A run is a stretch of words with smallest period q, of ``max(LEAST_WORDS,
LEAST_POWER * q)`` words or more, that no neighbouring word extends.  A run of
period p covers two or more neighbouring multiples of p, so it is enough to look
at the places jp and (j+1)p of every text for every p, n/1 + n/2 + ... pairs of
places: how far the words from both agree going on (the longest common extension
forward) and going back says where the run around them begins and ends.

Extensions come from a suffix array: words are numbered, suffixes sorted by
prefix doubling with the length of the common prefix of neighbours, and an
extension is the least of those between two suffixes (range minimum query).  The
words in reverse give the extensions backward.  Multiples of a period find the
same stretch again; the smallest period of a stretch counts.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared as they are.  A text is one
piece of work, so texts need no shuffle; several short ones share one array, in
which words of different texts are never the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import small_batches

LEAST_WORDS, LEAST_POWER = 6, 4
#: Texts share an array until it has so many words, and so many pairs of places are looked at together.
STEP_WORDS, STEP_PAIRS = 1 << 16, 1 << 18

_BLOCK = 16
_FAR = np.int64(1) << 60

SCHEMA = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


class RangeMinimum:
    """Least value of any stretch: running minima in blocks of 16, and a table of powers of two over the blocks."""

    def __init__(self, values: np.ndarray):
        padded = np.full(-(-max(len(values), 1) // _BLOCK) * _BLOCK, _FAR)
        padded[: len(values)] = values
        self.values = padded
        columns = np.ascontiguousarray(padded.reshape(-1, _BLOCK).T)
        self.ahead, self.behind = columns.copy(), columns.copy()
        for t in range(1, _BLOCK):
            np.minimum(self.ahead[t], self.ahead[t - 1], out=self.ahead[t])
            np.minimum(self.behind[_BLOCK - 1 - t], self.behind[_BLOCK - t], out=self.behind[_BLOCK - 1 - t])
        self.levels = [self.ahead[-1]]
        while 2 << (len(self.levels) - 1) <= len(self.levels[0]):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value at ``low`` to ``high``, both included (low <= high)."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.behind[low % _BLOCK, first], self.ahead[high % _BLOCK, last])
        inside = np.flatnonzero(first == last)
        if len(inside):
            at = low[inside, None] + np.arange(_BLOCK)
            at = np.minimum(at, high[inside, None])
            out[inside] = self.values[at].min(axis=1)
        between = last - first - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k in np.unique(level[between > 0]):
            some = np.flatnonzero((between > 0) & (level == k))
            table = self.levels[k]
            out[some] = np.minimum(out[some], np.minimum(table[first[some] + 1], table[last[some] - (1 << int(k))]))
        return out


class SuffixArray:
    """Suffixes of several word sequences in order: ``rank`` of each place, and common prefixes of neighbours.

    ``words`` are numbers, different ones in different sequences; ``end`` is the
    end of each place's sequence, which no comparison passes.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = words[order[1:]] != words[order[:-1]]
        common = np.full(n, _FAR)
        common[fresh] = 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        k = 1
        while True:
            alone = fresh & np.append(fresh[1:], True)
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            here = order[at]
            after = here + k
            inside = after < end[here]
            then = np.full(len(at), -1, dtype=np.int64)
            then[inside] = rank[after[inside]]
            by = np.argsort(rank[here] * (n + 1) + then + 1, kind="stable")
            here, then = here[by], then[by]
            order[at] = here
            old = fresh[at]
            split = np.zeros(len(at), dtype=bool)
            split[1:] = ~old[1:] & (then[1:] != then[:-1])
            new = np.flatnonzero(split)
            low, high = then[new - 1], then[new]
            more = np.zeros(len(new), dtype=np.int64)
            both = np.flatnonzero(low >= 0)
            if len(both):
                more[both] = RangeMinimum(common).least(low[both] + 1, high[both])
            common[at[new]] = k + more
            fresh[at[new]] = True
            rank[here] = np.maximum.accumulate(np.where(fresh[at], at, 0))
            k *= 2
        self.rank, self.least = rank, RangeMinimum(common).least

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on (different places of one sequence) are the same."""
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid: jp and the place p later, for all sequences, some at a time."""
    most = np.where(count >= LEAST_WORDS, count // LEAST_POWER, 0)
    before = np.cumsum(most) - most
    for lo in range(0, int(most.sum()), STEP_PAIRS):
        row = np.arange(lo, min(lo + STEP_PAIRS, int(most.sum())))
        of = np.searchsorted(before, row, side="right") - 1
        period = row - before[of] + 1
        places = (count[of] - 1) // period
        total = np.cumsum(places)
        at = 0
        while at < len(row):
            past = total[at] - places[at]
            to = max(at + 1, int(np.searchsorted(total, past + STEP_PAIRS, side="right")))
            which = np.repeat(np.arange(at, to), places[at:to])
            j = np.arange(total[to - 1] - past) - (total[which] - places[which] - past)
            yield first[of[which]] + j * period[which], period[which]
            at = to


def runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all runs, by sequence, start and period.

    Sequences are words numbered from 0, each sequence for itself.
    """
    count = np.array([len(s) for s in sequences], dtype=np.int64)
    first = np.cumsum(count) - count
    n = int(count.sum())
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none, none
    kinds = np.array([int(s.max()) + 1 if len(s) else 0 for s in sequences], dtype=np.int64)
    words = np.concatenate(sequences) + np.repeat(np.cumsum(kinds) - kinds, count)
    begin, end = np.repeat(first, count), np.repeat(first + count, count)
    ahead = back = None
    found = []
    for place, period in _pairs(first, count):
        same = words[place] == words[place + period]
        place, period = place[same], period[same]
        if not len(place):
            continue
        if ahead is None:
            ahead, back = SuffixArray(words, end), SuffixArray(words[::-1], n - begin[::-1])
        forward = ahead.extension(place, place + period)
        # of a run's places, the first one on the grid has more than twice the period before it
        enough = forward > 2 * period
        place, period, forward = place[enough], period[enough], forward[enough]
        backward = np.zeros(len(place), dtype=np.int64)
        inner = np.flatnonzero((place > begin[place]) & (words[place - 1] == words[place + period - 1]))
        if len(inner):
            backward[inner] = back.extension(n - place[inner], n - place[inner] - period[inner])
        length = backward + period + forward
        enough = length >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
        found.append(_smallest(np.stack([place - backward, length, period])[:, enough]))
    if not found:
        return none, none, none, none
    start, length, period = _smallest(np.concatenate(found, axis=1))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = np.searchsorted(first, start, side="right") - 1
    return of, start - first[of], length, period


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of equal stretches, the one with the smallest period."""
    found = found[:, np.lexsort(found[::-1])]
    new = np.ones(found.shape[1], dtype=bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    return found[:, new]


def _highest(of_text: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length by period, compared exactly; of ties the first, then that of the smaller period."""
    return min(of_text, key=cmp_to_key(lambda a, b: (b[1] * a[2] - a[1] * b[2]) or (a[0] - b[0]) or (a[2] - b[2])))


def _rows(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
    """A row of ``SCHEMA`` for each text, given as words."""
    sequences = []
    for words in texts:
        number: dict[bytes, int] = {}
        sequences.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
    of, start, length, period = runs(sequences)
    bound = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, (id_, words) in enumerate(zip(ids, texts, strict=True)):
        lo, hi = bound[i], bound[i + 1]
        here = list(zip(start[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
        kept, best = words, (None, None, None)
        if here:
            best = _highest(here)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, start[lo:hi] + period[lo:hi], 1)
            np.add.at(change, start[lo:hi] + length[lo:hi], -1)
            kept = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in here).encode()).hexdigest()
        power = 1000 * best[1] // best[2] if here else None
        yield id_, len(here), *best, power, listed, hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept)


def _found(edit: Callable[[int | None, list[bytes]], list[bytes]] | None):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list) -> pa.RecordBatch:
            columns = zip(*_rows(ids, texts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            known = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in _kernel.steps(batch.column(1)):
                for d in range(hi - lo):
                    words = raw[offsets[d] : offsets[d + 1]].tobytes().split()
                    if edit:
                        words = edit(known[lo + d], words)
                    if size and size + len(words) > STEP_WORDS:
                        yield out(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(known[lo + d])
                    texts.append(words)
                    size += len(words)
            if ids:
                yield out(ids, texts)

    return run


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable | None = None) -> DataFrame:
    """The runs of each text, summed up, and what is left without their repetitions: columns ``SCHEMA``.

    ``start`` (word number), ``length``, ``period`` and ``exponent_milli`` are
    those of the run with the greatest length by period (ties: first, then smaller period),
    null without a run.  ``runs_sha256`` is over all runs, a line
    ``start,length,period`` each; ``collapsed_sha256`` over the words that no run
    has after its first period, joined by spaces; ``n_kept`` is their number.
    ``edit`` changes the words of a text before: (id, words) to words.

    Null and empty texts have no words and no runs (hashes of nothing).  Every
    row counts for itself, so repeated rows and ids give a row each, null ids
    too.  Other columns are not looked at.  Empty tables give no rows.  A text of
    any length is searched as a whole by one task, with memory in proportion to it.
    """
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_found(edit), SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a run planted at the end where h = crc32(doc_id as decimal text) ends in 0: from word a = g mod n on, with
    g = h div 10, the p = 1 + (n - a) div (3 + g mod 8) words there repeat.  A row without an id stays as it is."""
    if doc_id is None or not words:
        return words
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op13(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, with those planted by its id."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=planted).withColumnRenamed("id", "doc_id")
