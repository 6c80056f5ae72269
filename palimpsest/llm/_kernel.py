"""Vectorised text kernels: words, hashes and shingles of many texts at once.

All functions work on the UTF-8 bytes of a run of texts that lie one after the
other, as Arrow stores them.  Words are ``[^\\x20\\x09-\\x0D]+``; those separators
are single bytes in UTF-8, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes (a longer text is taken alone).
STEP_BYTES = 1 << 19
#: From here on a text is cut into segments, so that what is made of its bytes stays small.
LONG = 1 << 21

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


class _Cache(dict):
    """Tables made once in each process; an empty one travels to executors."""

    def __reduce__(self):
        return (_Cache, ())


_tables = _Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in [0, n]."""
    have = _tables.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, STEP_BYTES + 4096)
        made = []
        for b in (BASE, BASE_INVERSE):
            steps = np.full(size, b, dtype=U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        have = _tables["powers"] = tuple(made)
    return have


def lookup(kind: str) -> np.ndarray:
    """Byte tables: ``space``, ``lower`` (A-Z to a-z), ``symbol``, ``head`` (first byte of a code point)."""
    if kind not in _tables:
        t = np.arange(256, dtype=np.uint8)
        if kind == "space":
            t = (t == 0x20) | ((t >= 0x09) & (t <= 0x0D))
        elif kind == "lower":
            t = np.where((t >= 65) & (t <= 90), t + 32, t).astype(np.uint8)
        elif kind == "symbol":
            t = np.isin(t, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
        elif kind == "head":
            t = (t & 0xC0) != 0x80
        _tables[kind] = t
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def is_long(raw: np.ndarray, offsets: np.ndarray) -> bool:
    """A step that is one text of more than a few steps' bytes: it is to be looked at in ``segments``."""
    return len(offsets) == 2 and len(raw) > LONG


def segments(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of a long text, of about ``STEP_BYTES``; each but the first begins with a separator, so that no word is in two."""
    space, at = lookup("space"), 0
    while at < len(raw):
        end = at + STEP_BYTES
        while end < len(raw):
            found = np.flatnonzero(space[raw[end : end + STEP_BYTES]])
            if len(found):
                end += int(found[0])
                break
            end += STEP_BYTES
        end = min(end, len(raw))
        yield at, end
        at = end


class Words:
    """The words of a run of texts: ``start`` and ``end`` (bytes), ``doc`` and ``first`` (words before each text)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        solid = ~lookup("space")[raw]
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = solid[:-1]
        begins = offsets[:-1][offsets[:-1] < len(raw)]
        before[begins] = False
        self.solid = solid
        self.start = np.flatnonzero(solid & ~before)
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = solid[1:]
        ends = offsets[1:] - 1
        after[ends[ends >= 0]] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def sums(self, lower: bool) -> np.ndarray:
        """Running polynomial sums over the bytes."""
        power, _ = powers(len(self.raw) + 1)
        value = (lookup("lower")[self.raw] if lower else self.raw).astype(U64)
        value += U64(1)
        value *= power[: len(value)]
        out = np.zeros(len(value) + 1, dtype=U64)
        np.cumsum(value, out=out[1:])
        return out

    def hashes(self, lower: bool, prefix: int | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        if sums is None:
            sums = self.sums(lower)
        _, back = powers(len(self.raw) + 1)
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return mix((sums[end] - sums[self.start]) * back[self.start] + (end - self.start).astype(U64))


#: Odd multipliers for the places of a word in a shingle.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of every text and the place of each text's first one.

    A text with fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    h = words.hashes(lower=True)
    n = len(h)
    place = np.array([pow(int(PLACES[0]), j + 1, 1 << 64) for j in range(size)], dtype=U64)
    count = np.where(words.count >= size, words.count - size + 1, (words.count > 0).astype(np.int64))
    bounds = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=bounds[1:])
    out = np.zeros(bounds[-1], dtype=U64)
    if n >= size:
        full = np.zeros(n - size + 1, dtype=U64)
        for j in range(size):
            full += h[j : n - size + 1 + j] * place[j]
        same = words.doc[: n - size + 1] == words.doc[size - 1 :]
        at = np.flatnonzero(same)
        out[bounds[words.doc[at]] + at - words.first[words.doc[at]]] = full[at]
    for d in np.flatnonzero((words.count > 0) & (words.count < size)):
        part = h[words.first[d] : words.first[d + 1]]
        out[bounds[d]] = (part * place[: len(part)]).sum(dtype=U64) + U64(len(part))
    return mix(out), bounds


def long_hashes(raw: np.ndarray, lower: bool) -> np.ndarray:
    """``Words.hashes`` of one long text."""
    return np.concatenate([np.zeros(0, U64), *(Words(raw[a:b], np.array([0, b - a])).hashes(lower) for a, b in segments(raw))])


def _long_shingle_set(raw: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes of one long text, a part of its words at a time."""
    h = long_hashes(raw, lower=True)
    place = np.array([pow(int(PLACES[0]), j + 1, 1 << 64) for j in range(size)], dtype=U64)
    if len(h) < size:
        return mix((h * place[: len(h)]).sum(keepdims=True, dtype=U64) + U64(len(h))) if len(h) else h
    found = []
    for lo in range(0, len(h) - size + 1, STEP_BYTES):
        hi = min(lo + STEP_BYTES, len(h) - size + 1)
        part = np.zeros(hi - lo, dtype=U64)
        for j in range(size):
            part += h[lo + j : hi + j] * place[j]
        found.append(np.unique(mix(part)))
    return np.unique(np.concatenate(found))


def shingle_sets(column, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of an Arrow column."""
    for lo, hi, raw, offsets in steps(column):
        if is_long(raw, offsets):
            yield lo, _long_shingle_set(raw, size)
            continue
        h, bounds = shingles(Words(raw, offsets), size)
        for d in range(hi - lo):
            yield lo + d, np.unique(h[bounds[d] : bounds[d + 1]])
