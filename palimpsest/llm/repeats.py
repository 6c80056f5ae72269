"""Byte strings of ``MIN_LENGTH`` or more that occur twice: a suffix array over anchored contexts.

A suffix array of the whole corpus would be one unbounded sort.  Anchors cut it
into parts without losing a repeat: every ``MIN_LENGTH``-byte window picks its
smallest ``GRAM``-byte gram by hash (of equal ones the leftmost), a choice that
depends on the window's bytes alone.  So equal windows pick equal grams, every
window belongs to one anchor, and all places of a repeat lie with the anchor of
its first window.

1. Each anchor has a context: the windows that picked it, and what follows the
   gram up to ``MIN_LENGTH`` bytes from its start; equal grams close to each other
   share one.  Anchors are counted over the whole corpus; an anchor that occurs
   once, with one gram, has no repeat.
2. Equal contexts are one class with many members.  The classes of an anchor,
   each once, make an enhanced suffix array: suffixes in the order of their
   bytes, with common-prefix lengths.  A stack scan lists the intervals of its
   common-prefix tree, leaves of classes with several members included; those
   whose left neighbours differ are the maximal repeats.
3. Classes are expanded to their members, so that a repeat has all its places.
4. An anchor with more than ``most`` suffixes would be too much for one task.
   The upper part of its tree is made by aggregates instead: the least and the
   greatest suffix of a node give the node's length, and its suffixes are split
   by the byte that follows, until a node is small enough for a task.  The tree
   is the same wherever the line is drawn.

Matches never cross texts.  Lengths and places are in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import keep, keep_dealt, rows_with_id, settled, unused

MIN_LENGTH, GRAM = 200, 32
#: Suffixes of one anchor, or of one node of its tree, that a single task sorts.
MOST_SUFFIXES = 1 << 18
#: Bytes of contexts that are taken together, but for a single anchor's.
CHUNK = 1 << 19
#: Suffixes that are sorted at a time.
SUFFIXES = 1 << 18
#: Bytes of one text that are looked at together.
SEGMENT = 1 << 19

_U = np.uint64
_FOUND = "group string, h long, c long, off long, length long"


def _running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, back = _kernel.powers(len(raw) + 1)
    value = raw.astype(_U)
    value += _U(1)
    value *= power[: len(value)]
    sums = np.zeros(len(value) + 1, dtype=_U)
    np.cumsum(value, out=sums[1:])
    return sums, back


def contexts(raw: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The contexts of a run of texts: ``doc``, first byte ``s`` and end ``e`` (in ``raw``), ``w`` windows, anchor ``h``, class ``c``, unclipped end ``full``, ``again`` if it has several grams."""
    n, sizes = len(raw) - gram + 1, np.diff(offsets)
    big = sizes >= min_length
    if not big.any():
        return {k: np.zeros(0, _U if k in "hc" else bool if k == "again" else np.int64) for k in ("doc", "s", "e", "w", "h", "c", "full", "again")}
    sums, back = _running(raw)
    hashes = _kernel.mix((sums[gram:] - sums[:-gram]) * back[:n])
    low = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    width, reach = min_length - gram + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    change = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(change, offsets[:-1][big], 1)
    np.add.at(change, offsets[1:][big] - min_length + 1, -1)
    window = np.flatnonzero(np.cumsum(change[: len(low)]) > 0)
    pick = (low[window] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    place, first, last = pick[new], window[new], window[np.r_[new[1:], len(window)] - 1]
    doc = np.searchsorted(offsets, first, side="right") - 1
    opens = _opens(place, hashes[place], doc, width)
    closes = np.r_[opens[1:], len(place)] - 1
    s, w, full = first[opens], last[closes] - first[opens] + 1, place[closes] + min_length
    e = np.minimum(full, offsets[doc[opens] + 1])
    c = _kernel.mix((sums[e] - sums[s]) * back[s] + _kernel.mix((w * 65536 + e - s).astype(_U)))
    return {"doc": doc[opens], "s": s, "e": e, "w": w, "h": hashes[place[opens]], "c": c, "full": full, "again": closes > opens}


def _opens(place: np.ndarray, hashes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Where contexts begin among the picked grams: equal ones close to each other share one."""
    opens = np.ones(len(place), dtype=bool)
    equal = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    for run in np.split(equal, np.flatnonzero(np.diff(equal) > 1) + 1) if len(equal) else []:
        lo, hi = run[0], run[-1] + 2
        opens[lo:hi] = False
        while lo < hi:
            opens[lo] = True
            lo += int(np.searchsorted(place[lo:hi], place[lo] + width))
    return np.flatnonzero(opens)


def _of_long_text(raw: np.ndarray, min_length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """``contexts`` of one text, a segment at a time; a context cut by a segment's end is left to the next one."""
    at = 0
    while True:
        part = raw[at : at + SEGMENT]
        found = contexts(part, np.array([0, len(part)]), min_length, gram)
        final = at + len(part) == len(raw)
        n = len(found["s"])
        if not final:
            n = min(n - 1, int(np.argmax(np.r_[found["full"] > len(part), True])))
        yield {k: v[:n] + at if k in ("s", "e") else v[:n] for k, v in found.items()}
        if final:
            return
        at += int(found["s"][n])


def _list_contexts(min_length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for lo, hi, raw, offsets in _kernel.steps(batch.column(1)):
                long = hi - lo == 1 and len(raw) > SEGMENT
                for x in _of_long_text(raw, min_length, gram) if long else [contexts(raw, offsets, min_length, gram)]:
                    s, e = x["s"] - offsets[x["doc"]], x["e"] - offsets[x["doc"]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x["h"].view(np.int64)), pa.array(x["c"].view(np.int64)), pa.array(rid[lo:hi][x["doc"]]), pa.array(s), pa.array((e - s).astype(np.int32)), pa.array(x["w"].astype(np.int32)), pa.array(x["again"])], names=["h", "c", "rid", "s", "size", "w", "again"]
                    )

    return run


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context of each text."""
    for batch in batches:
        texts, wanted = batch.column(0).cast(pa.large_binary()), batch.column(1)
        for i in range(batch.num_rows):
            raw, asked = texts[i].as_py(), wanted[i].values
            s = asked.field("s").to_numpy()
            body = [raw[x : x + y] for x, y in zip(s, asked.field("size").to_numpy(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(asked.field(x) for x in ("h", "c", "n", "w")), pa.array(body, pa.binary())], names=["h", "c", "n", "w", "body"])


def suffix_intervals(raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, left: np.ndarray, several: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Left-diverse intervals (bytes in common, suffixes) of the common-prefix tree of the suffixes of each ``key``.

    A suffix is ``raw[start:end]``; suffixes of different keys have nothing in
    common.  ``left``: its left neighbour (a number that no other suffix has
    where it differs from all).  ``several``: the suffix stands for occurrences
    whose left neighbours differ, so that it is an interval by itself.
    """
    order = np.argsort(key, kind="stable")
    by_key = key[order]
    new = np.flatnonzero(np.r_[True, by_key[1:] != by_key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(key)])
    lone = order[new[size == 1]]
    for i in lone[several[lone]]:
        yield int(end[i] - start[i]), np.array([i])
    if not (size > 1).any():
        return
    neighbour = left[order]
    # A run of equal keys after one and the same byte is not left-diverse, nor is any interval in it.
    diverse = (size > 1) & ((np.maximum.reduceat(neighbour, new) != np.minimum.reduceat(neighbour, new)) | np.logical_or.reduceat(several[order], new))
    for run in np.flatnonzero(diverse):
        here = order[new[run] : new[run] + size[run]]
        tails = [raw[start[i] : end[i]].tobytes() for i in here]
        rank = sorted(range(len(here)), key=tails.__getitem__)
        lcp = [-1, *(_common(tails[a], tails[b]) for a, b in zip(rank, rank[1:])), -1]
        here = here[rank]
        lefts, alone = left[here].tolist(), several[here]
        changed = [0] * len(here)  # the last place up to here where the left neighbour changes
        for i in range(1, len(here)):
            changed[i] = i if lefts[i] != lefts[i - 1] else changed[i - 1]
        stack: list[tuple[int, int]] = []  # (bytes in common, left bound) of the open intervals
        for i in range(1, len(here) + 1):
            if alone[i - 1] and len(tails[rank[i - 1]]) > max(lcp[i - 1], lcp[i]):
                yield len(tails[rank[i - 1]]), here[i - 1 : i]
            bound = i - 1
            while stack and stack[-1][0] > lcp[i]:
                length, bound = stack.pop()
                if changed[i - 1] > bound:
                    yield length, here[bound:i]
            if lcp[i] >= 0 and (not stack or stack[-1][0] < lcp[i]):
                stack.append((lcp[i], bound))


def _common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while n - low > 1:  # it lies in [low, n)
        mid = (low + n) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            n = mid
    return low


class _Suffixes:
    """The suffixes of some contexts, in places numbered one after the other."""

    def __init__(self, h: np.ndarray, w: np.ndarray, body: list[bytes], min_length: int, gram: int):
        self.raw = np.frombuffer(b"".join(body), dtype=np.uint8)
        sizes = np.array([len(x) for x in body], dtype=np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.end = self.start + sizes
        self.first = np.cumsum(w) - w
        self.total, self.min_length = int(w.sum()), min_length
        sums, back = _running(self.raw)
        n = len(self.raw) - gram + 1
        hashes = _kernel.mix((sums[gram:] - sums[:-gram]) * back[:n])
        at_gram = np.flatnonzero(hashes == np.repeat(h.view(_U), sizes)[:n])
        self.grams = at_gram
        self.key = np.empty(self.total, dtype=_U)
        salt = _kernel.mix(h.view(_U))
        for lo in range(0, self.total, SUFFIXES):
            owner, off = self.located(np.arange(lo, min(lo + SUFFIXES, self.total)))
            at = self.start[owner] + off
            self.key[lo : lo + len(at)] = _kernel.mix((sums[at + min_length] - sums[at]) * back[at] + salt[owner])

    def located(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and offset in it of the suffixes with these numbers."""
        owner = np.searchsorted(self.first, which, side="right") - 1
        return owner, which - self.first[owner]

    def tails(self, owner: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, left neighbour, whether it is the first to pick its gram) of what follows the first ``min_length`` bytes, to ``min_length`` bytes from the picked gram."""
        at = self.start[owner] + off
        picked = self.grams[np.searchsorted(self.grams, at)]
        left = self.raw[np.maximum(at - 1, 0)].astype(np.int64)
        # The window before picked another gram, in another context or nearer, so that its tail ends before this one's:
        # the left neighbour is taken to differ from any.
        new = (off == 0) | (picked != self.grams[np.searchsorted(self.grams, np.maximum(at - 1, 0))])
        left[new] = 256 + at[new]
        return at + self.min_length, np.minimum(picked + self.min_length, self.end[owner]), left, new


def _spans(found: Iterator[tuple[int, np.ndarray, np.ndarray]], size: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """What repeats (length, contexts, offsets below ``size``) cover in each context, joined where it overlaps."""
    reach = np.zeros(len(h) * size, dtype=np.int32)
    for length, owner, off in found:
        at = owner * size + off
        reach[at] = np.maximum(reach[at], length)
    at = np.flatnonzero(reach)
    owner, off = at // size, at % size
    end = np.maximum.accumulate(owner * (size << 20) + off + reach[at]) if len(at) else at
    begin = owner * (size << 20) + off
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(at) else at
    last = np.r_[new[1:], len(at)] - 1 if len(at) else at
    return pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.string()), pa.array(h[owner[new]]), pa.array(c[owner[new]]), pa.array(off[new]), pa.array(end[last] - begin[new])], names=["group", "h", "c", "off", "length"])


def _places(found: Iterator[tuple[int, np.ndarray, np.ndarray]], name, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Every repeat with its places in contexts."""
    made: list[list] = [[], [], [], [], []]
    for g, (length, owner, off) in enumerate(found):
        for to, x in zip(made, ([name(owner[0], g)] * len(owner), h[owner], c[owner], off, [length] * len(owner)), strict=True):
            to += list(x)
    return pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), *(pa.array(x, pa.int64()) for x in made[1:])], names=["group", "h", "c", "off", "length"])


def _in_turns(same: int, size: int, flush):
    """Arrow rows in runs of about ``CHUNK`` bytes (column ``size``); rows that agree in the first ``same`` columns stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        volume = 0
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if volume > CHUNK and row[:same] != held[-1][:same]:
                    yield flush(*zip(*held, strict=True))
                    held, volume = [], 0
                held.append(row)
                volume += len(row[size]) + 64
        if held:
            yield flush(*zip(*held, strict=True))

    return run


def _scan(min_length: int, gram: int, as_groups: bool):
    """The repeats of each anchor; not ``as_groups``: only what they cover, as nested ones list their places again and again."""

    def flush(h, c, n, w, body) -> pa.RecordBatch:
        h, c, n, w = (np.array(x, dtype=np.int64) for x in (h, c, n, w))
        all_ = _Suffixes(h, w, body, min_length, gram)

        def found():
            parts = -(-all_.total // SUFFIXES)
            for part in range(parts):  # suffixes of one key stay together
                owner, off = all_.located(np.flatnonzero(all_.key % _U(parts) == _U(part)))
                key = all_.key[all_.first[owner] + off]
                start, end, left, new = all_.tails(owner, off)
                for length, which in suffix_intervals(all_.raw, start, end, key, left, new & (n[owner] > 1)):
                    yield min_length + length, owner[which], off[which]

        if as_groups:
            return _places(found(), lambda owner, g: f"{int(h[owner]) & (2**64 - 1):016x}-{g}", h, c)
        return _spans(found(), max(map(len, body)), h, c)

    return _in_turns(1, 4, flush)


def _list_suffixes(min_length: int, gram: int):
    """Every suffix of the contexts wanted of each text: ``k`` is the hash of its first window, ``tail`` what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_contexts(batches):  # in one Python worker, not two
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                h, c, n, w = (part.column(i).to_numpy().astype(np.int64) for i in range(4))
                all_ = _Suffixes(h, w, part.column(4).to_pylist(), min_length, gram)
                owner, off = all_.located(np.arange(all_.total))
                start, end, left, new = all_.tails(owner, off)
                spread = _kernel.mix(c[owner[new]].view(_U) + _kernel.mix(off[new].astype(_U)))
                left[new] = 256 + (spread & _U((1 << 62) - 1)).astype(np.int64)
                tails = [all_.raw[x:y].tobytes() for x, y in zip(start, end, strict=True)]
                columns = [h[owner], all_.key.view(np.int64), c[owner], off, left, new & (n[owner] > 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(tails, pa.binary())], names=["h", "k", "c", "off", "left", "several", "tail"])

    return run


def _scan_nodes(min_length: int, as_groups: bool):
    """``_scan`` over the suffixes of nodes (``h``, ``k``) instead of whole anchors."""

    def flush(h, k, c, off, left, several, tail) -> pa.RecordBatch:
        h, k, c, off = (np.array(x, dtype=np.int64) for x in (h, k, c, off))
        raw = np.frombuffer(b"".join(tail), dtype=np.uint8)
        size = np.array([len(x) for x in tail], dtype=np.int64)
        end = np.cumsum(size)
        key = _kernel.mix(h.view(_U)) + _kernel.mix(k.view(_U) + _U(1))

        def found():
            for length, which in suffix_intervals(raw, end - size, end, key, np.array(left, dtype=np.int64), np.array(several)):
                yield min_length + length, which, off[which]

        if as_groups:
            return _places(found(), lambda i, g: f"{int(h[i]) & (2**64 - 1):016x}-{int(k[i]) & (2**64 - 1):016x}-{g}", h, c)
        return _spans(found(), int(off.max()) + 1, h, c)

    return _in_turns(2, 6, flush)


def _crowded(asked: DataFrame, min_length: int, gram: int, most: int, as_groups: bool) -> DataFrame:
    """The repeats of anchors whose suffixes are too many for one task; ``asked`` has texts and the contexts wanted of each."""
    rows = keep(asked.mapInArrow(_list_suffixes(min_length, gram), "h long, k long, c long, off long, left long, several boolean, tail binary"), "suffixes")
    common = "aggregate(IF(least(length(t0), length(t1)) > 0, sequence(1, least(length(t0), length(t1))), CAST(array() AS array<int>)), 0, (a, i) -> IF(a = i - 1 AND substring(t0, i, 1) = substring(t1, i, 1), i, a))"
    upper, small = [], []
    while True:
        ends = [f("tail").alias(n) for f, n in ((F.min, "t0"), (F.max, "t1"))]
        nodes = rows.groupBy("h", "k").agg(F.count("*").alias("m"), (F.min("left") != F.max("left")).alias("diverse"), F.max("several").alias("several"), *ends)
        nodes = nodes.where("m > 1 OR several").select("h", "k", "m", "diverse", F.expr(common).alias("common"))
        nodes = keep(nodes, "nodes")
        small.append(rows.join(nodes.where(F.col("m") <= most).select("h", "k"), ["h", "k"]))
        large = nodes.where(F.col("m") > most).select("h", "k", "diverse", "common")
        n = large.count()
        if not n:
            break
        inner = rows.join(F.broadcast(large) if n <= 10_000 else large, ["h", "k"])
        name = F.concat_ws("-", F.lpad(F.lower(F.hex("h")), 16, "0"), F.lpad(F.lower(F.hex("k")), 16, "0"))
        upper.append(inner.where("diverse").select(name.alias("group"), "h", "c", "off", (F.col("common") + min_length).cast("long").alias("length")))
        deeper = inner.where("length(tail) > common").withColumn("k", F.expr("xxhash64(k, substring(tail, 1, common + 1))"))
        rows = keep(deeper.select("h", "k", "c", "off", "left", "several", "tail"), "deeper")
    below = small[0]
    for x in small[1:]:
        below = below.unionByName(x)
    out = below.repartition("h", "k").sortWithinPartitions("h", "k").select("h", "k", "c", "off", "left", "several", "tail").mapInArrow(_scan_nodes(min_length, as_groups), _FOUND)
    for x in upper:
        out = out.unionByName(x)
    return out


def _repeats(source: DataFrame, min_length: int, gram: int, most: int, as_groups: bool) -> tuple[DataFrame, DataFrame, str]:
    """Repeats (``group``, ``length``, ``rid``, ``s``); the texts that may have some (``rid``, ``text``), dealt by ``rid``; their table's name."""
    found = keep(source.mapInArrow(_list_contexts(min_length, gram), "h long, c long, rid long, s long, size int, w int, again boolean"), "contexts", scan=True)
    twice = found.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("h")
    members = keep(found.drop("again").join(twice, "h"), "members")
    texts, name = keep_dealt(source.join(members.select("rid").distinct().hint("shuffle_hash"), "rid"), "rid")

    head = F.min(F.struct("rid", "s", "size", "w")).alias("head")
    classes = keep(members.groupBy("h", "c").agg(F.count("*").alias("n"), head).select("h", "c", "n", "head.*"), "classes")
    crowded = classes.groupBy("h").agg(F.sum("w").alias("w")).where(F.col("w") > most).select("h")
    n_crowded = crowded.count()
    crowded = F.broadcast(crowded) if n_crowded <= 10_000 else crowded

    def asked(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "n", "s", "size", "w")).alias("wanted"))
        return texts.join(wanted.hint("shuffle_hash"), "rid").select("text", "wanted")

    usual = asked(classes.join(crowded, "h", "left_anti") if n_crowded else classes).mapInArrow(_cut_contexts, "h long, c long, n long, w int, body binary")
    repeats = usual.repartition("h").sortWithinPartitions("h").mapInArrow(_scan(min_length, gram, as_groups), _FOUND)
    if n_crowded:
        repeats = repeats.unionByName(_crowded(asked(classes.join(crowded, "h")), min_length, gram, most, as_groups))
    repeats = repeats.join(members.select("h", "c", "rid", "s"), ["h", "c"]).select("group", "length", "rid", (F.col("s") + F.col("off")).alias("s"))
    return repeats, texts, name


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its covered bytes."""
    import hashlib

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        texts, covers, rid = col["text"].cast(pa.large_binary()), col["covers"], col["rid"]
        removed, spans, digests, left, rest = [], [], [], [], []
        for i in range(batch.num_rows):
            raw, asked = texts[i].as_py(), covers[i].values
            gone: list[list[int]] = []
            for s, e in sorted(zip(asked.field("s").to_pylist(), asked.field("e").to_pylist(), strict=True)):
                if gone and s <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], e)
                else:
                    gone.append([s, e])
            kept, whole, at, at_whole = [], [], 0, 0
            for s, e in gone:
                kept.append(raw[at:s])
                at = e
                while s < e and raw[s] & 0xC0 == 0x80:  # a code point cut in two stays whole
                    s += 1
                while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                whole.append(raw[at_whole:s])
                at_whole = e
            kept.append(raw[at:])
            whole.append(raw[at_whole:])
            removed.append(sum(e - s for s, e in gone))
            spans.append(gone)
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            left.append(b"".join(whole))
            rest.append(len(gone))
        span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        spans = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], span_type)
        yield pa.RecordBatch.from_arrays(
            [rid, pa.array(removed, pa.int64()), pa.array(rest, pa.int64()), pa.array(digests, pa.string()), spans, pa.array(left, pa.binary()).cast(pa.string())],
            names=["rid", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"],
        )


def repeat_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, most: int = MOST_SUFFIXES) -> DataFrame:
    """Repeats and all their occurrences: ``group``, ``length``, ``id``, ``rid``, ``s`` (start byte).

    Each group has every place of its string in all texts, rows with equal texts
    included.  Groups are the maximal repeats; of one that goes on for more than
    ``min_length`` bytes after the gram that its first window picked, the groups
    are overlapping parts, one or more to each anchor in it.
    Empty and null texts have none.
    """
    documents = settled(documents)
    source = rows_with_id(documents, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows_with_id(documents, F.col(id_col).alias("id"))
    repeats, _, name = _repeats(source, min_length, gram, most, True)
    groups = keep(repeats, "groups")
    documents.sparkSession.sql(f"DROP TABLE {name}")
    return groups.join(ids, "rid").select("group", "length", "id", "rid", "s")


def repeated_bytes(documents: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, most: int = MOST_SUFFIXES, columns: tuple[str, ...] = ("n_removed", "n_spans", "kept_sha256", "spans", "kept_text")) -> DataFrame:
    """For each row with a repeat: ``rid`` and the ``columns`` asked for.

    ``rid`` numbers the rows of ``documents``, which must be ``settled``, as
    ``rows_with_id`` does.
    ``kept_text`` keeps a code point whole where a span begins or ends inside it;
    the other columns go by bytes.  Repeated rows are separate texts, so each
    finds itself in the other.  Null and empty texts have no row here.
    """
    source = rows_with_id(documents, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeats, texts, name = _repeats(source, min_length, gram, most, False)
    covers = repeats.groupBy("rid").agg(F.collect_set(F.struct("s", (F.col("s") + F.col("length")).alias("e"))).alias("covers"))
    schema = "rid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: long, e: long>>, kept_text string"
    found = texts.join(covers.hint("shuffle_hash"), "rid").select("rid", "text", "covers").mapInArrow(_removed, schema)
    found = keep(found.select("rid", *columns), "removed")
    documents.sparkSession.sql(f"DROP TABLE {name}")
    return found


def without_repeats(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``documents`` with every repeated byte taken out of the text; all rows and columns stay."""
    documents = settled(documents)
    rid, kept = unused(documents, "rid", "kept")
    found = repeated_bytes(documents, text_col, columns=("kept_text",), **options).select(F.col("rid").alias(rid), F.col("kept_text").alias(kept))
    text = F.when(F.col(kept).isNotNull(), F.col(kept)).otherwise(F.col(text_col))
    rows = documents.withColumn(rid, F.monotonically_increasing_id()).join(found.hint("shuffle_hash"), rid, "left")
    return rows.withColumn(text_col, text).drop(rid, kept)


def op6(spark, sf_dir: str) -> DataFrame:
    """What stays of every document without the strings of 200 bytes that occur twice."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_bytes(documents, columns=("n_removed", "n_spans", "kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    base = rows_with_id(documents, F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return base.join(found, "rid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
