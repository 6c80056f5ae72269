"""Streams with state of their own: feeds' items, events kept for late readers, a crawl's log against its index.

State is in maps that are read and written entry by entry (``transformWithState``
over RocksDB), so a key with many entries costs what changes, not what it has.
Rows of a micro-batch are taken in the order that the caller names; whichever
way a stream is cut into micro-batches, the state after them is the same.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Newest events of a job that are kept; for how long those of a finished job are kept on.
BUFFER, LINGER = 500, "1 minute"
#: Feeds and URLs are dealt to so many keys of state, with so many cells each; a cell is read and written as one entry.
BUCKETS, CELLS = 1024, 8
#: Cells of the items of a key's feeds, and as many of their addresses.
ITEM_CELLS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_maps(spark) -> None:
    """State maps need RocksDB: from here on the session's new streams use it (a stream goes on with what its checkpoint was made with)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    with suppress(Exception):
        if "RocksDB" in (spark.conf.get(key) or ""):
            return
    spark.conf.set(key, ROCKS)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable").itertuples(index=False) if parts else iter(())


def _some(value):
    """None for what pandas makes of null."""
    return None if value is None or value is pd.NaT or value != value else value


# Items of feeds

ITEMS = "feed string, poll long, place long, guid string, canonical string, status string, content_hash string, updated long, action string"


class _Cells:
    """A state map of cells, each with the values of many (feed, name); those of a micro-batch are read and written once."""

    def __init__(self, state):
        self.state, self.read, self.changed = state, {}, set()

    def _at(self, name: tuple) -> int:
        at = zlib.crc32(f"{name[0]}\0{name[1]}".encode("utf-8", "surrogatepass")) % ITEM_CELLS
        if at not in self.read:
            held = self.state.getValue((at,))
            self.read[at] = {(f, n): tuple(rest) for f, n, *rest in zip(*held, strict=True)} if held else {}
        return at

    def get(self, name: tuple) -> tuple | None:
        return self.read[self._at(name)].get(name)

    def put(self, name: tuple, value: tuple) -> None:
        at = self._at(name)
        self.read[at][name] = value
        self.changed.add(at)

    def write(self) -> None:
        for at in self.changed:
            self.state.updateValue((at,), tuple(map(list, zip(*((*name, *value) for name, value in self.read[at].items()), strict=True))))


class _Items(StatefulProcessor):
    """Two maps a key, which is many feeds: items by feed and guid, and the guid by feed and canonical URL."""

    def init(self, handle) -> None:
        self.items = handle.getMapState("items", "cell int", "feed array<string>, guid array<string>, canonical array<string>, status array<string>, content_hash array<string>, updated array<long>")
        self.by_url = handle.getMapState("by_url", "cell int", "feed array<string>, canonical array<string>, guid array<string>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        items, by_url = _Cells(self.items), _Cells(self.by_url)
        for r in initialState.sort_values("guid", ascending=False).itertuples(index=False):
            feed, canonical = _some(r.feed), _some(r.canonical)
            items.put((feed, r.guid), (canonical, r.status, _some(r.content_hash), None if _some(r.updated) is None else int(r.updated)))
            if canonical is not None:
                by_url.put((feed, canonical), (r.guid,))
        items.write()
        by_url.write()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        items, by_url, out = _Cells(self.items), _Cells(self.by_url), []
        for r in _ordered(rows, ["poll", "place"]):
            feed, canonical, digest, moment = _some(r.feed), _some(r.canonical), _some(r.content_hash), None if _some(r.updated) is None else int(r.updated)
            guid, item = r.guid, items.get((feed, r.guid))
            if item is None and canonical is not None and (named := by_url.get((feed, canonical))):
                guid, item = named[0], items.get((feed, named[0]))
            if item is None:
                row = (canonical, "skipped" if r.baseline else "pending", digest, moment)
                action = "new"
                if canonical is not None:
                    by_url.put((feed, canonical), (guid,))
            else:
                url, status, known, updated = item
                changed = bool(digest) and bool(known) and digest != known
                row = (url, "pending" if changed else status, digest or known, moment if updated is None else updated if moment is None else max(moment, updated))
                action = "changed" if changed else "seen"
            if row != item:
                items.put((feed, guid), row)
            out.append((feed, r.poll, r.place, guid, *row, action))
        items.write()
        by_url.write()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEMS.split(", ")]).astype({"updated": "Int64"})

    def close(self) -> None:
        pass


def merged_items(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Items of feeds as their entries come in, a row for each entry (``ITEMS``); a guid's row of the last poll and place is how the item stands.

    ``entries``: a stream of ``feed``, ``poll``, ``place``, ``guid``, ``canonical``,
    ``content_hash``, ``updated`` (a number) and ``baseline`` (the feed's first
    poll, whose new items are skipped).  ``known``: items before the stream, with
    ``feed`` and the columns of an item.  An entry is the item of its guid, or
    else of its canonical URL (of several known ones, the least guid); a changed
    content hash makes it pending again, and ``updated`` never goes back.  A null
    URL, hash or moment says nothing.  Entries are taken in the order of poll and
    place.  A key of state is many feeds, as a key costs Python more than its rows do.
    """
    with_state_maps(entries.sparkSession)
    columns = ["feed", "guid", "canonical", "status", "content_hash", "updated"]
    bucket = F.pmod(F.xxhash64("feed"), F.lit(BUCKETS)).cast("int").alias("bucket")
    initial = None if known is None else known.select(bucket, *columns).groupBy("bucket")
    rows = entries.select(bucket, "feed", "poll", "place", "guid", "canonical", "content_hash", "updated", "baseline")
    return rows.groupBy("bucket").transformWithStateInPandas(_Items(), ITEMS, "Append", "None", initial)


# Events for late readers

READS = "job string, reader string, id long, data string, oldest long, gap boolean"


def _readable(rows: Iterator[pd.DataFrame], most: int) -> Iterator[tuple]:
    """Rows in the order of ``at``, without the events that ``most`` others follow before anything is read or the rows end."""
    parts = list(rows)
    if not parts:
        return iter(())
    rows = pd.concat(parts).sort_values("at", kind="stable")
    event = rows["kind"] == "event"
    number = event.cumsum()
    until = number.where(rows["kind"] == "read").bfill().fillna(number.iloc[-1])
    return rows[~event | (until - number < most)].itertuples(index=False)


def _buffer(most: int) -> StatefulProcessor:
    class Buffer(StatefulProcessor):
        """Events by their running number in the job; ``ends`` are the numbers of the oldest and of the next one.

        Events that go before anyone could read them get no number and never are state.
        """

        def init(self, handle) -> None:
            self.handle = handle
            self.events = handle.getMapState("events", "n long", "id long, data string")
            self.ends = handle.getValueState("ends", "first long, next long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            first, nxt = self.ends.get() if self.ends.exists() else (0, 0)
            old, new, end, out = None, deque(maxlen=most), nxt, []
            for r in _readable(rows, most):
                if r.kind == "event":
                    new.append((int(r.id), _some(r.data)))
                    end += 1
                elif r.kind == "finished":
                    self.handle.registerTimer(int(r.until))
                elif r.kind == "read":
                    if old is None:
                        old = [self.events.getValue((n,)) for n in range(first, nxt)]
                    held = [*old[max(0, end - most - first) :], *new]
                    oldest = held[0][0] if held else None
                    gap = bool(held) and oldest > int(r.id) + 1
                    later = [e for e in held if e[0] > int(r.id)] or [(None, None)]
                    out += [(key[0], _some(r.data), i, data, oldest, gap) for i, data in later]
            start = max(first, end - most)
            for n in range(first, min(start, nxt)):
                self.events.removeKey((n,))
            for n, e in zip(range(end - len(new), end), new, strict=True):
                self.events.updateValue((n,), e)
            self.ends.update((start, end))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READS.split(", ")]).astype({"id": "Int64", "oldest": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.events.clear()
            self.ends.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Buffer()


def buffered(rows: DataFrame, most: int = BUFFER, linger: str = LINGER) -> DataFrame:
    """What readers get of each job's events (``READS``): those after the one that they have seen, out of the newest ``most``.

    ``rows``: a stream of ``job``, ``at`` (order), ``ts``, ``kind``, ``id`` and
    ``data``.  An ``event`` is kept, the oldest beyond ``most`` goes; a ``read``
    has the last seen ``id`` and the reader's name as ``data``; ``finished`` frees
    a job's events when the stream is ``linger`` of event time later, which is
    also how late rows may be.  ``gap``: events between the one seen and
    the oldest kept are lost.  A reader for whom there is nothing new gets one
    row without an event.
    """
    with_state_maps(rows.sparkSession)
    timed = rows.withWatermark("ts", linger).select("job", "at", "ts", "kind", "id", "data", F.unix_millis("ts").alias("until"))
    return timed.groupBy("job").transformWithStateInPandas(_buffer(most), READS, "Append", "EventTime")


# A crawl's log against its index

DRAINED = "url string, line long, state string"


#: Waiting lines of a URL beyond this go to entries of their own, which nothing touches until the lines are given.
MOST_WAITING = 256


class _Log(StatefulProcessor):
    """URLs in cells: whether the index has them, until when they are kept, and the logged lines that wait for their index line.

    ``more`` counts the full pieces of waiting lines that lie in ``waiting``; ``alarm`` is the key's timer, not later than the first URL that ends.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell int", "url array<string>, indexed array<boolean>, until array<long>, lines array<array<long>>, more array<int>")
        self.waiting = handle.getMapState("waiting", "url string, piece int", "lines array<long>")
        self.alarm = handle.getValueState("alarm", "at long")

    def _put(self, cell, urls: dict) -> None:
        if urls:
            self.cells.updateValue((cell,), ([*urls], *map(list, zip(*urls.values(), strict=True))))
        else:
            self.cells.removeKey((cell,))

    def _taken(self, url, known: list) -> list[int]:
        """The lines that waited for ``url``, in order; none wait from here on."""
        found = list(known[2])
        for piece in range(known[3]):
            found += self.waiting.getValue((url, piece))[0]
            self.waiting.removeKey((url, piece))
        known[2:] = [], 0
        return sorted(found)

    def _wake(self, at: int | None) -> None:
        """See to it that the key's timer is not later than ``at``, if anything is left to end."""
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if at is not None and (old is None or at < old):
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        read: dict[int, dict] = {}
        out, first = [], None
        for part in rows:
            for cell, kind, url, line, until in zip(*(part[c].tolist() for c in ("cell", "kind", "url", "line", "until")), strict=True):
                if cell not in read:
                    held = self.cells.getValue((cell,))
                    read[cell] = {u: [i, t, list(lines), m] for u, i, t, lines, m in zip(*held, strict=True)} if held else {}
                url = _some(url)
                known = read[cell].setdefault(url, [False, until, [], 0])
                known[1] = max(known[1], until)
                first = until if first is None else min(first, until)
                if kind == "index" and not known[0]:
                    known[0] = True
                    out += [(url, x, "written") for x in self._taken(url, known)]
                elif kind == "log" and known[0]:
                    out.append((url, line, "written"))
                elif kind == "log":
                    known[2].append(line)
                    if len(known[2]) >= MOST_WAITING:
                        self.waiting.updateValue((url, known[3]), (known[2],))
                        known[2:] = [], known[3] + 1
        for cell, urls in read.items():
            self._put(cell, urls)
        self._wake(first)
        yield pd.DataFrame(out, columns=["url", "line", "state"]).astype({"line": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.alarm.clear()
        out, first = [], None
        for (cell,), held in list(self.cells.iterator()):
            urls, kept = {u: [i, t, list(lines), m] for u, i, t, lines, m in zip(*held, strict=True)}, {}
            for url, known in urls.items():
                if known[1] <= now:
                    out += [(url, x, "lost") for x in self._taken(url, known)]
                else:
                    kept[url] = known
                    first = known[1] if first is None else min(first, known[1])
            if len(kept) < len(urls):
                self._put(cell, kept)
        self._wake(first)
        yield pd.DataFrame(out, columns=["url", "line", "state"]).astype({"line": "Int64"})

    def close(self) -> None:
        pass


def drained(rows: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """Logged lines (``DRAINED``), each once: ``written`` as soon as the index has a line of their URL, whichever came first, or ``lost``.

    ``rows``: a stream of ``kind`` (``log`` or ``index``), ``url``, ``line`` and
    ``ts``, in any order as long as none is later than ``patience`` of event
    time.  Lines that wait are state; when the stream is ``patience`` past what
    was last heard of a URL, its lines are given up and its state goes.  A key of
    state is many URLs, as a key costs Python more than its rows do.
    """
    with_state_maps(rows.sparkSession)
    place = F.pmod(F.xxhash64("url"), F.lit(BUCKETS * CELLS)).cast("int")
    timed = rows.withWatermark("ts", patience).select((place % BUCKETS).alias("bucket"), "kind", "url", F.col("line").cast("long").alias("line"), "ts", F.unix_millis("ts").alias("until"), F.floor(place / BUCKETS).cast("int").alias("cell"))
    return timed.groupBy("bucket").transformWithStateInPandas(_Log(), DRAINED, "Append", "EventTime")
