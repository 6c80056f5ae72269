"""Lines and rows that arrive bit by bit: whole lines out of growing files, and tables written batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

#: A batch is written at least so often, and in files of so many rows at most.
SECONDS, ROWS = 2, 500


def whole_lines(chunks: DataFrame) -> DataFrame:
    """(``file``, ``place``, ``line``): the whole lines of growing files, numbered from 0 in each.

    ``chunks`` is a stream of ``file``, ``at`` (order within the file) and
    ``text``, as a file grows.  What comes after the last newline waits for the
    next chunk; the state of a file is that rest and the number of lines so far.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest, place = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("at")
        *lines, rest = (rest + "".join(rows["text"].fillna(""))).split("\n")
        state.update((rest, place + len(lines)))
        yield pd.DataFrame({"file": [key[0]] * len(lines), "place": range(place, place + len(lines)), "line": lines})

    return chunks.select("file", "at", "text").groupBy("file").applyInPandasWithState(run, "file string, place long, line string", "rest string, place long", "append", GroupStateTimeout.NoTimeout)


def append_batches(rows: DataFrame, path: str, checkpoint: str, seconds: int | None = SECONDS, most: int = ROWS) -> StreamingQuery:
    """Start to append a stream to the Parquet table at ``path``, a folder per batch; None: to the end of what is there.

    Rows wait no longer than ``seconds`` for their batch; what has come by then
    is written in groups of ``most`` rows at most, a file each.  A batch that is
    run again after a failure takes the place of what it wrote before, so that no
    row is there twice.  Batches count from the checkpoint: with a new one, give
    a new path too, as folders of the same numbers would be replaced.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def drained(done: DataFrame, pending: DataFrame, new: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """One step of draining a log into rows: (rows that have their index line now, rows still waiting).

    ``pending`` and ``new`` are logged rows (by ``key``), ``done`` the index lines
    so far; what has no line yet is carried to the next step.
    """
    waiting = pending.unionByName(new)
    return waiting.join(done.select(key).distinct(), key, "left_semi"), waiting.join(done.select(key), key, "left_anti")
