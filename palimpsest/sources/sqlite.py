"""Tables of SQLite files as rows: a data source whose tasks read ranges of row numbers.

Files are opened read-only where they lie; one in other storage is read into the
memory of the task, as SQLite needs a file of its own.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.sources import ranges

#: Row numbers of a task, and rows handed to Spark together.
ROWS, _TOGETHER = 200_000, 5000


def connected(path: str) -> sqlite3.Connection:
    """A read-only connection to the SQLite file at ``path``."""
    fs, inner = ranges.opened(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return sqlite3.connect(f"file:{inner.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
    out = sqlite3.connect(":memory:")
    with fs.open_input_file(inner) as file:
        out.deserialize(file.read())
    return out


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class TableReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.columns = options["columns"].split(",")

    def partitions(self) -> list[Rows]:
        out = []
        for path, _ in ranges.listed(self.path, (".sqlite3", ".sqlite", ".db")):
            db = connected(path)
            try:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone():
                    continue
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            finally:
                db.close()
            out += [Rows(path, a, min(a + self.rows - 1, last)) for a in (range(first, last + 1, self.rows) if first is not None else ())]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        names = ["path", *self.columns]
        db = connected(partition.path)
        try:
            text = ", ".join(f"CAST({_quoted(c)} AS TEXT)" for c in self.columns)
            found = db.execute(f"SELECT {text} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.first, partition.last))
            while rows := found.fetchmany(_TOGETHER):
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=names)
        finally:
            db.close()


class TableSource(DataSource):
    """Spark data source ``sqlite_table``: options ``path``, ``table``, ``columns`` (by commas), ``rows`` (row numbers of a task)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(["path string", *(f"`{c}` string" for c in self.options["columns"].split(","))])

    def reader(self, schema) -> TableReader:
        return TableReader(self.options)


def read_table(spark, path: str, table: str, columns: list[str], rows: int = ROWS) -> DataFrame:
    """Columns of a table as text, and the ``path`` of each row's file, of all SQLite files at or below ``path``.

    Files without the table give no rows; one without a column is an error.
    """
    spark.dataSource.register(TableSource)
    return spark.read.format("sqlite_table").option("table", table).option("columns", ",".join(columns)).option("rows", rows).load(path)


def read_snapshots(spark, path: str) -> DataFrame:
    """Snapshots of foreign indexes with their tags: ``path``, ``id``, ``timestamp``, ``url``, ``title``, ``added``, ``tags``.

    Those without URL or time are left out; an index without tables of tags has no tags.
    """
    from palimpsest.operators import imports

    key = lambda c: F.concat_ws("\n", "path", c)  # noqa: E731  ids are of their own file
    rows = read_table(spark, path, "core_snapshot", ["id", "timestamp", "url", "title", "added"])
    bridge = read_table(spark, path, "core_snapshot_tags", ["snapshot_id", "tag_id"]).select(key("snapshot_id").alias("snapshot_id"), key("tag_id").alias("tag_id"))
    tags = read_table(spark, path, "core_tag", ["id", "name"]).select(key("id").alias("id"), F.trim("name").alias("name")).where("name <> ''")
    found = imports.snapshots(rows.select(key("id").alias("id"), F.col("id").alias("_id"), "path", "timestamp", "url", F.coalesce("title", F.lit("")).alias("title"), "added"), bridge, tags)
    return found.select("path", F.col("_id").alias("id"), "timestamp", "url", "title", "added", "tags")
