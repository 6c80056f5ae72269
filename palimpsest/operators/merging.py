"""Tables whose rows are replaced by key, without being rewritten: a base, deltas and tombstones, merged when read.

A key's rows are replaced as a set.  ``upsert`` writes the new rows alone,
``drop`` a condition, both in proportion to the change.  ``read`` takes from the
base what no delta has a key of, adds the newest rows of each key in deltas, and
leaves out what was dropped later.  ``compact`` rewrites those buckets of keys
whose deltas have grown large beside their base.

A table is what its newest manifest lists.  A write becomes part of it with its
manifest, which only one of two writers at a time can create; what a failed write
left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a bucket's base that its deltas may reach before ``compact`` rewrites it.
RATIO = 0.2


@dataclass
class Manifest:
    """``base``: folder and rows of each bucket; ``deltas``: (version, folder, rows by bucket); ``gone``: (version, column, folder)."""

    version: int = 0
    schema: str = ""
    base: dict[str, tuple[int, str, int]] = field(default_factory=dict)
    deltas: list[tuple[int, str, dict[str, int]]] = field(default_factory=list)
    gone: list[tuple[int, str, str]] = field(default_factory=list)


class MergeTable:
    """A table at ``path`` (in storage that all machines share) by ``keys``, in ``buckets`` buckets of them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def manifest(self) -> Manifest:
        """The newest one; an empty one for a table that isn't there yet."""
        if not self._fs.exists(self._at("manifests")):
            return Manifest()
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))), reverse=True)
        for name in names:
            if name.endswith(".json"):
                try:
                    return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first().value))
                except (json.JSONDecodeError, TypeError, AttributeError):
                    continue  # a writer that failed
        return Manifest()

    def _publish(self, m: Manifest) -> None:
        """Make ``m`` the newest manifest; an error if another writer was first."""
        stream = self._fs.create(self._at(f"manifests/{m.version:09d}.json"), False)
        stream.write(bytearray(json.dumps(m.__dict__).encode()))
        stream.close()

    # writing

    def _write(self, rows: DataFrame, version: int) -> tuple[str, dict[str, int]]:
        """Rows in folders by bucket, and how many each has."""
        name = f"data/{version:09d}-{uuid.uuid4().hex[:8]}"
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        if not self._fs.exists(self._at(name)):
            return name, {}
        written = self.spark.read.schema(placed.schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return name, {str(r._bucket): r["count"] for r in written.groupBy("_bucket").count().collect()}  # a row a bucket

    def upsert(self, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Put ``rows`` in place of all rows with their keys; ``touched`` has keys that lose their rows without getting any.

        A key may have several rows, which belong together.  Keys may be null.
        """
        m = self.manifest()
        version = m.version + 1
        full = rows.withColumn("_v", F.lit(version).cast("long")).withColumn("_live", F.lit(True))
        if touched is not None:
            same = [F.col(f"_t_{k}").eqNullSafe(F.col(k)) for k in self.keys]
            empty = touched.select(*[F.col(k).alias(f"_t_{k}") for k in self.keys]).distinct().join(rows.select(*self.keys).distinct(), same, "left_anti")
            empty = empty.select(*[F.col(f"_t_{c}").alias(c) if c in self.keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
            full = full.unionByName(empty.withColumn("_v", F.lit(version).cast("long")).withColumn("_live", F.lit(False)))
        folder, counts = self._write(full, version)
        schema = m.schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema.fields)
        self._publish(Manifest(version, schema, m.base, [*m.deltas, (version, folder, counts)], m.gone))

    def drop(self, column: str, values: DataFrame) -> None:
        """Take out the rows whose ``column`` is among ``values`` (one column), as of now; rows written later stay.  Null is no value."""
        m = self.manifest()
        version = m.version + 1
        folder = f"gone/{version:09d}-{uuid.uuid4().hex[:8]}"
        values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct().write.parquet(f"{self.path}/{folder}")
        self._publish(Manifest(version, m.schema, m.base, m.deltas, [*m.gone, (version, column, folder)]))

    # reading

    def _files(self, m: Manifest, folders: list[str]) -> DataFrame:
        """Rows of bucket folders; the schema is the manifest's, so that no file is opened for it."""
        schema = self.spark.createDataFrame([], m.schema).schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _merged(self, m: Manifest, only: set[str] | None = None) -> DataFrame:
        """Live rows with ``_v``, of all buckets or some of them."""
        takes = lambda b: only is None or b in only
        base_folders = [f"{f}/_bucket={b}" for b, (_, f, n) in m.base.items() if n and takes(b)]
        base = self._files(m, base_folders)
        since = {b: v for b, (v, _, _) in m.base.items()}
        folders = [f"{f}/_bucket={b}" for v, f, counts in m.deltas for b in counts if v > since.get(b, -1) and takes(b)]
        rows = base
        if folders:
            new = self._files(m, folders)
            keys = [F.col(k).alias(f"_k_{k}") for k in self.keys]
            same = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in self.keys]
            if len(folders) == len({f.rpartition("/")[2] for f in folders}):  # a delta a bucket: its rows are the newest
                newest, kept = new.select(*keys), new.where("_live")
            else:
                newest = new.groupBy(*keys).agg(F.max("_v").alias("_newest"))
                kept = new.join(newest, [*same, F.col("_v") == F.col("_newest")], "left_semi").where("_live")
            rows = base.join(newest, same, "left_anti").unionByName(kept) if base_folders else kept
        for version, column, folder in m.gone:
            values = self.spark.read.parquet(f"{self.path}/{folder}").withColumnRenamed("value", "_gone")
            rows = rows.join(values, (F.col(column) == F.col("_gone")) & (F.col("_v") < version), "left_anti")
        return rows

    def read(self) -> DataFrame:
        """The rows as they are now.  An error for a table that was never written."""
        m = self.manifest()
        if not m.schema:
            raise ValueError(f"there is no table at {self.path}")
        return self._merged(m).drop("_v", "_live")

    def compact(self, ratio: float = RATIO) -> list[int]:
        """Merge the buckets whose deltas have more than ``ratio`` of their base's rows; the buckets that were rewritten.

        Deltas and tombstones that all buckets have taken in leave the manifest.
        """
        m = self.manifest()
        since = {b: v for b, (v, _, _) in m.base.items()}
        waiting: dict[str, int] = {}
        for v, _, counts in m.deltas:
            for b, n in counts.items():
                if v > since.get(b, -1):
                    waiting[b] = waiting.get(b, 0) + n
        due = {b for b, n in waiting.items() if n > ratio * m.base.get(b, (0, "", 0))[2]}
        if m.gone and ratio <= 0:
            due |= set(m.base)
        if not due:
            return []
        version = m.version + 1
        folder, counts = self._write(self._merged(m, due).withColumn("_live", F.lit(True)), version)
        base = m.base | {b: (m.version, folder, counts.get(b, 0)) for b in due}
        known = set(base) | {b for _, _, c in m.deltas for b in c}
        least = min((base[b][0] if b in base else -1) for b in known)
        deltas = [d for d in m.deltas if any(d[0] > base.get(b, (-1,))[0] for b in d[2])]
        self._publish(Manifest(version, m.schema, base, deltas, [g for g in m.gone if g[0] > least]))
        return sorted(map(int, due))
