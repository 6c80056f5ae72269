"""Sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into ``SLOTS`` slots; a slot's place never changes.  Bytes
and rows are added up per slot, a table of ``SLOTS`` rows whatever the input,
and a map from slot to shard is made from it: largest slots first, each to the
lightest shard.  The map is versioned; rebalancing edits it (it moves the slots
it must and no others) instead of making a new one.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._scratch import keep, settled, shared_dir

SLOTS, SHARDS = 4096, 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard has each slot, in version ``version``; ``sizes`` are the bytes it was made for."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    sizes: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, size in zip(self.shard_of, self.sizes, strict=True):
            out[shard] += size
        return out

    def column(self, slot: Column) -> Column:
        """The shard of a slot, by look-up in a constant."""
        table = F.from_json(F.lit(json.dumps(list(self.shard_of))), F.lit("array<int>"))
        return F.element_at(table, slot.cast("int") + F.lit(1))


def new_map(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Largest slot first, to the shard with the fewest bytes (then slots, then the smallest number)."""
    heap, shard_of = [(0, 0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, n, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], n + 1, shard))
    return SlotMap(1, shards, tuple(shard_of), tuple(sizes))


def rebalanced(old: SlotMap, sizes: list[int], shards: int | None = None) -> SlotMap:
    """The next version for new sizes and maybe more shards; slots move only from shards above the mean.

    A slot moves to the lightest shard if that makes the two more alike.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards can be added, not taken away")
    shard_of = list(old.shard_of)
    loads, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        loads[shard] += sizes[slot]
        held[shard].append((sizes[slot], -slot))
    mean = sum(sizes) / shards
    for rows in held:
        rows.sort()
    light = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(light)
    for shard in sorted(range(shards), key=lambda s: -loads[s]):
        for size, minus in reversed(held[shard]):
            if loads[shard] <= mean:
                break
            while light[0][0] != loads[light[0][1]]:
                heapq.heappop(light)
            to = light[0][1]
            if size and to != shard and loads[to] + size < loads[shard]:
                shard_of[-minus] = to
                loads[shard] -= size
                loads[to] += size
                heapq.heappush(light, (loads[to], to))
                heapq.heappush(light, (loads[shard], shard))
    return SlotMap(old.version + 1, shards, tuple(shard_of), tuple(sizes))


def slot(*key: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot of ``rows`` (``vslot``, ``size``): at most ``slots`` rows come to the driver."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        sizes[r.vslot], counts[r.vslot] = int(r["size"]), int(r.n)
    return sizes, counts


def save_map(spark, path: str, made: SlotMap) -> None:
    """Add a version to the table of maps; older ones stay."""
    ids = spark.range(len(made.shard_of)).select(F.lit(made.version).alias("version"), F.lit(made.shards).alias("shards"), F.col("id").alias("slot"))
    sizes = F.from_json(F.lit(json.dumps(list(made.sizes))), F.lit("array<bigint>"))
    ids.select("*", made.column(F.col("slot")).alias("shard"), F.element_at(sizes, F.col("slot").cast("int") + 1).alias("bytes")).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, by default the latest."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("slot").collect()
    if not rows:
        raise ValueError(f"no version {version}")
    return SlotMap(int(version), rows[0].shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows))


def stored_map(spark, path: str | None, sizes: list[int], shards: int) -> SlotMap:
    """The map for ``sizes``, stored as a version and read back.

    The latest version at ``path``, if there is one, is rebalanced; else version
    1 is made.  Without a path the table is in the shared folder until the application ends.
    """
    kept, path = path is not None, path or f"{shared_dir(spark)}/palimpsest-maps-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not kept:
        files.deleteOnExit(target)
    old = load_map(spark, path) if files.exists(target) else None
    if old and len(old.shard_of) != len(sizes):
        raise ValueError(f"the stored map has {len(old.shard_of)} slots, not {len(sizes)}")
    made = rebalanced(old, sizes, shards) if old else new_map(sizes, shards)
    save_map(spark, path, made)
    return load_map(spark, path, made.version)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``row``, ``key``, ...) with ``nth``: the number of each among those of its key, from 0.

    Keys are counted per partition of the scan and numbered within those, so that
    a key that a third of all rows have is spread over the partitions that hold it.
    """
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = F.broadcast(several) if several.count() <= 100_000 else several  # checked: a long each
    alike = rows.join(several, "key").withColumn("part", F.shiftright("row", 33))
    before = F.expr("sum(n) OVER (PARTITION BY key ORDER BY part) - n").alias("before")
    per = alike.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", before)
    inner = F.expr("row_number() OVER (PARTITION BY key, part ORDER BY row) - 1")
    alike = alike.withColumn("inner", inner).join(per, ["key", "part"]).withColumn("nth", F.col("before") + F.col("inner")).drop("part", "inner", "before")
    return rows.join(several, "key", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(alike)


def shard_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``vslot``, ``shard`` and ``place`` (gapless from 0 in each shard) of every row.

    Size is the text's UTF-8 bytes plus 1 (null text: 1).  The slot goes by id
    and text, and by the number of the row among those alike in both, so that a
    third of all rows spreads whether it has one text, one id (or none) or both.
    ``maps`` is the table of map versions: its latest is rebalanced and the next
    one added.  Other columns are not read; an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = settled(documents).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = _numbered(keep(rows.withColumn("key", F.xxhash64("id", "text_crc32", "size")), "records", scan=True))
    rows = rows.select("id", "size", "text_crc32", slot(F.col("key"), F.col("nth"), slots=slots).alias("vslot"))
    sizes, counts = slot_sizes(rows, slots)
    made = stored_map(documents.sparkSession, maps, sizes, shards)
    before, start = [0] * shards, [0] * slots  # rows of the shard that lie in earlier slots
    for s, shard in enumerate(made.shard_of):
        start[s] = before[shard]
        before[shard] += counts[s]
    starts = F.element_at(F.from_json(F.lit(json.dumps(start)), F.lit("array<bigint>")), F.col("vslot").cast("int") + 1)
    place = F.expr("row_number() OVER (PARTITION BY vslot ORDER BY id, text_crc32, size)") - 1
    return rows.select("id", "size", "text_crc32", "vslot", made.column(F.col("vslot")).alias("shard"), (starts + place).alias("place"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard, such that shards have nearly equal bytes."""
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
