"""Best-fit packing of texts into sequences, with conflicts.

A sequence (bin) holds at most ``CAPACITY`` words.  Longer texts are cut: whole
sequences first, then the rest as a piece to be packed.  Bins lie in the order
of their free room.  A piece looks for its successor, the fullest bin that still
has room, and goes on to the next until it finds one without a conflict: a bin
carries one bitmap of the sources it holds and one of duplicate clusters.  One
text of a cluster may lie in a bin.  Of a source, twice as many texts as its
share of all texts gives a bin on average may, and ``PER_SOURCE`` at least: so
no source crowds a bin, and where there is only one the bins still fill.

Pieces are dealt out by hash to groups of bounded size, each packed by itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import minhash
from palimpsest.llm._scratch import keep, settled
from palimpsest.llm.mixing import word_count

CAPACITY, PER_SOURCE, GROUP = 2048, 3, 8192


def most_of_a_source(sizes: list[int], sources: list, capacity: int, per_source: int = PER_SOURCE) -> dict:
    """How many texts of each source a bin may hold."""
    words, counts = max(sum(sizes), 1), Counter(sources)
    return {s: max(per_source, -(-2 * n * capacity // words)) for s, n in counts.items()}


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, most: dict) -> tuple[list[int], list[int]]:
    """Bin and place in it of each piece.  Larger pieces go first; equal ones in the order given."""
    source_bit, bits = {}, 0
    for s in dict.fromkeys(sources):
        source_bit[s] = bits
        bits += most[s]
    counts: dict = {}
    for c in clusters:
        counts[c] = counts.get(c, 0) + 1
    cluster_bit = {c: i for i, c in enumerate(c for c in counts if counts[c] > 1)}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, places = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size, low = sizes[i], source_bit[sources[i]]
        full = 1 << (low + most[sources[i]] - 1)
        own = 1 << cluster_bit[clusters[i]] if clusters[i] in cluster_bit else 0
        at = bisect_left(free, (size, -1))
        while at < len(free) and (held_sources[free[at][1]] & full or held_clusters[free[at][1]] & own):
            at += 1
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        level = low
        while held_sources[b] >> level & 1:
            level += 1
        held_sources[b] |= 1 << level
        held_clusters[b] |= own
        bins[i], places[i] = b, capacity - room
        insort(free, (room - size, b))
    return bins, places


def _packed(capacity: int, per_source: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "cluster", "length", "source", "row"], kind="stable", na_position="last")
        sizes, sources = rows["length"].tolist(), [None if pd.isna(s) else s for s in rows["source"]]
        bins, places = pack(sizes, sources, rows["cluster"].tolist(), capacity, most_of_a_source(sizes, sources, capacity, per_source))
        return pd.DataFrame({"id": rows["id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"], "bin_id": [(int(key[0]) << 32) + b for b in bins], "offset": places})

    return run


def best_fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start`` and ``length`` (words of the text), ``bin_id``, ``offset`` (words before it in the bin).

    ``cluster`` tells duplicates; by default rows with equal texts are.
    ``clusters`` tells them instead by row: ``rid`` (``monotonically_increasing_id``
    on ``documents``, which must be ``settled``) and ``cluster``.  A null source is a source.  A null text, or one
    without words, has one row of length 0 and no bin.  Repeated rows are packed
    one by one (and, being duplicates, apart).  An empty table gives no rows.
    """
    text = F.col(text_col)
    cluster = F.xxhash64(text) if cluster is None else cluster
    columns = [F.col(id_col).cast("long").alias("id"), word_count(text).alias("n"), F.col(source_col).cast("string").alias("source")]
    if clusters is None:
        rows = documents.select(*columns, cluster.alias("cluster"))
    else:
        rows = documents.select(F.monotonically_increasing_id().alias("rid"), *columns).join(clusters, "rid").drop("rid")
    rows = keep(rows, "pieces").withColumn("row", F.monotonically_increasing_id())
    pieces = F.expr(f"sequence(0L, greatest((n + {capacity - 1}) div {capacity} - 1, 0L))")
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(capacity)))
    whole = F.col("length") == capacity
    n = rows.where(~whole & (F.col("length") > 0)).count()
    groups = max(1, -(-n // GROUP))
    # A whole piece fills a bin of its own: numbered by place, after all groups.
    number = F.lit(groups).cast("long") * (1 << 32) + F.monotonically_increasing_id()
    full = keep(rows.where(whole).select("id", "piece", "start", "length", number.alias("bin_id"), F.lit(0).cast("long").alias("offset")), "full")
    none = rows.where("length = 0").select("id", "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(~whole & (F.col("length") > 0)).withColumn("group", F.expr(f"pmod(xxhash64(row, piece), {groups})"))
    packed = rest.groupBy("group").applyInPandas(_packed(capacity, per_source), "id long, piece long, start long, length long, bin_id long, offset long")
    return packed.unionByName(full).unionByName(none)


def near_copies_apart(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """``best_fit`` with the near-duplicate components of ``minhash`` as clusters; equal texts are in one component."""
    documents = settled(documents)
    clusters = minhash.near_duplicates(documents).select("rid", F.col("root").alias("cluster"))
    return best_fit(documents, capacity=capacity, per_source=per_source, clusters=clusters)


def op4(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; near copies are in different ones."""
    found = near_copies_apart(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")
