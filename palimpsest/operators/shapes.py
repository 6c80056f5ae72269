"""URL shapes: where in a site's paths the values are and where the structure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls

#: A position holds values if it has more distinct ones than this, and than this share of its uses.
FLOOR, RATIO = 8, 0.05
#: A position with so many distinct values holds values anyway, and of more positions than that the first count.
MOST_VALUES, MOST_NODES = 2000, 50_000


def _normal(segment):
    return F.when(urls.numberish(segment), "#").otherwise(F.lower(segment))


def nodes(paths: DataFrame, most_values: int = MOST_VALUES, most_nodes: int = MOST_NODES) -> DataFrame:
    """Positions in the paths of a site: ``prefix`` (as text), ``uses``, ``values`` (distinct ones, ``most_values`` at most).

    ``paths``: ``k`` (order) and ``norm`` (segments).  Tasks keep a bounded set of
    values for each prefix, so what is shuffled does not grow with the number of
    values; the sets' union is cut at the same bound.  Of more than
    ``most_nodes`` positions, those that come first stay (by the first row, then
    by depth); a position is there only with the one above it.
    """
    kind = paths.schema["k"].dataType.simpleString()
    schema = f"prefix string, uses long, first {kind}, depth int, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list] = {}
        order = None

        def out() -> pa.RecordBatch:
            rows = [(prefix, uses if i == 0 else 0, first, depth, value) for (depth, prefix), (uses, first, values) in seen.items() for i, value in enumerate(values)]
            types = [pa.string(), pa.int64(), order, pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["prefix", "uses", "first", "depth", "value"])

        for batch in batches:
            order = batch.column(0).type
            for k, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for depth, value in enumerate(norm or ()):
                    node = seen.setdefault((depth, "/".join(norm[:depth])), [0, k, set()])
                    node[0] += 1
                    if node[1] is None or k is not None and k < node[1]:
                        node[1] = k
                    if len(node[2]) < most_values:
                        node[2].add(value)
            if len(seen) > most_nodes:  # more come in the next part
                yield out()
                seen = {}
        if seen:
            yield out()

    parts = paths.select("k", "norm").mapInArrow(run, schema)
    each = parts.groupBy("prefix", "value").agg(F.sum("uses").alias("uses"), F.min(F.struct("first", "depth")).alias("first"))
    found = each.groupBy("prefix").agg(F.sum("uses").alias("uses"), F.least(F.count("*"), F.lit(most_values)).alias("values"), F.min("first").alias("first"))
    return found.orderBy("first", "prefix").limit(most_nodes).drop("first")


def shaped(rows: DataFrame, url: str = "url", key: str = "id", most_values: int = MOST_VALUES, most_nodes: int = MOST_NODES) -> DataFrame:
    """``rows`` (``key``, ``url``) with ``shape``: varying path parts replaced, query keys kept.

    Two passes: positions are counted by their prefix, then each row's positions
    look up whether theirs is one that does not vary.  Those are ``most_nodes``
    at most, so the look-up is a broadcast and no prefix, the root's neither, is
    a key that all rows share.
    """
    base = rows.select(F.col(key).alias("k"), F.col(url).alias("u")).withColumn("raw", urls.segments(F.col("u")))
    base = base.withColumn("norm", F.transform("raw", _normal))
    prefix = lambda i: F.array_join(F.slice(F.col("norm"), F.lit(1), i), "/")
    places = F.transform(F.col("norm"), lambda x, i: F.struct(i.alias("i"), prefix(i).alias("prefix"), x.alias("norm"), F.get(F.col("raw"), i).alias("raw")))
    flat = base.select("k", F.explode(places).alias("p")).select("k", "p.*")
    varies = (F.col("values") >= most_values) | (F.col("values") > FLOOR) & (F.col("values") > F.col("uses") * RATIO)
    fixed = nodes(base, most_values, most_nodes).where(~varies).select("prefix", F.lit(False).alias("varies"))
    seen = flat.join(F.broadcast(fixed), "prefix", "left").withColumn("varies", F.coalesce("varies", F.lit(True)))  # most_nodes rows at most
    ext = urls.extension(F.col("raw"))
    shown = F.when(F.col("norm") == "#", "#").when(~F.col("varies"), F.col("norm")).when(ext != "", F.concat(F.lit("*."), ext)).otherwise("*")
    paths = seen.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))), lambda x: x["s"]), "/").alias("path"))
    keys = F.array_join(urls.query_keys(F.col("u")), "&")
    whole = F.concat(F.lit("/"), F.coalesce("path", F.lit("")), F.when(keys != "", F.concat(F.lit("?"), keys)).otherwise(""))
    return base.select("k", "u").join(paths, "k", "left").select(F.col("k").alias(key), F.col("u").alias(url), whole.alias("shape"))


def summary(shapes: DataFrame, size: str | None = None, limit: int = 30, key: str = "id", url: str = "url") -> DataFrame:
    """Shapes by count, most frequent first: ``shape``, ``n``, ``bytes``, ``example`` (the first row's URL)."""
    amount = F.sum(F.coalesce(F.col(size), F.lit(0))) if size else F.lit(0)
    out = shapes.groupBy("shape").agg(F.count("*").alias("n"), amount.cast("long").alias("bytes"), F.min_by(url, key).alias("example"))
    return out.orderBy(F.desc("n"), "shape").limit(limit)
