"""Exact top-k inner products over vectors in buckets of similar length.

Vectors are grouped by length into buckets of bounded size.  A query starts
with a lower bound for its k-th best score, taken from a bounded set of the
longest vectors; divided by its own length, this is the length that a vector
must have to matter.  Queries of similar need make blocks of bounded size, and
a bucket meets only the blocks that it can reach.  There, the bound divided by
the query's length and by the longest in the bucket gives the cosine that a
vector of that bucket must reach:

* above 1, the bucket has nothing for the query;
* high, coordinate pruning: a vector with that cosine has its coordinates in an
  interval around the query's, checked on the query's largest coordinates;
* otherwise length pruning: the bucket is sorted by length and only a prefix can
  reach the bound.

What is left is verified by its product, in whole numbers.  The result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._scratch import keep

K, BUCKET, BLOCK, PROBE = 20, 32768, 16384, 2048
#: Local cosine from which coordinates prune better than lengths; coordinates looked at.
COORDINATE_FROM, FOCUS = 0.85, 4
#: Share by which bounds are lowered, as lengths and first products are rounded.
SLACK = 1e-9
#: Floats hold whole numbers below this one by one.
SURE = 2.0**53
LONG = 2**63


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten()
    return flat.to_numpy().reshape(n, -1) if n and len(flat) else np.zeros((n, 0))


def _length(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without running over."""
    most = np.abs(v).max(axis=1, initial=0)
    return most * np.sqrt(((v / np.maximum(most, 1)[:, None]) ** 2).sum(axis=1))


def _exact(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Products of one query with some vectors in whole numbers of any size."""
    x = [int(a) for a in q]
    return [sum(a * int(b) for a, b in zip(x, row, strict=True)) for row in v]


def _text(score: int) -> str | None:
    """Whole numbers that a long can't hold, in the order of their values; ``1`` stands for what it can."""
    if -LONG <= score < LONG:
        return None
    return f"2{score:0700d}" if score > 0 else f"0{10**700 + score:0700d}"


def _bounded(probe: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds to each query its length and a lower bound of its k-th score."""

    def run(batches):
        for batch in batches:
            least, length = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                q = _matrix(batch.column(1).take(pa.array(own)))
                length[own] = _length(q)
                rows, vectors = probe.get(int(dim), (None, None))
                if rows is None or len(rows) <= k:
                    continue
                row_of, far = batch.column(0).to_numpy()[own], _length(vectors).max()
                for lo in range(0, len(own), 256):
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = q[lo : lo + 256] @ vectors.T
                    scores[rows[None, :] == row_of[lo : lo + 256, None]] = -np.inf
                    kth = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
                    kth = kth - SLACK * length[own[lo : lo + 256]] * far
                    least[own[lo : lo + 256]] = np.where(np.isfinite(kth), kth, -np.inf)
            need = np.where(length > 0, np.divide(least, length, out=np.full(len(least), -np.inf), where=length > 0), np.where(least > 0, np.inf, -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(least), pa.array(np.maximum(need, 0.0))], names=["row", "q", "dim", "length", "least", "need"])

    return run


def _retrieve(k: int):
    """The best of a bucket's part for each query of a block: scores as longs, and as text where those are too small."""

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("more", pa.string())])
        if queries.num_rows == 0 or vectors.num_rows == 0:
            return schema.empty_table()
        rows, ids, v = vectors.column("row").to_numpy(), vectors.column("id").to_numpy(), _matrix(vectors.column("v"))
        lengths = _length(v)
        order = np.lexsort((ids, -lengths))
        rows, ids, v, lengths = rows[order], ids[order], v[order], lengths[order]
        most = np.abs(v).max(axis=1, initial=0)
        unit = v / np.maximum(lengths, 1e-300)[:, None]
        own, q = queries.column("row").to_numpy(), _matrix(queries.column("q"))
        length, least = queries.column("length").to_numpy(), queries.column("least").to_numpy()
        out: list[list] = [[], [], [], []]

        def add(i: int, at: np.ndarray, scores: np.ndarray) -> None:
            good = rows[at] != own[i]
            at, scores = at[good], scores[good]
            big = most[at] * np.abs(q[i]).max(initial=0) * max(1, v.shape[1]) >= SURE
            error = SLACK * length[i] * lengths[at] if big.any() else 0.0
            good = ~(scores + error < least[i])
            if good.sum() > k:
                low = np.where(np.isfinite(scores), scores - error, -np.inf)
                good &= ~(scores + error < np.partition(low, len(low) - k)[len(low) - k])
            at, scores, big = at[good], scores[good], big[good]
            if big.any():
                exact = _exact(q[i], v[at])
                best = sorted(range(len(at)), key=lambda j: (-exact[j], ids[at[j]]))[:k]
                out[2] += [max(-LONG, min(LONG - 1, exact[j])) for j in best]
                out[3] += [_text(exact[j]) for j in best]
            else:
                best = np.lexsort((ids[at], -scores))[:k]
                out[2] += scores[best].astype(np.int64).tolist()
                out[3] += [None] * len(best)
            out[0] += [own[i]] * len(best)
            out[1] += ids[at][best].tolist()

        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            local = least / (length * lengths[0])  # the cosine that this bucket must reach
            by_length = []
            for i in range(len(own)):
                if local[i] > 1 + SLACK:
                    continue
                if v.shape[1] and COORDINATE_FROM <= local[i] <= 1:
                    at = np.arange(len(ids))
                    x = q[i] / length[i]
                    for f in np.argsort(-np.abs(x), kind="stable")[:FOCUS]:
                        half = np.sqrt(max(0.0, (1 - x[f] ** 2) * (1 - local[i] ** 2))) + SLACK
                        high = 1.0 if x[f] >= local[i] else x[f] * local[i] + half
                        low = -1.0 if x[f] <= -local[i] else x[f] * local[i] - half
                        at = at[(unit[at, f] >= low - SLACK) & (unit[at, f] <= high + SLACK)]
                    add(i, at, v[at] @ q[i])
                else:
                    by_length.append(i)
            for lo in range(0, len(by_length), 64):
                some = np.array(by_length[lo : lo + 64])
                need = np.where((least[some] > 0) & (length[some] > 0), least[some] / length[some] * (1 - SLACK), -np.inf)
                reach = np.searchsorted(-lengths, -need, side="right")
                scores = q[some] @ v[: reach.max()].T
                for i, n, row in zip(some, reach, scores, strict=True):
                    add(i, np.arange(n), row[:n])
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], schema=schema)

    return run


def _cut_by(rows: DataFrame, column: str, n: int, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name`` (a range of ``column``) and ``part``; a row per ``dim`` and range with its ``least`` and ``most`` of the column.

    A range that holds many more than ``size`` rows, as where they tie, has several parts.
    """
    steps = max(1, -(-n // size))
    cuts = rows.agg(F.percentile_approx(column, [i / steps for i in range(1, steps)], 10 * steps)).first()[0] if steps > 1 else []
    cuts = sorted(set(cuts or []))
    places = F.from_json(F.lit("[" + ",".join(map(repr, cuts)) + "]"), F.lit("array<double>"))
    rows = rows.withColumn(name, F.size(F.filter(places, lambda c: c < F.col(column))))
    per = rows.groupBy("dim", name).agg(F.min(column).alias(f"least_{name}"), F.max(column).alias(f"most_{name}"), F.ceil(F.count("*") / size).cast("int").alias(f"{name}_parts"))
    return rows, keep(per, name)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """``query_id``, ``query_row``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` best products of each query.

    The rows of ``vectors`` where ``is_query`` holds are the queries, each row
    one (``query_row`` tells those of one id apart); candidates are all rows but
    the query's own, whatever their ids.  Vectors are arrays of whole numbers
    (of any numeric type) and are compared with those of the same size.  Rows
    without an id or vector take no part.  Ties go to the smaller id.  Fewer than
    ``k`` candidates are all returned; without queries or candidates there are
    no rows.  Ranks go by exact scores; a score that a long can't hold is given as
    the nearest one that it can.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = keep(given.where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    squares, most = "aggregate(v, 0D, (s, x) -> s + x * x)", "aggregate(v, 1D, (m, x) -> greatest(m, abs(x)))"
    scaled = f"aggregate(transform(array({most}), m -> m * sqrt(aggregate(v, 0D, (s, x) -> s + x / m * x / m))), 0D, (a, x) -> a + x)"
    length = F.expr(f"IF({squares} < 1e300, sqrt({squares}), {scaled})")
    rows = given.select(F.monotonically_increasing_id().alias("row"), "id", "asks", "v", F.size("v").alias("dim"))
    rows = keep(rows.withColumn("length", length), "numbered")

    # A bound to begin with: the longest vectors, PROBE of them whatever the input.
    longest = rows.orderBy(F.desc("length"), "id", "row").select("row", "v", "dim").limit(PROBE).toArrow()
    probe: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    dims = longest.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = longest.filter(pa.array(dims == dim))
        probe[int(dim)] = (part.column("row").to_numpy(), _matrix(part.column("v")))
    asked = rows.where("asks").select("row", F.col("v").alias("q"), "dim")
    asked = keep(asked.mapInArrow(_bounded(probe, k), "row long, q array<double>, dim int, length double, least double, need double"), "queries")

    held, buckets = _cut_by(rows, "length", rows.count(), BUCKET, "bucket")
    asked, blocks = _cut_by(asked, "need", asked.count(), BLOCK, "block")
    # Which part of a bucket meets which part of a block: a row for each task of the search.
    meet = buckets.select("dim", "bucket", F.col("most_bucket"), "bucket_parts").join(blocks.select("dim", "block", "least_block", "block_parts"), "dim")
    meet = meet.where(F.col("most_bucket") * (1 + SLACK) >= F.col("least_block"))
    meet = meet.withColumn("part", F.explode(F.expr("sequence(0, bucket_parts - 1)"))).withColumn("share", F.explode(F.expr("sequence(0, block_parts - 1)")))
    meet = keep(meet.select("dim", "bucket", "part", "block", "share"), "meet")
    parts = buckets.select("dim", "bucket", "bucket_parts")
    held = held.join(parts, ["dim", "bucket"]).withColumn("part", F.expr("CAST(pmod(xxhash64(row), bucket_parts) AS INT)"))
    shares = blocks.select("dim", "block", "block_parts")
    asked = asked.join(shares, ["dim", "block"]).withColumn("share", F.expr("CAST(pmod(xxhash64(row), block_parts) AS INT)"))
    cell = ["dim", "bucket", "part", "block", "share"]
    to = asked.join(meet, ["dim", "block", "share"]).select(*cell, "row", "q", "length", "least")
    dealt = held.join(meet, ["dim", "bucket", "part"]).select(*cell, "row", "id", "v")
    found = to.groupBy(*cell).cogroup(dealt.groupBy(*cell)).applyInArrow(_retrieve(k), "row long, vec_id long, score long, more string")
    rank = F.expr("row_number() OVER (PARTITION BY row ORDER BY score DESC, coalesce(more, '1') DESC, vec_id)")
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    names = rows.where("asks").select("row", F.col("id").alias("query_id"))
    return best.join(names, "row").select("query_id", F.col("row").alias("query_row"), "rank", "vec_id", "score")


def whole_numbers(embedding: str = "embedding") -> Column:
    """floor(64 * x) of each component; null for a vector that is null or has a null or non-finite component."""
    good = F.expr(f"{embedding} IS NOT NULL AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    # floor() of a double is a long in Spark; what a long can't hold is a whole number anyway.
    return F.when(good, F.expr(f"transform({embedding}, x -> IF(abs(64D * CAST(x AS DOUBLE)) < 9007199254740992D, CAST(floor(64D * CAST(x AS DOUBLE)) AS DOUBLE), 64D * CAST(x AS DOUBLE)))"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The 20 best matches of every 20th vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), whole_numbers().alias("v"))
    return exact_top_k(rows, F.col("id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM r WHERE rank <= 20
"""
