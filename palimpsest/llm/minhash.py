"""Near-duplicate documents by a MinHash signature and an inverted join over its coordinates.

Each document's set of 5-word shingles has a signature of ``COORDINATES``
minima.  Documents are posted under each (coordinate, value) pair.  Of two
documents with Jaccard similarity s a coordinate agrees with chance s, so that
linked pairs (s >= 0.75) agree in at least ``MATCHES`` coordinates but for a
chance of four in a million at most.

* Prefix merging: two signatures that agree in MATCHES coordinates share one
  of the ``COORDINATES - MATCHES + 1`` rarest pairs of either.  Only those are
  posted; pairs that one document alone has take up places of the prefix but
  need no posting, so documents without relatives drop out here, and a passage
  that very many documents share is not in the prefix of any of them.
* Skip merging: each posting list is first counted against one document
  alone.  Confirmed links make components; a list inside one component is
  skipped.  Of the others the largest component is laid out in blocks, once,
  and only what is not in it goes on to meet those blocks and each other.
* Pairs above the match threshold are confirmed on the full shingle sets.

Equal sets are one class from the start and are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import keep, rows_with_id, settled
from palimpsest.llm.components import connected_components

COORDINATES, MATCHES = 48, 22
SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bits of a parity sketch; documents of a posting list that are compared in one step.
SKETCH, BLOCK = 2048, 512

_U = np.uint64


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = _kernel.mix(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (seeds[:COORDINATES] | _U(1))[:, None], seeds[COORDINATES:][:, None]


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """``COORDINATES`` minima, 32 bits each, of a non-empty set of hashes."""
    a, b = _coefficients()
    best = None
    for lo in range(0, len(shingle_set), 4096):
        part = shingle_set[lo : lo + 4096][None, :] * a + b
        part ^= part >> _U(32)
        part *= _U(0xD6E8FEB86659FD93)
        low = part.min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return (best >> _U(32)).astype(np.uint32).view(np.int32)


def _signed(column: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            n = batch.num_rows
            size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
            signatures = np.zeros((n, COORDINATES), np.int32)
            for row, found in _kernel.shingle_sets(texts, SHINGLE):
                size[row] = len(found)
                if len(found):
                    f1[row], f2[row] = found.sum(dtype=_U), np.bitwise_xor.reduce(_kernel.mix(found))
                    signatures[row] = signature(found)
            flat = pa.array(signatures.reshape(-1))
            ends = pa.array(np.arange(0, n * COORDINATES + 1, COORDINATES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(ends, flat)],
                names=["rid", "id", "n", "f1", "f2", "sig"],
            )

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough."""
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        left, right = batch.column(batch.schema.get_field_index("text_a")), batch.column(batch.schema.get_field_index("text_b"))
        lo = 0
        while lo < batch.num_rows:  # a few pairs at a time: sets take more room than texts
            hi = min(lo + 256, batch.num_rows)
            for (row, x), (_, y) in zip(_kernel.shingle_sets(left.slice(lo, hi - lo), SHINGLE), _kernel.shingle_sets(right.slice(lo, hi - lo), SHINGLE), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[lo + row] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            lo = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and parity sketch of each shingle set: bit i says if an odd number of hashes fall to place i."""
    for batch in batches:
        sizes, bits = [], []
        for _, found in _kernel.shingle_sets(batch.column(1), SHINGLE):
            odd = np.bincount((found & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
            sizes.append(len(found))
            bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["rid", "n", "bits"])


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list block that lie in two components and that size and sketch can't rule out.

    100 i >= 75 u means that the sets differ in at most (n_a + n_b) / 7 shingles;
    sketches differ in no more places than the sets in shingles.  So no link is lost.
    """

    def flush(rows: list) -> pa.RecordBatch:
        side, rid, root, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (4, 5, 6, 7))
        bits = np.frombuffer(b"".join(r[8] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        one_block = not rows[0][1] and rows[0][2] == rows[0][3]
        out = []
        for i in np.flatnonzero(side == 0) if not one_block else range(len(rows)):
            far = root != root[i] if one_block else (root != root[i]) & (side == 1)
            far &= (4 * n >= 3 * n[i]) & (4 * n[i] >= 3 * n)
            at = np.flatnonzero(far)
            apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            at = at[7 * apart <= n[at] + n[i]]
            out.append(np.stack([np.minimum(rid[i], rid[at]), np.maximum(rid[i], rid[at])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if held and row[:4] != held[0][:4]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _agree(x: str, y: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> IF(p = q, 1, 0)), 0, (s, v) -> s + v)")


def _confirmed(pairs: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (``a``, ``b``) those with MATCHES equal coordinates whose full sets are similar."""
    sa = signatures.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a"))
    sb = signatures.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b"))
    near = keep(pairs.join(sa, "a").join(sb, "b").where(_agree("sig_a", "sig_b") >= MATCHES).select("a", "b"), "near")
    ta = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    both = near.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return keep(both.mapInArrow(_confirm, "a long, b long"), "links")


def _dealt(lists: DataFrame) -> DataFrame:
    """The rows of lists (``token``, ``rid``, ``root``) in cells (``token``, ``main``, ``x``, ``y``) of at most about two blocks.

    Each pair of a list that crosses components meets in one cell, on different
    ``side``s unless the cell is of one block.  The largest component of a list
    has one copy of each member for each block of the others (mostly one); the
    others have a copy for each block of it and of their own.
    """
    of_root = lists.groupBy("token", "root").agg(F.count("*").alias("n"))
    blocks = of_root.groupBy("token").agg(F.max(F.struct("n", -F.col("root"))).alias("top"), F.sum("n").alias("n"))
    blocks = blocks.select("token", (-F.col("top.col2")).alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("of_main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("of_rest"))
    rows = lists.join(keep(blocks, "blocks"), "token")
    main = rows.where("root = top").withColumn("x", F.expr("CAST(pmod(xxhash64(rid), of_main) AS INT)")).withColumn("y", F.explode(F.expr("sequence(0, of_rest - 1)")))
    rest = rows.where("root <> top").withColumn("own", F.expr("CAST(pmod(xxhash64(rid), of_rest) AS INT)"))
    to_main = rest.withColumn("x", F.explode(F.expr("sequence(0, of_main - 1)"))).withColumn("y", F.col("own"))
    to_rest = rest.withColumn("other", F.explode(F.expr("sequence(0, of_rest - 1)"))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    out = main.select("token", F.lit(True).alias("main"), "x", "y", F.lit(1).alias("side"), "rid", "root")
    out = out.unionByName(to_main.select("token", F.lit(True).alias("main"), "x", "y", F.lit(0).alias("side"), "rid", "root"))
    return out.unionByName(to_rest.select("token", F.lit(False).alias("main"), "x", "y", F.when(F.col("own") == F.col("x"), 0).otherwise(1).alias("side"), "rid", "root"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``rid``, ``id``, ``n_shingles``, ``component`` and ``root`` (a rid of the component).

    ``rid`` numbers the rows of ``settled(documents)``.

    ``component`` is the smallest id of the component; a row without words is
    alone in its own, and so is a row whose id is null and that has no links
    (component null).  Repeated ids are separate rows; rows with equal sets are
    linked, whatever their ids.  A null text is an empty one.  Other columns of
    ``documents`` are not read, so their names can't clash.  An empty table
    gives an empty result.
    """
    documents = settled(documents)
    source = rows_with_id(documents, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = documents.sparkSession
    signed = keep(source.mapInArrow(_signed(), "rid long, id long, n long, f1 long, f2 long, sig array<int>"), "signed", scan=True)

    # Classes of equal sets; the member with the smallest rid speaks for each.
    classes = keep(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("rid").alias("rep")), "classes")
    heads = signed.join(classes.select(F.col("rep").alias("rid")), "rid").select("rid", "sig")
    heads = keep(heads, "heads")

    # Postings: the rare part of each signature that another class has too.
    pairs_of = heads.select("rid", F.posexplode("sig").alias("k", "v")).select("rid", F.expr("shiftleft(CAST(k AS LONG), 32) | (CAST(v AS LONG) & 4294967295L)").alias("token"))
    shared = keep(pairs_of.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    prefix = F.expr(f"slice(array_sort(collect_list(struct(df, token))), 1, greatest(count(*) - {MATCHES - 1}, 0))")
    posted = pairs_of.join(shared, "token").groupBy("rid").agg(prefix.alias("p"), F.sum("df").alias("rank")).where(F.size("p") > 0)
    posted = keep(posted.select("rid", "rank", F.explode("p").alias("p")).select("rid", "rank", "p.token"), "posted")

    # A document can only be linked if one of its lists has another document in it.  The hub of a list is
    # the document whose pairs are the most common: what near copies have in common, it has.
    lists = posted.groupBy("token").agg(F.max(F.struct("rank", -F.col("rid"))).alias("top"), F.count("*").alias("m")).where("m > 1")
    lists = keep(lists.select("token", (-F.col("top.col2")).alias("hub"), "m"), "lists")
    starred = posted.join(lists, "token").select("token", "rid", "hub", "m")
    first = keep(starred.where("rid <> hub").select(F.least("hub", "rid").alias("a"), F.greatest("hub", "rid").alias("b")).distinct(), "stars")
    involved = first.select(F.col("a").alias("rid")).union(first.select("b")).distinct()
    texts = keep(source.select("rid", "text").join(involved.hint("shuffle_hash"), "rid"), "texts")
    signatures = heads.join(texts.select("rid"), "rid", "left_semi")
    signatures = keep(signatures, "involved")
    links = _confirmed(first, signatures, texts)

    # What crosses components in a list, without its hub, which has met every member.
    roots = connected_components(links)
    placed = starred.join(roots.select(F.col("v").alias("rid"), "root"), "rid", "left").select("token", "rid", "hub", "m", F.coalesce("root", "rid").alias("root"))
    placed = keep(placed.where("m > 2 AND rid <> hub"), "placed")
    spread = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_lists = keep(placed.join(spread.select("token"), "token").select("token", "rid", "root"), "open")
    sketches = texts.join(open_lists.select("rid").distinct().hint("shuffle_hash"), "rid").select("rid", "text").mapInArrow(_sketched, "rid long, n long, bits binary")
    sketches = keep(sketches, "sketches")
    dealt = _dealt(open_lists).join(sketches, "rid").select("token", "main", "x", "y", "side", "rid", "root", "n", "bits")
    crossing = dealt.repartition("token", "main", "x", "y").sortWithinPartitions("token", "main", "x", "y").mapInArrow(_crossing, "a long, b long").distinct()
    crossing = keep(crossing.join(first, ["a", "b"], "left_anti"), "crossing")
    if not crossing.isEmpty():
        more = _confirmed(crossing, signatures, texts)
        if not more.isEmpty():
            roots = connected_components(links.union(more))

    # From classes back to rows; ids take the place of rids at the end.
    grouped = classes.join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("root"))
    grouped = keep(grouped, "grouped")
    member = keep(signed.select("rid", "id", "n", "f1", "f2").join(grouped, ["n", "f1", "f2"], "left").select("rid", "id", "n", F.coalesce("root", "rid").alias("root")), "member")
    named = keep(member.groupBy("root").agg(F.min("id").alias("component")), "named")
    return member.join(named, "root").select("rid", "id", F.col("n").alias("n_shingles"), "component", "root")


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid`` of the row that stands for each component: smallest id (null last), then first of its rows.

    ``rid`` is ``monotonically_increasing_id`` on ``documents``, which must be ``settled``.
    """
    found = near_duplicates(documents, id_col, text_col)
    order = F.struct(F.col("id").isNull(), "id", "rid")
    best = found.where(F.col("id").eqNullSafe(F.col("component"))).select("root", "rid", order.alias("o"))
    return best.groupBy("root").agg(F.min("o").alias("o")).select("o.rid")


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document with its component; ``kept`` marks the document that stands for it."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
