"""Quality rules: counts of each text, and a hashed n-gram likelihood ratio.

Every text is a bag of its ``GRAM``-byte grams, hashed into ``BUCKETS``.  Two
multinomials are counted: one over the whole corpus (raw), one over trusted
documents (target).  A document's score is the mean over its grams of
log(target / raw), in units of 1/``SCALE`` nat, with whole numbers throughout:
sums don't depend on how rows are batched, so the threshold decides alike on
every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import small_batches

GRAM, BUCKETS, SCALE = 4, 1 << 16, 1024
#: Added to a bucket's count in the target and to what the raw corpus lets expect there.
PSEUDO = 2.0
#: A document passes if its mean log ratio is at least this.
THRESHOLD = -0.4
#: Base rules: too few words; words in repeated three-word windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Ids (a long each) that are sent to all executors; beyond it the join is a shuffle, with the same result.
SENT = 1_000_000

_U = np.uint64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Ratio:
    """log(target / raw) of each bucket in 1/SCALE nat."""

    weights: np.ndarray


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and bucket of every gram that lies inside one text."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(n, dtype=np.uint32)
    for j in range(GRAM):
        word |= raw[j : n + j].astype(np.uint32) << np.uint32(8 * j)
    word *= np.uint32(0x9E3779B1)
    word ^= word >> np.uint32(15)
    word *= np.uint32(0x85EBCA77)
    inside = np.ones(n, dtype=bool)
    for j in range(1, GRAM):  # grams that run into the next text
        cut = offsets[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return at, (word[at] >> np.uint32(32 - 16)).astype(np.int64)


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a run."""
    docs = len(offsets) - 1
    words = _kernel.Words(raw, offsets)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out = {"n_words": words.count.astype(np.int64), "word_chars": per_doc(words.solid & _kernel.lookup("head")[raw]), "n_symbols": per_doc(_kernel.lookup("symbol")[raw])}

    sums = words.sums(lower=False)
    back = _kernel.powers(len(raw) + 1)[1]
    newline = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    start = start[start < len(raw)]
    if len(start):
        end = np.r_[start[1:], len(raw)]
        end = end - (raw[end - 1] == 10)  # without the newline itself
        solid = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(words.solid, out=solid[1:])
        has_word = solid[end] > solid[start]
        start, end = start[has_word], end[has_word]
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = np.sort(_kernel.mix(_kernel.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U)) + _kernel.mix(doc.astype(_U))) if len(start) else np.zeros(0, _U))
    out["n_dup_lines"] = np.zeros(docs, np.int64)
    if len(np.unique(key)) < len(key):
        for d in np.flatnonzero(np.bincount(doc, minlength=docs) > 1):
            own = doc == d
            lines = (sums[end[own]] - sums[start[own]]) * back[start[own]] + (end[own] - start[own]).astype(_U)
            out["n_dup_lines"][d] = len(lines) - len(np.unique(lines))

    repeated = _repeated(words.hashes(lower=False, sums=sums), words.doc)
    out["n_repeat_words"] = np.bincount(words.doc[repeated], minlength=docs).astype(np.int64)
    return out


def _long_counts(raw: np.ndarray) -> dict[str, np.ndarray]:
    """``base_counts`` of one long text, from its segments; what is kept of all of it is a hash per word and per line."""
    total = dict.fromkeys(("n_words", "word_chars", "n_symbols"), 0)
    hashes, lines = [], []
    held, length, solid = 0, 0, 0  # of the line that is not at its end: hash, bytes, bytes of words
    for a, b in _kernel.segments(raw):
        part = raw[a:b]
        words = _kernel.Words(part, np.array([0, len(part)]))
        sums, back = words.sums(lower=False), _kernel.powers(len(part) + 1)[1]
        hashes.append(words.hashes(lower=False, sums=sums))
        total["n_words"] += len(words.start)
        total["word_chars"] += int((words.solid & _kernel.lookup("head")[part]).sum())
        total["n_symbols"] += int(_kernel.lookup("symbol")[part].sum())
        newline = np.flatnonzero(part == 10)
        start, end = np.r_[0, newline + 1], np.r_[newline, len(part)]
        counts = np.r_[0, np.cumsum(words.solid)]
        filled = counts[end] - counts[start]
        line = (sums[end] - sums[start]) * back[start]
        # The first line goes on from the segment before, the last one into the next.
        line[0] = _U((held + int(line[0]) * pow(_kernel.BASE, length, 1 << 64)) & (2**64 - 1))
        size = end - start
        size[0] += length
        filled[0] += solid
        held, length, solid = int(line[-1]), int(size[-1]), int(filled[-1])
        lines.append((line + size.astype(_U))[:-1][filled[:-1] > 0])
    if solid:
        lines.append(np.array([(held + length) & (2**64 - 1)], dtype=_U))
    lines = np.concatenate([np.zeros(0, _U), *lines])
    h = np.concatenate([np.zeros(0, _U), *hashes])
    return {k: np.array([v]) for k, v in total.items()} | {"n_dup_lines": np.array([len(lines) - len(np.unique(lines))]), "n_repeat_words": np.array([_repeated(h, np.zeros(len(h), np.int64)).sum()])}


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words (hashes, with their texts) lie in a three-word window that their text has twice."""
    repeated = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        key = _kernel.mix(h[at] * _kernel.PLACES[0] + h[at + 1] * _kernel.PLACES[1] + h[at + 2] * _kernel.PLACES[2] + _kernel.mix(doc[at].astype(_U)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[np.concatenate([order[1:][same], order[:-1][same]])]
        for j in range(3):
            repeated[twice + j] = True
    return repeated


def _ratio_of(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each text's grams, and their number."""
    at, bucket = buckets(raw, offsets)
    sums = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(weights[bucket], out=sums[1:])
    bounds = np.searchsorted(at, offsets)
    return np.diff(sums[bounds]), np.diff(bounds)


def _gram_parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that have each of its grams once."""
    for lo in range(0, max(len(raw) - GRAM + 1, 0), _kernel.STEP_BYTES):
        yield raw[lo : lo + _kernel.STEP_BYTES + GRAM - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw_counts, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        known = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in _kernel.steps(batch.column(1)):
            at, found = buckets(raw, offsets)
            raw_counts += np.bincount(found, minlength=BUCKETS)
            if known[lo:hi].any():
                doc = np.searchsorted(offsets, at, side="right") - 1
                target += np.bincount(found[known[lo:hi][doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw_counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw_counts[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def fit_ratio(documents: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """Count both multinomials and return their log ratio.

    Both counts are on the scale of the target and get ``PSEUDO`` added, so that
    what is too rare to judge by counts for nothing, in small corpora as in large.
    ``trusted`` has the ids (first column) of trusted documents.  The raw counts
    cover every document and the target's every trusted one, marked by a join on
    the id and counted in the same pass; the driver gets one row for each of
    ``BUCKETS``.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("known", F.lit(True))
    # Texts are only shuffled where the ids are too many to be sent along.
    ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("shuffle_hash")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows without an id are not dealt out: they would all go to one task.
    marked = rows.where("id IS NOT NULL").join(ids, "id", "left").select(F.coalesce("known", F.lit(False)).alias("known"), "text")
    marked = marked.unionByName(rows.where("id IS NULL").select(F.lit(False).alias("known"), "text"))
    small_batches(documents.sparkSession)
    found = marked.mapInArrow(_count, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():  # without trusted text nothing can be told apart
        return Ratio(np.zeros(BUCKETS, np.int64))
    expected = raw * (target.sum() / raw.sum())
    return Ratio(np.round(SCALE * np.log((target + PSEUDO) / (expected + PSEUDO))).astype(np.int64))


def _judged(ratio: Ratio, threshold: float, keep_only: bool, text_col: str):
    cut = round(threshold * SCALE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = {k: np.zeros(n, np.int64) for k in COUNTS}
            total, grams = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, raw, offsets in _kernel.steps(batch.column(batch.schema.get_field_index(text_col))):
                long = _kernel.is_long(raw, offsets)
                for k, v in (_long_counts(raw) if long else base_counts(raw, offsets)).items():
                    found[k][lo:hi] = v
                for part in _gram_parts(raw) if long else [raw]:
                    score, n_grams = _ratio_of(part, np.array([0, len(part)]) if long else offsets, ratio.weights)
                    total[lo:hi] += score
                    grams[lo:hi] += n_grams
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
            kept = ~failed & (total >= cut * grams)
            if keep_only:
                yield batch.filter(pa.array(kept))
            else:
                score = total / np.maximum(grams, 1) / SCALE
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], names=["id", *COUNTS, "base_failed", "kept", "llr"])

    return run


def judge(documents: DataFrame, ratio: Ratio, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, the mean log ratio and the verdict of every row: ``id``, ``COUNTS``, ``base_failed``, ``kept``, ``llr``.

    Null and empty texts have zero counts and fail the base rules.  Repeated
    rows get equal rows.  Other columns are not read.
    """
    schema = "id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, llr double"
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_judged(ratio, threshold, False, "text"), schema)


def keep_good(documents: DataFrame, ratio: Ratio, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns, in one pass without a shuffle."""
    small_batches(documents.sparkSession)
    return documents.mapInArrow(_judged(ratio, threshold, True, text_col), documents.schema)


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """Documents that a person has marked as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op7(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judge(documents, fit_ratio(documents, trusted_ids(spark, sf_dir)))
    return found.withColumnRenamed("id", "doc_id")
