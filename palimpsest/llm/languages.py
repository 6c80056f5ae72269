"""Language of a text: its family first, then the language within the family.

A text is a bag of byte n-grams (1 to 4 bytes, lower case, everything in ASCII
but letters a space, and spaces only at their ends), hashed; the root of each
count, all of a text at length 1.
Linear support vector machines, one for each two classes, tell the families
apart, and within each family one for each two of its languages.  The class
with most pairs in its favour wins (ties: the greater sum of chances, then the
first by name).  A margin becomes a chance by a sigmoid whose slope is fitted
on the sample; ``score`` is the family's mean chance against the others times
the language's.

The fit uses at most ``SAMPLE`` texts, the same number of each language; of
their n-grams, counted in the executors, the ``FEATURES`` that differ most
between languages are used.  Scoring uses every row and the whole of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import keep, small_batches

#: Texts that fit the models, at most (two of each language in any case), and at most so many of one language.
SAMPLE, OF_LANGUAGE = 4000, 1000
SIZES = (1, 2, 3, 4)
BUCKET_BITS, FEATURES = 18, 4096
#: Texts whose counts are one matrix.
STEP_TEXTS = 256
UNKNOWN = "und"

#: Families of languages (ISO 639-1 codes).  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps sd si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "ceb id jv mg mi ms su tl",
}
_FAMILY = {language: family for family, listed in FAMILIES.items() for language in listed.split()}

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_KEPT = np.arange(256, dtype=np.uint8)
_KEPT[:128][~(((_KEPT[:128] >= 65) & (_KEPT[:128] <= 90)) | ((_KEPT[:128] >= 97) & (_KEPT[:128] <= 122)))] = 0x20


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], f"{language} alone")


def grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams of every text, one size at a time; a space stands before and after each text."""
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(count)), count)
    text = np.full(len(raw) + len(count) + 1, 0x20, dtype=np.uint32)
    text[np.arange(len(raw)) + doc + 1] = _KEPT[raw]
    of = np.repeat(np.arange(len(count)), count + 1)  # by place: the space before a text is its own, that after it the next one's
    last = np.repeat(offsets[1:] + np.arange(len(count)) + 1, count + 1)
    place = np.arange(len(of))
    code = np.zeros(len(text), dtype=np.uint32)
    blank = text == 0x20
    for size in SIZES:
        code[: len(text) - size + 1] = (code[: len(text) - size + 1] << np.uint32(8)) | text[size - 1 :]
        fine = place + size - 1 <= last
        if size < 3:
            fine &= ~blank[:-1] | (~blank[1:] if size > 1 else False)
        for inner in range(1, size - 1):
            fine[: len(fine) - inner] &= ~blank[inner:-1]
        at = np.flatnonzero(fine)
        yield of[at], ((code[at] + np.uint32(size)) * _ODD[size - 1] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _parts(column) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, parts) of up to ``STEP_TEXTS`` texts; a long text is in several parts."""
    for lo, hi, raw, offsets in _kernel.steps(column):
        if _kernel.is_long(raw, offsets):
            yield lo, hi, [(raw[a:b], np.array([0, b - a])) for a, b in _kernel.segments(raw)]
            continue
        for a in range(0, hi - lo, STEP_TEXTS):
            b = min(a + STEP_TEXTS, hi - lo)
            yield lo + a, lo + b, [(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's share of a language's texts, summed up, in millionths of a text's n-grams."""
    for batch in batches:
        languages = batch.column(1).to_pylist()
        names = sorted(set(languages))
        number = np.array([names.index(x) for x in languages])
        total = np.zeros(0, np.int64)
        keys = np.zeros(0, np.int64)
        for lo, hi, parts in _parts(batch.column(2)):
            found = [np.concatenate(x) for x in zip(*(g for part in parts for g in grams(*part)), strict=True)]
            key, n = np.unique((found[0] << BUCKET_BITS) | found[1], return_counts=True)
            doc = key >> BUCKET_BITS
            all_ = np.bincount(doc, n, minlength=hi - lo)
            share = (1_000_000 * n / all_[doc]).astype(np.int64)
            keys = np.append(keys, (number[lo + doc] << BUCKET_BITS) | (key & ((1 << BUCKET_BITS) - 1)))
            total = np.append(total, share)
        key, back = np.unique(keys, return_inverse=True)
        sums = np.bincount(back, total, minlength=len(key)).astype(np.int64)
        named = pa.array(names, pa.string()).take(pa.array(key >> BUCKET_BITS))
        yield pa.RecordBatch.from_arrays([named, pa.array((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)), pa.array(sums)], names=["lang", "h", "share"])


def _places(chosen: np.ndarray) -> np.ndarray:
    """Column of each bucket, -1 for those not chosen."""
    out = np.full(1 << BUCKET_BITS, -1, dtype=np.int64)
    out[chosen] = np.arange(len(chosen))
    return out


def _vectors(column, place: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix): a row of length 1 for each text, zeros where it has no chosen n-gram."""
    for lo, hi, parts in _parts(column):
        n = np.zeros((hi - lo) * width)
        for part in parts:
            for doc, h in grams(*part):
                col = place[h]
                some = np.flatnonzero(col >= 0)
                n += np.bincount(doc[some] * width + col[some], minlength=len(n))
        x = np.sqrt(n.reshape(hi - lo, width)).astype(np.float32)
        yield lo, hi, x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)


def _sample_vectors(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(chosen)
        for batch in batches:
            for lo, hi, x in _vectors(batch.column(2), place, len(chosen)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    return run


def support_vector(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine for y in {-1, 1}: squared hinge loss, both classes with the same weight, accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    last, step, v, c = (w, b), 1 / (4 + decay), w, b
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ v + c))
        pull = 2 * weight * y * slack
        w, b = v + step * (x.T @ pull - decay * v), c + step * float(pull.sum())
        speed = (t - 1) / (t + 2)
        v, c = w + speed * (w - last[0]), b + speed * (b - last[1])
        last = w, b
    return w, b


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the sigmoid that makes the sample's classes likeliest; targets are kept off 0 and 1, so that it stays finite."""
    right = margin * y
    target = (len(y) + 1) / (len(y) + 2)
    low, high = 0.1, 20.0
    for _ in range(40):
        mid = (low + high) / 2
        chance = 1 / (1 + np.exp(-np.clip(mid * right, -50, 50)))
        low, high = (mid, high) if ((target - chance) * right).sum() > 0 else (low, mid)
    return low


@dataclass(frozen=True)
class Pairwise:
    """A machine for each two classes: weights (feature x pair), intercepts and slopes; ``pairs`` are places in ``classes``."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    intercepts: np.ndarray
    slopes: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, names: np.ndarray) -> Pairwise:
        classes = sorted(set(names.tolist()))
        pairs = [(i, j) for i in range(len(classes)) for j in range(i)]
        weights, intercepts, slopes = np.zeros((x.shape[1], len(pairs)), np.float32), np.zeros(len(pairs)), np.zeros(len(pairs))
        for k, (i, j) in enumerate(pairs):
            rows = np.flatnonzero((names == classes[i]) | (names == classes[j]))
            y = np.where(names[rows] == classes[i], 1, -1).astype(np.float32)
            part = x[rows]
            weights[:, k], intercepts[k] = support_vector(part, y)
            slopes[k] = _slope(part @ weights[:, k] + intercepts[k], y)
        return Pairwise(classes, pairs, weights, intercepts, slopes)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``classes``, its mean chance against the others) of each row; 1 for an only class."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        chance = 1 / (1 + np.exp(-np.clip((x @ self.weights + self.intercepts) * self.slopes, -50, 50)))
        sums, votes = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            sums[:, i] += chance[:, k]
            sums[:, j] += 1 - chance[:, k]
            votes[:, i] += chance[:, k] >= 0.5
            votes[:, j] += chance[:, k] < 0.5
        best = np.argmax(votes + sums / n, axis=1)
        return best, sums[np.arange(len(x)), best] / (n - 1)


@dataclass(frozen=True)
class Model:
    """Chosen buckets, the machines for families, and those within each family."""

    chosen: np.ndarray
    families: Pairwise
    within: dict[str, Pairwise]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        family, score = self.families.decide(x)
        names = np.full(len(x), UNKNOWN, dtype=object)
        for f in np.unique(family):
            rows = np.flatnonzero(family == f)
            machine = self.within[self.families.classes[f]]
            best, chance = machine.decide(x[rows])
            names[rows] = np.array(machine.classes, dtype=object)[best]
            score[rows] = score[rows] * chance
        return names, score


def _has_letter(column: str):
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit features and machines on ``labelled`` rows: id, text and language.

    Rows without an id, a language or a letter are not used.  The sample is
    chosen by hash of the id, as many texts of each language; of rows with the
    same id and language the smallest text counts.  None without a row to learn from.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & _has_letter("text"))
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    most = min(OF_LANGUAGE, max(2, SAMPLE // languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    taken = known.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("id", "lang").distinct()
    taken = keep(taken, "sampled")
    texts = known.join(F.broadcast(taken), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # about SAMPLE rows
    texts = keep(texts.select("id", "lang", F.lower("text").alias("text")), "texts")

    share = texts.mapInArrow(_shares, "lang string, h int, share long").groupBy("lang", "h").agg(F.sum("share").alias("share"))
    total = texts.groupBy("lang").agg((F.count("*") * 1e6).alias("total"))
    share = share.join(F.broadcast(total), "lang").select("h", (F.col("share") / F.col("total")).alias("p"))  # a row for each language
    share = share.groupBy("h").agg(F.sort_array(F.collect_list("p")).alias("p"))  # at most one of each language; sorted, so that sums come out alike
    plus = lambda f: F.aggregate("p", F.lit(0.0), lambda a, p: a + f(p))
    differs = plus(lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)) - plus(lambda p: p) * F.log(plus(lambda p: p) / languages + 1e-12)
    ranked = share.select("h", F.round(differs, 12).alias("differs")).orderBy(F.desc("differs"), "h").limit(FEATURES)
    chosen = np.sort(np.array([r.h for r in ranked.collect()], dtype=np.int64))
    rows = texts.select("id", "lang", "text").mapInArrow(_sample_vectors(chosen), "id long, lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    names = np.array(rows.column("lang").to_pylist(), dtype=object)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(len(names), len(chosen))
    family = np.array([family_of(n) for n in names], dtype=object)
    within = {f: Pairwise.fit(x[family == f], names[family == f]) for f in sorted(set(family.tolist()))}
    return Model(chosen, Pairwise.fit(x, family), within)


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(model.chosen)
        for batch in batches:
            for lo, hi, x in _vectors(batch.column(2), place, len(model.chosen)):
                names, score = model.predict(x)
                lettered = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                names, score = np.where(lettered, names, UNKNOWN), np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` (0 to 1) of every row.

    Texts that are null or have no letter are ``und`` with score 0, as is every
    text if there is no model.  A text whose n-grams are all unknown gets what
    the intercepts say.  Every row counts for itself: repeated rows give a row
    each, null ids too.  Other columns are not looked at.  Empty tables give no
    rows.  Long texts are counted in segments, all of each.
    """
    id_ = F.col(id_col).cast("long").alias("id")
    if model is None:
        return documents.select(id_, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(documents.sparkSession)
    return documents.select(id_, _has_letter(text_col).alias("lettered"), F.lower(text_col).alias("text")).mapInArrow(_predicted(model), "id long, lang_pred string, score double")


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document's language; rows with crc32(doc_id) mod 4 = 2 are held out from learning."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    found = predict(documents, fit(documents.where(~held_out("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
