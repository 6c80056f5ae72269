"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

* Voters look for one word or one word beginning each.  A voter that fires says
  toxic, one that is silent says not toxic.  Some are given (``LEXICON``,
  ``PATTERNS``); the others are signs that labelled toxic texts have far more
  often.  Whether a voter is right is not taken from the labels.
* The label model is generative: a hidden class, and for toxic texts one of
  ``KINDS`` hidden kinds, decide how likely each voter fires.  How right voters
  are comes from these chances; that they correlate comes from the kinds, as
  voters of a kind fire together, and from voters that nearly always fire
  together, which count as one.  All of it is estimated from how votes agree, by
  expectation and maximisation.  Labels give the share of toxic texts and nothing else.
* Its posterior labels train a logistic regression over voters and further
  hashed features; the classifier alone scores texts, all of each text.

The fit uses at most ``SAMPLE`` labelled texts; scoring uses every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import keep, small_batches

#: At most so many labelled texts, up to a third of them toxic, fit the models.
SAMPLE = 6000
MINED, FEATURES = 400, 3000
#: A sign is mined if toxic texts have it so many standard deviations more often than chance would.
CERTAIN = 4.5
#: Correlation beside the class from which voters are taken to see one sign.
CORRELATED = 0.9
#: Kinds of toxic texts (languages, topics), each with words of its own.
KINDS = 4
#: Beginnings of words, in bytes, that are looked at beside whole words.
PREFIXES = (4, 5, 6)
TABLE_BITS = 20

#: Insults that vote for toxic when they are a word of the text.
LEXICON = """
asshole bastard bitch clown crap creep damn disgusting dumb fool freak garbage hate idiot imbecile jerk kill loser lunatic
moron nasty pathetic pig retard scum shut slut stupid sucker trash ugly vermin vile worthless
idiotin dumm blöd hässlich abschaum arschloch verlierer wertlos müll versager widerlich trottel
idiote imbécile stupide crétin connard débile ordure raclure minable dégoûtant perdant inutile
idiota imbécil estúpido estúpida tonto basura escoria inútil perdedor asqueroso patético payaso
""".split()
#: Beginnings of words that vote for toxic.
PATTERNS = "idiot moron stupi patheti disgust worthless imbec scumb trashy arschl versag connar débil estúp asquero".split()

_U = np.uint64
#: Marks at the ends of a word that are not part of it.
_EDGE = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}*#$%&|<>-", dtype=np.uint8))


@dataclass(frozen=True)
class Classifier:
    """Sorted feature hashes with their weights, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the lower-cased words, without marks at their ends, and of their beginnings."""
    words = _kernel.Words(raw, offsets)
    for _ in range(3):
        some = words.end > words.start
        words.start = words.start + (some & _EDGE[raw[np.minimum(words.start, len(raw) - 1)]]) if len(raw) else words.start
        some = words.end > words.start
        words.end = words.end - (some & _EDGE[raw[words.end - 1]]) if len(raw) else words.end
    full = words.end > words.start
    words.start, words.end, doc = words.start[full], words.end[full], words.doc[full]
    sums = words.sums(lower=True)
    docs, out = [doc], [words.hashes(True, sums=sums)]
    for size in PREFIXES:
        long = words.end - words.start >= size
        docs.append(doc[long])
        part = words.hashes(True, prefix=size, sums=sums)[long]
        out.append(_kernel.mix(part + _U(size)))
    return np.concatenate(docs), np.concatenate(out)


def _features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a step, those of a long text by segments and without repeats in one."""
    if not _kernel.is_long(raw, offsets):
        yield features(raw, offsets)
        return
    for a, b in _kernel.segments(raw):
        found = np.unique(features(raw[a:b], np.array([0, b - a]))[1])
        yield np.zeros(len(found), np.int64), found


def _hash_of(text: str, prefix: bool = False) -> list[int]:
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    _, h = features(raw, np.array([0, len(raw)]))
    if not prefix:
        return [int(h[0])]
    known = [n for n in PREFIXES if n <= len(raw)]
    return [int(h[len(known)])] if known else []


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct features) of every text of a column."""
    for lo, hi, raw, offsets in _kernel.steps(batch.column(column)):
        doc, h = (np.concatenate(x) for x in zip(*_features(raw, offsets), strict=True))
        order = np.argsort(doc, kind="stable")
        first = np.searchsorted(doc[order], np.arange(hi - lo + 1))
        for d in range(hi - lo):
            yield lo + d, np.unique(h[order[first[d] : first[d + 1]]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and in how many other texts each feature is."""
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        for part in (1, 0):
            found = [h for row, h in _sets(batch, 1) if toxic[row] == part]
            names, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n if part else none), pa.array(none if part else n)], names=["h", "f1", "f0"])


def _chosen(wanted: np.ndarray):
    """Which of the wanted features (sorted) each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(wanted, h, assume_unique=True)) for _, h in _sets(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "toxic", "has"])

    return run


def blocks(votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Block of each voter: those whose votes correlate by ``CORRELATED`` or more beside the class, and what is linked by such."""
    v = votes.astype(np.float32)
    on, off = (v.T @ y) / (y.sum() + 1e-9), (v.T @ (1 - y)) / ((1 - y).sum() + 1e-9)
    rest = v - np.outer(y, on) - np.outer(1 - y, off)
    spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
    linked = rest.T @ rest / len(v) / np.outer(spread, spread) >= CORRELATED
    block = np.arange(len(on))
    while True:
        lowest = np.minimum(block, np.where(linked, block[None, :], len(block)).min(axis=1, initial=len(block)))
        if (lowest == block).all():
            return np.unique(block, return_inverse=True)[1]
        block = lowest


def _with_mean(z: np.ndarray, share: float) -> np.ndarray:
    """Chances whose log odds differ from ``z`` by one number and whose mean is ``share``."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        y = 1 / (1 + np.exp(-np.clip(z + mid, -50, 50)))
        low, high = (low, mid) if y.mean() > share else (mid, high)
    return y


def _kinds_at_first(signs: np.ndarray, prior: float, kinds: int) -> np.ndarray:
    """Chances of (not toxic, each kind) for each row, to begin with: the rows with most signs are toxic, and of the kind whose first row is most like them.

    The first rows of the kinds are those that are least like each other.
    """
    total = signs.sum(axis=1)
    most = np.argsort(-total, kind="stable")[: max(1, int(len(signs) * prior))]
    unit = signs / np.maximum(np.sqrt(total), 1e-9)[:, None]
    first = [most[0]]
    like = unit[most] @ unit[first[0]]
    for _ in range(kinds - 1):
        first.append(most[int(np.argmin(like))])
        like = np.maximum(like, unit[most] @ unit[first[-1]])
    toxic = np.zeros(len(signs), dtype=bool)
    toxic[most] = total[most] > 0
    out = np.zeros((len(signs), kinds + 1))
    out[np.arange(len(signs)), np.where(toxic, (unit @ unit[first].T).argmax(axis=1) + 1, 0)] = 1
    return 0.9 * out + 0.1 * np.r_[1 - prior, np.full(kinds, prior / kinds)]


def _signs(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rows by blocks of voters: whether one of the block fires."""
    block = blocks(votes, toxic)
    out = np.zeros((len(votes), block.max(initial=-1) + 1))
    for j in range(votes.shape[1]):
        out[:, block[j]] = np.maximum(out[:, block[j]], votes[:, j])
    return out


def label_model(votes: np.ndarray, prior: float, kinds: int = KINDS, rounds: int = 100) -> np.ndarray:
    """Posterior chance of the rarer class for each row of ``votes`` (rows x voters, 0 or 1).

    The class has the share ``prior`` and ``kinds`` kinds; each voter fires with a
    chance that depends on the kind, or on the row's not being of the class.
    Voters that fire together beside the class (``blocks``) are one.  A silent
    voter is evidence too.  Which class is which follows from votes being signs
    of the rarer one: the start takes the rows with most of them.
    """
    n, k = votes.shape
    if n == 0 or k == 0:
        return np.full(n, prior)
    signs = votes.astype(np.float64)
    chance = _kinds_at_first(signs, prior, kinds)
    for round_ in range(rounds):
        if round_ in (0, 10):
            signs = _signs(votes, 1 - chance[:, 0])
        weight = chance.sum(axis=0)
        fires = np.clip((chance.T @ signs + 2 * signs.mean(axis=0)) / (weight[:, None] + 2), 1e-4, 1 - 1e-4)
        log = signs @ np.log(fires.T) + (1 - signs) @ np.log(1 - fires.T)
        of_kind = log[:, 1:] + np.log((weight[1:] + 1) / (weight[1:].sum() + kinds))
        top = of_kind.max(axis=1, keepdims=True)
        part = np.exp(of_kind - top)
        toxic = _with_mean(np.clip(top[:, 0] + np.log(part.sum(axis=1)) - log[:, 0], -60, 60), prior)
        new = np.concatenate([1 - toxic[:, None], toxic[:, None] * part / part.sum(axis=1, keepdims=True)], axis=1)
        done = np.abs(new - chance).max() < 1e-4
        chance = new
        if done and round_ > 10:
            break
    return 1 - chance[:, 0]


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, k: int, y: np.ndarray, importance: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse 0/1 features (Adam on all rows)."""
    w = np.zeros(k + 1)  # the intercept comes last
    m, s = np.zeros(k + 1), np.zeros(k + 1)
    w[k] = -2.0
    total = importance.sum()
    for t in range(1, rounds + 1):
        z = np.clip(w[k] + np.bincount(rows, w[cols], minlength=n), -30, 30)
        g = (1 / (1 + np.exp(-z)) - y) * importance / total
        step = np.r_[np.bincount(cols, g[rows], minlength=k) + 1e-5 * w[:k], g.sum()]
        m, s = 0.9 * m + 0.1 * step, 0.99 * s + 0.01 * step**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w[:k], float(w[k])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit voters, label model and classifier on labelled rows.

    ``labels``: id and toxic (0 or 1) of the rows that may be learnt from; an id
    with several labels is toxic if one of them says so, and of its texts the
    smallest counts.  The sample is chosen by hash of the id; rows without a
    label are not used.  Features are counted where the texts are; the driver
    gets the ``FEATURES`` strongest, and for each sampled text which of them it
    has.  Without labelled texts the given lexicon decides alone.
    """
    spark = documents.sparkSession
    small_batches(spark)
    known = labels.select(F.col(labels.columns[0]).cast("long").alias("id"), F.col(labels.columns[1]).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: SAMPLE // 3, 0: SAMPLE - SAMPLE // 3}
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(most[t]) for t in (0, 1)]
    taken = keep(parts[0].unionByName(parts[1]), "sampled")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")  # SAMPLE rows
    texts = keep(texts.groupBy("id", "toxic").agg(F.min("text").alias("text")), "texts")
    got = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    lexicon = [h for x in LEXICON for h in _hash_of(x)] + [h for x in PATTERNS for h in _hash_of(x, prefix=True)]
    lexicon = np.unique(np.array(lexicon, dtype=_U))
    if not got:
        return Classifier(lexicon, np.full(len(lexicon), 3.0), -3.0)

    n1, n0 = max(got.get(1, 0), 1), max(got.get(0, 0), 1)
    counts = texts.select("toxic", "text").mapInArrow(_counted, "h long, f1 long, f0 long").groupBy("h").agg(F.sum("f1").alias("f1"), F.sum("f0").alias("f0"))
    counts = counts.withColumn("odds", F.log((F.col("f1") + 0.3) / (n1 + 1)) - F.log((F.col("f0") + 0.3) / (n0 + 1)))
    counts = counts.withColumn("strength", F.col("odds") * F.sqrt(F.col("f1") + F.col("f0"))).withColumn("expected", (F.col("f1") + F.col("f0")) * F.lit(n1 / (n1 + n0)))
    often = F.col("f1") - F.col("expected") >= CERTAIN * F.sqrt(F.col("expected") + 0.5)
    counts = keep(counts.where(often & (F.col("odds") > 0.7) | F.col("h").isin(lexicon.view(np.int64).tolist())).withColumn("often", often), "features")
    ranked = counts.where("often").orderBy(F.desc("strength"), "h")
    mined = np.array([r.h for r in ranked.where("odds > 1.5").limit(MINED).collect()], dtype=np.int64).view(_U)
    strong = np.array([r.h for r in ranked.limit(FEATURES).collect()], dtype=np.int64).view(_U)
    given = np.array([r.h for r in counts.where(F.col("h").isin(lexicon.view(np.int64).tolist())).collect()], dtype=np.int64).view(_U)
    voters = np.union1d(given, mined)
    chosen = np.union1d(strong, voters)

    rows = texts.select("id", "toxic", "text").mapInArrow(_chosen(chosen), "id long, toxic int, has array<int>").toArrow().sort_by("id")
    labels_of, has = rows.column("toxic").to_numpy(), rows.column("has").combine_chunks()
    doc, col = np.repeat(np.arange(len(labels_of)), has.value_lengths().to_numpy()), has.flatten().to_numpy()
    votes = np.zeros((len(labels_of), len(chosen)), dtype=np.uint8)
    votes[doc, col] = 1
    posterior = label_model(votes[:, np.isin(chosen, voters)], float(np.clip(labels_of.mean(), 0.01, 0.5)))

    share = {t: size.get(t, 0) / max(got.get(t, 0), 1) for t in (0, 1)}
    w, b = _logistic(doc, col, len(labels_of), len(chosen), posterior, np.where(labels_of == 1, share[1], share[0]))
    unseen = np.setdiff1d(lexicon, chosen)  # given words that the sample doesn't have
    hashes = np.concatenate([chosen, unseen])
    weights = np.concatenate([w, np.full(len(unseen), np.median(w[w > 0]) if (w > 0).any() else 1.0)])
    order = np.argsort(hashes)
    return Classifier(hashes[order], weights[order], float(b))


def _scored(model: Classifier):
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[(model.hashes >> _U(64 - TABLE_BITS)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, model.intercept)
            for lo, hi, raw, offsets in _kernel.steps(batch.column(1)):
                pairs = []
                for doc, h in _features(raw, offsets):
                    maybe = np.flatnonzero(table[(h >> _U(64 - TABLE_BITS)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(model.hashes, h[maybe]), len(model.hashes) - 1)
                    sure = model.hashes[at] == h[maybe]
                    pairs.append(doc[maybe[sure]].astype(np.int64) * len(model.hashes) + at[sure])
                pairs = np.unique(np.concatenate(pairs))
                z[lo:hi] += np.bincount(pairs // len(model.hashes), model.weights[pairs % len(model.hashes)], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return run


def score(documents: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every row; null and empty texts get the score of a text without any sign."""
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scored(model), "id long, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document with its score; rows with crc32(doc_id) mod 4 = 2 are held out from learning."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id")).select("doc_id", "toxic")
    found = score(documents, fit(documents, labels))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
