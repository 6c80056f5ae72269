"""Tokens of two tokenizers aligned by the bytes they cover.

Both encode the same bytes.  Tokens that share a byte are joined by an edge of a
bipartite graph; union-find over the edges gives its connected components,
which are the smallest groups of tokens that cover the same bytes: they are cut
where tokens of both sides end.  The members of a component expand to links,
pairs of tokens.  How often each pair of ids is linked is counted over all
texts, and every text's links are looked up in those counts.

* Texts are cut before each single space between two words.  Neither tokenizer
  has a token across such a cut (no piece goes on with a space, and both start a
  word with the space before it), so no component crosses it either.  Each
  distinct word is encoded and aligned once in a task, and a text is put
  together from its words.  A text that has a word which one side does not give
  back is encoded as a whole.
* This is done where the texts are and written once: per text its numbers and its
  distinct linked pairs.
* Pairs are counted with partial sums before the shuffle.
* Counts come back to the texts in two ways that give the same: pairs that are
  ``FREQUENT``-th of all links or more (so at most ``FREQUENT`` of them, whatever
  the input) are broadcast; the others, each of which few rows have, are joined
  by a shuffle.  So no pair, however common, lands in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _kernel
from palimpsest.llm._scratch import keep, small_batches

#: Pairs with this share of all links, so at most so many, are broadcast.
FREQUENT = 50_000
#: A task forgets the words that it knows when they have so many characters together.
KNOWN_CHARS = 1 << 24
#: Pairs of members expanded at a time.
STEP_LINKS = 1 << 20
#: The only space between two words.
_CUT = re.compile(r" (?<=\S )(?=\S)")

TOKENIZERS = "/opt/tokenizers"
SCHEMA = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


@dataclass(frozen=True)
class Vocabularies:
    """Contents of both files: a byte-level BPE (A, JSON) and a sentencepiece model (B).  They travel to executors in a broadcast."""

    a: bytes
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Vocabularies:
        with open(a, "rb") as fa, open(b, "rb") as fb:
            return Vocabularies(fa.read(), fb.read())


def _byte_of_character() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in out)}


class Encoders:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, files: Vocabularies):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        byte_of, known = _byte_of_character(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for entry, i in known.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        # ids as they stand in the listing of groups: first of a text, first of a group, and further ones of A; first and further ones of B
        a, b = [*map(str, range(len(self.bytes_a)))], [*map(str, range(len(self.bytes_b)))]
        self.written = [mark + x for mark, ids in (("\n", a), (";", a), (",", a), ("|", b), (",", b)) for x in ids]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B for each text, no special tokens, and whether both sides give the text back.  A sees a space before the text, B adds it."""
        spaced = [" " + t for t in texts]
        a, b = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        whole = [t.encode() for t in spaced]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        fine = size > 1
        for ids, table, length in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = list(chain.from_iterable(ids))
            fine &= np.bincount(np.repeat(np.arange(len(ids)), count), length[flat], minlength=len(ids)) == size
            if b"".join(map(table.__getitem__, flat)) != b"".join(whole):
                fine &= np.array([b"".join(map(table.__getitem__, x)) == w for x, w in zip(ids, whole, strict=True)], dtype=bool)
        return a, b, fine


def components(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each vertex's component, for edges (x, y) over n vertices: union-find, all edges of a round at once."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of A and of B, numbered in order, from the tokens' ends (both cover the same bytes)."""
    piece = np.union1d(end_a, end_b)  # no token ends within a piece, so one of each side covers it
    a, b = np.searchsorted(end_a, piece), np.searchsorted(end_b, piece)
    root = components(a, len(end_a) + b, len(end_a) + len(end_b))
    number = np.cumsum(root[: len(end_a)] == np.arange(len(end_a))) - 1  # the first token of A is a component's smallest vertex
    return number, number[root[len(end_a) :]]


def links(end_a: np.ndarray, end_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of linked tokens, some at a time.

    ``ends``: members of a component that end together.  ``members``: all pairs of members.
    """
    if kind == "ends":
        at = np.searchsorted(end_a, end_b)
        b = np.flatnonzero(end_a[at] == end_b) if len(end_b) else np.zeros(0, np.int64)
        yield at[b] if len(b) else b, b
        return
    n = group_b[-1] + 1 if len(group_b) else 0
    first, count = np.searchsorted(group_b, np.arange(n)), np.bincount(group_b, minlength=n)
    total = np.cumsum(count[group_a])
    at = 0
    while at < len(group_a):
        past = total[at] - count[group_a[at]]
        to = max(at + 1, int(np.searchsorted(total, past + STEP_LINKS, side="right")))
        a = np.repeat(np.arange(at, to), count[group_a[at:to]])
        yield a, first[group_a[a]] + np.arange(len(a)) - (total[a] - count[group_a[a]] - past)
        at = to


@dataclass(frozen=True)
class _Aligned:
    """Texts of a run: ``numbers`` (tokens of A and B, groups, links), listings, and the distinct ``pairs`` with their ``times``, those of text i from ``first[i]`` on."""

    numbers: np.ndarray
    listed: list[str]
    pairs: np.ndarray
    times: np.ndarray
    first: np.ndarray


def _aligned(coders: Encoders, a: list[list[int]], b: list[list[int]], kind: str) -> _Aligned:
    """Every text's tokens end at its end on both sides, so that no component crosses texts laid one after the other."""
    n = len(a)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(k.sum())) for ids, k in ((a, n_a), (b, n_b)))
    of_a = np.repeat(np.arange(n), n_a)
    end_a, end_b = np.cumsum(coders.length_a[ids_a]), np.cumsum(coders.length_b[ids_b])
    group_a, group_b = groups(end_a, end_b)
    # the listing: tokens by group, those of A first
    first_a, first_b = (np.append(True, g[1:] != g[:-1])[: len(g)] for g in (group_a, group_b))
    begins = np.append(True, of_a[1:] != of_a[:-1])[: len(of_a)]
    place_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, side="right")
    size_a, size_b = len(coders.bytes_a), len(coders.bytes_b)
    word = np.empty(len(group_a) + len(group_b), dtype=np.int64)
    word[place_a] = ids_a + np.where(begins, 0, np.where(first_a, size_a, 2 * size_a))
    word[place_b] = ids_b + 3 * size_a + np.where(first_b, 0, size_b)
    parts = "".join(map(coders.written.__getitem__, word.tolist())).split("\n")[1:]
    listed = [""] * n
    for i, part in zip(np.flatnonzero(n_a).tolist(), parts, strict=True):
        listed[i] = part
    n_links, pair, times = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in links(end_a, end_b, group_a, group_b, kind):
        n_links += np.bincount(of_a[x], minlength=n)
        found, many = np.unique((of_a[x] * size_a + ids_a[x]) * size_b + ids_b[y], return_counts=True)
        pair.append(found)
        times.append(many)
    pair, back = np.unique(np.concatenate(pair), return_inverse=True)
    times = np.bincount(back, np.concatenate(times), minlength=len(pair)).astype(np.int64)
    first = np.searchsorted(pair, np.arange(n + 1) * size_a * size_b)
    numbers = np.stack([n_a, n_b, np.bincount(of_a[first_a], minlength=n), n_links], axis=1)
    return _Aligned(numbers, listed, pair % (size_a * size_b), times, first)


class _Words:
    """The distinct words of a task, each encoded and aligned once."""

    def __init__(self, coders: Encoders, kind: str):
        self.coders, self.kind = coders, kind
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.listed: list[str] = []
        self.chars = 0
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.sound = np.zeros(0, bool)
        self.pairs, self.times, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.place.keys())
        if not new:
            return
        a, b, fine = self.coders.encode(new)
        for i in np.flatnonzero(~fine).tolist():
            a[i], b[i] = [], []
        found = _aligned(self.coders, a, b, self.kind)
        self.place.update(zip(new, range(len(self.listed), len(self.listed) + len(new)), strict=True))
        self.listed += found.listed
        self.chars += sum(map(len, new))
        self.numbers, self.sound = np.concatenate([self.numbers, found.numbers]), np.append(self.sound, fine)
        self.first = np.append(self.first, len(self.pairs) + found.first[1:])
        self.pairs, self.times = np.append(self.pairs, found.pairs), np.append(self.times, found.times)

    def texts(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, hash of the listing, pairs, times) of each text, by its words."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        self.learn({w for words in cut for w in words})
        place = self.place.__getitem__
        words = [list(map(place, c)) for c in cut]
        count = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(chain.from_iterable(words), np.int64, int(count.sum()))
        of = np.repeat(np.arange(len(texts)), count)
        unsound = np.bincount(of[~self.sound[flat]], minlength=len(texts)) > 0
        numbers = [np.bincount(of, self.numbers[flat, k], minlength=len(texts)).astype(np.int64) for k in range(4)]
        # the pairs of all words of a text, each once
        size = len(self.coders.bytes_a) * len(self.coders.bytes_b)
        many = self.first[flat + 1] - self.first[flat]
        at = np.repeat(self.first[flat] - np.append(0, np.cumsum(many))[:-1], many) + np.arange(many.sum())
        pair, back = np.unique(np.repeat(of, many) * size + self.pairs[at], return_inverse=True)
        times = np.bincount(back, self.times[at], minlength=len(pair)).astype(np.int64)
        bound = np.searchsorted(pair, np.arange(len(texts) + 1) * size)
        pair %= size
        for i in range(len(texts)):
            if unsound[i]:
                x, y, fine = self.coders.encode([texts[i]])
                whole = _aligned(self.coders, x if fine[0] else [[]], y if fine[0] else [[]], self.kind)
                n, listed, p, t = whole.numbers[0].tolist(), whole.listed[0], whole.pairs, whole.times
            else:
                n, listed = [int(x[i]) for x in numbers], ";".join(map(self.listed.__getitem__, words[i]))
                p, t = pair[bound[i] : bound[i + 1]], times[bound[i] : bound[i + 1]]
            yield *n, hashlib.sha256(listed.encode()).hexdigest() if listed else "", p, t
        if self.chars > KNOWN_CHARS:
            self.forget()


def _encoded(files, kind: str):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or _Words(Encoders(files.value), kind)
            texts = batch.column(1)
            for lo, hi, _, _ in _kernel.steps(texts):
                rows = list(known.texts([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]))
                columns = [batch.column(0).slice(lo, hi - lo), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def align(documents: DataFrame, files: Vocabularies, kind: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Alignment of both tokenizers on every text: (per text, per pair of ids).

    Per text: ``id``, ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``
    (links whose count is the highest of their B id, ties included),
    ``count_sum`` (counts of all its links) and ``groups_sha256`` (of the listing
    ``a1,a2|b1;a3|b2,b3``; '' without tokens).  Per pair: ``a``, ``b``, ``count``,
    ``is_best``.  ``kind`` says which pairs of tokens of a group are links:
    ``ends``, those that end at the same byte, or ``members``, all of them.

    Null and empty texts, and those that one side does not give back byte for
    byte, have no tokens: zeros and ''.  Every row counts for itself: repeated
    rows and ids give a row each, null ids too.  Other columns are not looked at.
    Empty tables give empty results.  A text of any length is aligned as a whole
    by one task, word by word.
    """
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(files)  # two files of a few MB
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_encoded(held, kind), SCHEMA)
    rows = keep(rows, "aligned", scan=True).withColumn("rid", F.monotonically_increasing_id())  # a scan of files numbers its rows alike each time
    each = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("rid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    size_b = _size_b(files)
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).select("pair", (F.col("pair") % size_b).cast("int").alias("b"), "count")
    counts = keep(counts, "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "b").select("pair", "b", "count", (F.col("count") == F.col("highest")).alias("is_best"))  # a row for each id of B at most
    total = rows.agg(F.sum("n_links")).first()[0] or 0
    often = counts.where(F.col("count") >= F.lit(total / FREQUENT)).select("pair", "count", "is_best")
    sums = F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    common = each.join(F.broadcast(often), "pair").groupBy("rid").agg(*sums)  # FREQUENT rows at most
    rare = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(counts.hint("shuffle_hash"), "pair").groupBy("rid").agg(*sums)
    looked_up = common.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(looked_up, "rid", "left")
    none = F.lit(0).cast("long")
    out = out.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    return out, counts.select(F.expr(f"pair div {size_b}").cast("int").alias("a"), "b", "count", "is_best")


def _size_b(files: Vocabularies) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()


def op11(spark, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every document's tokens, groups and links; links are tokens that end together."""
    files = Vocabularies.read(os.path.join(tokenizers, "byte_bpe_50k.json"), os.path.join(tokenizers, "piece_bpe_32k.model"))
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), files)[0].withColumnRenamed("id", "doc_id")
