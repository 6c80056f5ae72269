"""Languages: n-grams against a plain version, machines on made-up languages, held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import _kernel, languages
from tests.llm.helpers import awkward, empty, frame

#: Syllables of made-up languages; those of a family share most.
SYLLABLES = {
    "en": "the and wh tion er sh ou in".split(),
    "de": "the und sch ung er ein ch in".split(),
    "es": "que los ción ña ar de la en".split(),
    "fr": "que les tion é ai de la en".split(),
    "xx": "zz kk yy ww qq vv".split(),
}


def sentence(rng, language, n):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def plain_grams(text):
    kept = b"".join(bytes([b]) if b > 127 or chr(b).isalpha() else b" " for b in text.encode())
    padded, out = b" " + kept + b" ", Counter()
    for size in languages.SIZES:
        for i in range(len(padded) - size + 1):
            g = padded[i : i + size]
            if b" " not in g[1:-1] and g.strip():
                code = int.from_bytes(g, "big")
                out[((code + size) * int(languages._ODD[size - 1]) & 0xFFFFFFFF) >> (32 - languages.BUCKET_BITS)] += 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_grams_match_a_plain_version(seed, monkeypatch):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["ab", "c", " ", "  ", "é", "1", ".", "\n", "東", "Z"]) for _ in range(rng.randrange(60))) for _ in range(20)] + ["", "a", " ", "é", "x" * 300]
    want = [plain_grams(t) for t in texts]
    if seed > 2:
        monkeypatch.setattr(_kernel, "LONG", 20)
        monkeypatch.setattr(_kernel, "STEP_BYTES", 10)
        monkeypatch.setattr(_kernel.steps, "__defaults__", (10,))
    monkeypatch.setattr(languages, "STEP_TEXTS", 7)
    got = [Counter() for _ in texts]
    for lo, hi, parts in languages._parts(pa.array(texts)):
        for part in parts:
            for doc, h in languages.grams(*part):
                for d, x in zip(doc.tolist(), h.tolist(), strict=True):
                    assert lo + d < hi
                    got[lo + d][x] += 1
    assert got == want


def rows_of(languages_, n, seed=1):
    rng = random.Random(seed)
    return [(i, sentence(rng, (lang := rng.choice(languages_)), rng.randrange(2, 40)), lang) for i in range(n)]


def test_held_out_rows_are_told_apart(spark):
    rows = rows_of("en de es fr xx".split(), 800)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, id long").repartition(3)
    model = languages.fit(docs.where("crc32(CAST(doc_id AS string)) % 4 <> 2"))
    assert model.families.classes == ["germanic", "romance", "xx alone"] and model.within["romance"].classes == ["es", "fr"]
    again = languages.fit(docs.repartition(5).where("crc32(CAST(doc_id AS string)) % 4 <> 2"))
    assert (again.chosen == model.chosen).all() and (again.families.weights == model.families.weights).all()
    got = {r.id: r for r in languages.predict(docs, model).collect()}
    hits = [got[i].lang_pred == lang for i, _, lang in rows if held(i)]
    assert len(hits) > 150 and sum(hits) / len(hits) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    known = spark.createDataFrame(rows_of(["en", "fr"], 60) + [(None, "the", "de"), (900, None, "de"), (901, "12 34", "de"), (902, "the", None)], "doc_id long, text string, lang string")
    model = languages.fit(known)
    assert model.families.classes == ["germanic", "romance"] and model.within["germanic"].classes == ["en"]
    got = sorted(((r.id, r.lang_pred) for r in languages.predict(frame(spark, awkward()), model).collect()), key=str)
    want = {i: t for i, t, _ in awkward()}
    assert len(got) == len(awkward())
    for id_, lang in got:
        assert (lang == "und") == (not re.search(r"[^\W\d_]", want[id_] or ""))
    odd = frame(spark, [(1, "東京", "s"), (2, "1 2 ! \n", "s"), (3, None, None), (4, "", "s")])
    assert {r.id: (r.lang_pred != "und", r.score > 0) for r in languages.predict(odd, model).collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}
    assert languages.predict(empty(spark), model).count() == 0
    assert languages.fit(empty(spark)) is None
    assert {(r.lang_pred, r.score) for r in languages.predict(odd, None).collect()} == {("und", 0.0)}
    alone = languages.fit(known.where("lang = 'en'"))
    assert {(r.id, r.lang_pred, r.score) for r in languages.predict(odd, alone).where("id = 1").collect()} == {(1, "en", 1.0)}


def test_a_machine_separates_what_can_be_separated():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(300) < 0.2, 1, -1).astype(np.float32)
    x = (rng.normal(size=(300, 5)) * 0.1 + y[:, None] * np.array([0.4, 0, -0.3, 0, 0])).astype(np.float32)
    w, b = languages.support_vector(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.99
    # no better weights nearby: the loss is convex, so the gradient must be about zero
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ w + b))
    assert np.abs(x.T @ pull - 1e-4 * w).max() < 1e-3 and abs(pull.sum()) < 1e-3
