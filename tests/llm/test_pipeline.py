"""The pipeline's stages, each on its own input, against plain versions."""

import hashlib

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import awkward, prose, words
from tests.llm.test_near_and_repeats import brute_components, brute_removed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(6)
    rows = [(i, t, None, s, len(t or "")) for i, t, s in awkward(seed=6)] + [(3000 + i, " ".join(w.upper() + "$$$" for w in prose(rng, 90).split()), "en", "s2", 1) for i in range(6)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 3000), 0) for i in [*range(60), 3000, 3001]], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def stage(n, spark, docs, folder):
    return pipeline.STAGES[n][1](spark, docs, folder)


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_in_order(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = pipeline.keep(stage(0, spark, docs, folder))
    kept = plain(good)
    assert good.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {i for i, _, _ in kept if i is not None} == {i for i, t, _ in plain(docs) if i is not None and i < 3000 and len(words(t)) >= 50 and i != 908} | {908}

    apart = pipeline.keep(stage(1, spark, good, folder))
    components = {c for _, _, c in brute_components(kept)}
    assert sorted((i for i, _, _ in plain(apart)), key=repr) == sorted(components, key=repr)

    cut = pipeline.keep(stage(2, spark, apart, folder))
    before, removed = plain(apart), {i: sha for i, _, _, sha in brute_removed(plain(apart), 200)}
    assert cut.columns == good.columns and cut.count() == len(before)
    for i, text, _ in plain(cut):
        assert hashlib.sha256(text.encode()).hexdigest() == removed.get(i) if i in removed else text == dict((a, b) for a, b, _ in before)[i]
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = pipeline.keep(stage(3, spark, cut, folder))
    times = {}
    for row in plain(mixed):
        times[row] = times.get(row, 0) + 1
    assert set(times) <= set(plain(cut)) and max(times.values()) <= 3

    pieces = stage(4, spark, mixed, folder).collect()
    assert sum(p.length for p in pieces) == sum(len(words(t)) * n for (_, t, _), n in times.items())


def test_the_whole_run_is_its_stages(spark, folder):
    assert {"doc_id", "bin_id"} <= set(pipeline.run(spark, folder).columns)


def test_stages_of_nothing(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for n in range(5):
        out = stage(n, spark, docs, folder)
        assert out.count() == 0
