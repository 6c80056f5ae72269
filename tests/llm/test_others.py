"""Quality, toxicity, packing, mixing, sharding, chat, licenses and search against plain versions."""

import random
import re
import zlib

import pytest

from palimpsest.llm import chat, licenses, mixing, packing, quality, sharding, topk, toxicity
from tests.llm.helpers import awkward, empty, frame, prose, words


# quality


def brute_counts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_match_plain_versions(spark):
    rows = awkward() + [(2000, "a b\na b\n\na b \n|x|", "s"), (2001, "a a a a a a", "s"), (2002, "x\r\nx\r\n", "s"), (2003, "\n\n", "s")]
    docs = frame(spark, rows)
    model = quality.fit_ratio(docs, spark.createDataFrame([(i,) for i in range(40)], "doc_id long"))
    got = sorted((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs, model).collect() if r.id is not None)
    want = sorted((i, *(c := brute_counts(t)), c[0] < 50 or 2 * c[4] > c[0]) for i, t, _ in rows if i is not None)
    assert got == want
    kept = sorted(r.id for r in quality.judge(docs, model).collect() if r.kept and r.id is not None)
    assert kept == sorted(r.doc_id for r in quality.keep_good(docs, model).collect() if r.doc_id is not None)
    assert quality.keep_good(docs, model).columns == docs.columns


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_are_looked_at_in_segments(monkeypatch, seed):
    import numpy as np
    import pyarrow as pa

    from palimpsest.llm import _kernel

    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a b c\n", "x ", "\n", "w" * 90 + " ", "|$ ", "é", "\n\n", "idiot ", "scum "]) for _ in range(rng.randrange(400))), "a b c d e f\n" * 40, "q" * 999, "one two", ""]
    table = np.zeros(quality.BUCKETS, np.int64) + np.arange(quality.BUCKETS) % 7
    model = toxicity.Classifier(np.sort(np.array(toxicity._hash_of("idiot") + toxicity._hash_of("scum"), dtype=np.uint64)), np.array([1.0, 2.0]), -1.0)

    def seen():
        batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
        known = pa.RecordBatch.from_arrays([pa.array([i % 2 == 0 for i in range(5)]), pa.array(texts)], names=["known", "text"])
        out = [x.to_pylist() for x in quality._judged(quality.Ratio(table), 0.0, False, "text")(iter([batch]))]
        out += [x.to_pylist() for x in quality._count(iter([known]))] + [x.to_pylist() for x in toxicity._scored(model)(iter([batch]))]
        return out, [(i, x.tolist()) for i, x in _kernel.shingle_sets(batch.column(1))]

    whole = seen()
    monkeypatch.setattr(_kernel, "LONG", 40)
    monkeypatch.setattr(_kernel, "STEP_BYTES", 25)
    monkeypatch.setattr(_kernel.steps, "__defaults__", (25,))
    assert seen() == whole


def test_junk_falls_and_prose_stays(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 120), "s") for i in range(60)]
    junk = [(i, " ".join(w.upper() + "$$$" for w in prose(rng, 120).split()), "s") for i in range(100, 110)]
    docs = frame(spark, good + junk)
    model = quality.fit_ratio(docs, spark.createDataFrame([(i,) for i in range(50)], "doc_id long"))
    verdict = {r.id: r.kept for r in quality.judge(docs, model).collect()}
    assert all(verdict[i] for i, _, _ in good) and not any(verdict[i] for i, _, _ in junk)
    nothing = spark.createDataFrame([], "doc_id long")
    assert quality.judge(empty(spark), quality.fit_ratio(empty(spark), nothing)).count() == 0


def test_all_trusted_documents_are_counted(spark):
    import numpy as np

    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id < 25000, 'abcd', 'zzzz') AS text").unionByName(spark.createDataFrame([(None, "zzzz"), (7, "abcd"), (7, None)], "doc_id long, text string"))
    trusted = spark.range(25_000).unionByName(spark.createDataFrame([(None,), (7,), (99_999,)], "id long"))
    model = quality.fit_ratio(docs, trusted)
    for gram, target, raw in (("abcd", 25_001, 25_001), ("zzzz", 0, 5_001)):
        _, b = quality.buckets(np.frombuffer(gram.encode(), dtype=np.uint8), np.array([0, 4]))
        assert model.weights[b[0]] == round(quality.SCALE * float(np.log((target + quality.PSEUDO) / (raw * 25_001 / 30_002 + quality.PSEUDO))))


def test_ratio_is_what_the_definition_says(spark):
    import numpy as np

    docs = frame(spark, [(1, "abcdabcd", "s"), (2, "zzzz", "s"), (3, "ab", "s"), (4, None, "s")])
    model = quality.fit_ratio(docs, spark.createDataFrame([(1,)], "doc_id long"))
    raw = {"abcd": 2, "bcda": 1, "cdab": 1, "dabc": 1, "zzzz": 1}
    target = {k: v for k, v in raw.items() if k != "zzzz"}
    for gram in raw:
        _, b = quality.buckets(np.frombuffer(gram.encode(), dtype=np.uint8), np.array([0, 4]))
        want = round(quality.SCALE * float(np.log((target.get(gram, 0) + quality.PSEUDO) / (raw[gram] * 5 / 6 + quality.PSEUDO))))
        assert model.weights[b[0]] == want


# toxicity


def test_toxic_texts_are_told_apart_in_held_out_rows(spark):
    rng = random.Random(4)
    signs = ["idiot", "scum", "moron", "zzqueux", "zzquier", "zzquant"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(rng, 60).split()
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(signs)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs = frame(spark, rows + [(9000, None, "s"), (9001, "", "s"), (9002, "", None)])
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if not held(x[0])], "id long, toxic int"))
    score = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    hits = [(score[i] >= 0.3) == bool(t) for i, t in labels if held(i)]
    assert sum(hits) / len(hits) > 0.97
    assert score[9000] == score[9001] == score[9002] < 0.3
    assert len(score) == 603


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "you idiot", "s"), (2, "hello there", "s")])
    model = toxicity.fit(docs, spark.createDataFrame([], "id long, toxic int"))
    score = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert score[1] > 0.3 > score[2]
    assert toxicity.score(empty(spark), model).count() == 0


def simulated_votes(n=4000):
    import numpy as np

    rng = np.random.default_rng(0)
    y = (rng.random(n) < 0.2).astype(int)
    fires = lambda hit, miss: (rng.random(n) < np.where(y == 1, hit, miss)).astype(np.uint8)
    return y, [fires(0.6, 0.01) for _ in range(4)], fires(0.5, 0.1)


def test_accuracies_come_from_agreement():
    import numpy as np

    y, good, poor = simulated_votes()
    got = toxicity.label_model(np.stack([*good, poor], axis=1), 0.2)
    sure = np.sum(good, axis=0) >= 2
    assert ((got > 0.5) == (y == 1))[sure].mean() > 0.98 and ((got > 0.5) == (y == 1)).mean() > 0.95


def test_one_step_of_estimation_is_what_the_definition_says(monkeypatch):
    """A round on few rows, by the formulas alone: chances of firing by class, then the class by all votes, silent ones too."""
    import math

    import numpy as np

    votes = np.array([[1, 1, 0], [1, 0, 1], [0, 1, 1], [0, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [1, 0, 0]], dtype=np.uint8)
    prior, n, k = 0.25, 8, 3
    order = sorted(range(n), key=lambda i: (-int(votes[i].sum()), i))[:2]
    q = [0.9 * (i in order) + 0.1 * prior for i in range(n)]
    fires = {c: [(sum((q[i] if c else 1 - q[i]) * votes[i, j] for i in range(n)) + 2 * votes[:, j].mean()) / (sum(q[i] if c else 1 - q[i] for i in range(n)) + 2) for j in range(k)] for c in (0, 1)}
    odds = [sum(math.log((fires[1][j] if votes[i, j] else 1 - fires[1][j]) / (fires[0][j] if votes[i, j] else 1 - fires[0][j])) for j in range(k)) for i in range(n)]
    low, high = -50.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        mean = sum(1 / (1 + math.exp(-(o + mid))) for o in odds) / n
        low, high = (low, mid) if mean > prior else (mid, high)
    want = [1 / (1 + math.exp(-(o + low))) for o in odds]
    assert np.allclose(toxicity.label_model(votes, prior, kinds=1, rounds=1), want, atol=1e-6)


def test_kinds_of_toxic_texts_are_found_without_labels():
    import numpy as np

    rng = np.random.default_rng(5)
    n, kinds, each = 5000, 4, 12
    kind = np.where(rng.random(n) < 0.15, rng.integers(1, kinds + 1, n), 0)
    chance = np.full((kinds + 1, kinds * each), 0.005)
    for c in range(kinds):
        chance[c + 1, c * each : (c + 1) * each] = 0.5
    votes = (rng.random((n, kinds * each)) < chance[kind]).astype(np.uint8)
    got = toxicity.label_model(votes, float((kind > 0).mean())) > 0.5
    known = np.log(np.where(votes[:, None, :] == 1, chance, 1 - chance)).sum(axis=2) + np.log(np.r_[0.85, np.full(kinds, 0.15 / kinds)])
    best = known[:, 1:].max(axis=1) > known[:, 0]  # with the true chances
    assert got[kind > 0].mean() > best[kind > 0].mean() - 0.02 and got[kind == 0].mean() < best[kind == 0].mean() + 0.005


def test_copies_of_a_voter_add_no_evidence():
    import numpy as np

    _, good, poor = simulated_votes()
    once = toxicity.label_model(np.stack([*good, poor], axis=1), 0.2)
    often = toxicity.label_model(np.stack([*good, *[poor] * 8], axis=1), 0.2)
    assert np.abs(once - often).mean() < 0.02 and np.abs(once - often).max() < 0.25


def test_repeated_labels_and_texts_count_once(spark):
    rows = [(i, f"you zzq{i % 7} idiot " * 3 if i % 4 == 0 else f"fine words {i}", "s") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    one = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "id long, toxic int"))
    more = frame(spark, rows + rows[:50] * 3 + [(0, None, "s"), (None, "idiot", "s")])
    two = toxicity.fit(more, spark.createDataFrame(labels + labels[::4] + [(8, 0), (None, 1), (9, None)], "id long, toxic int"))
    assert (one.hashes == two.hashes).all() or len(one.hashes) == len(two.hashes)


# packing


def check_bins(pieces, sources, clusters, capacity, per_source):
    bins = {}
    for (size, b, at), s, c in zip(pieces, sources, clusters):
        bins.setdefault(b, []).append((at, size, s, c))
    for held in bins.values():
        at = 0
        for place, size, _, _ in sorted(held):
            assert place == at
            at += size
        assert at <= capacity
        assert len({c for *_, c in held}) == len(held)
        assert max(sum(1 for x in held if x[2] == s) for *_, s, _ in held) <= per_source


def plain_pack(sizes, sources, clusters, capacity, per_source):
    """The tightest bin that has room and no conflict, by looking at all of them."""
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(capacity - sum(sizes[j] for j in b), n) for n, b in enumerate(bins) if sum(sizes[j] for j in b) + sizes[i] <= capacity and clusters[i] not in {clusters[j] for j in b} and sum(sources[j] == sources[i] for j in b) < per_source]
        if fit:
            out[i] = min(fit)[1]
            bins[out[i]].append(i)
        else:
            out[i] = len(bins)
            bins.append([i])
    return out


def test_packing_finds_the_tightest_compatible_bin():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(1, 80)
        sizes = [rng.randrange(1, 100) for _ in range(n)]
        sources, clusters = [rng.choice(["a", "b", None]) for _ in range(n)], [rng.randrange(max(1, n // 2)) for _ in range(n)]
        bins, places = packing.pack(sizes, sources, clusters, 100, dict.fromkeys(sources, 2))
        assert bins == plain_pack(sizes, sources, clusters, 100, 2)
        check_bins(list(zip(sizes, bins, places)), sources, clusters, 100, 2)


def test_every_word_is_packed_once(spark):
    rows = awkward()
    got = packing.best_fit(frame(spark, rows), capacity=200).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, 0)
        want[i] += len(words(t))
    have = {}
    for r in got:
        have[r.id] = have.get(r.id, 0) + r.length
        assert (r.bin_id is None) == (r.length == 0)
    assert have == want
    used = {}
    for r in got:
        if r.length:
            used.setdefault(r.bin_id, []).append((r.offset, r.length))
    for held in used.values():
        at = 0
        for place, size in sorted(held):
            assert place == at
            at += size
        assert at <= 200
    assert packing.best_fit(empty(spark)).count() == 0


def test_bins_fill_where_there_is_one_source(spark):
    rng = random.Random(6)
    for name in (lambda i: None, lambda i: "one", lambda i: f"s{i % 20}"):
        rows = [(i, prose(rng, rng.randrange(20, 400)), name(i)) for i in range(400)]
        got = packing.best_fit(frame(spark, rows)).collect()
        assert sum(r.length for r in got) / (2048 * len({r.bin_id for r in got})) > 0.9
    alike = packing.best_fit(frame(spark, [(1, "a b c", "s")] * 50)).collect()
    assert len({r.bin_id for r in alike}) == 50


# mixing


def test_near_copies_are_packed_apart(spark, tmp_path):
    rng = random.Random(4)
    base = prose(rng, 100).split(" ")
    rows = [(i, " ".join(["edit%d" % i, *base[1:]]), f"s{i}") for i in range(8)] + [(8, " ".join(base), "s8"), (9, " ".join(base), "s9")] + [(100 + i, prose(rng, 100), f"t{i}") for i in range(30)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op4(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    assert len({r.bin_id for r in got if r.doc_id < 10}) == 10


def test_targets_by_hand():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.capped_targets([300, 10, 10], [1, 2, 3]) == pytest.approx([260, 30, 30])
    assert mixing.capped_targets([0, 5], [1, 1]) == pytest.approx([0, 5])
    assert mixing.capped_targets([], []) == []


def test_min_cost_flow_prefers_fresh_words():
    # two patterns into one quota: each gives its first words before either repeats
    edges = [(0, 1, 5, 0), (0, 1, 5, 1), (0, 2, 5, 0), (0, 2, 5, 1), (1, 3, 15, 0), (2, 3, 15, 0), (3, 4, 12, 0)]
    flow = mixing.min_cost_flow(edges, 5, 0, 4)
    assert flow[0] == flow[2] == 5 and flow[1] + flow[3] == 2 and flow[6] == 12


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice(["a", "b", "c", None, "ä"])) for i in range(1500)] + [(7, None, "a"), (7, "", "zero"), (None, "x y", "b")]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F

    sources = F.array("source")
    decided = mixing.plan(docs, sources)
    got = mixing.times_taken(decided).select("source", mixing.word_count(F.col("text")).alias("n"), "times").collect()
    assert len(got) == len(rows)
    assert list(decided.targets) == ["a", "b", "c", "zero", "ä", None]
    for s, (size, target) in decided.targets.items():
        own = [(r.n, r.times) for r in got if r.source == s]
        assert size == sum(n for n, _ in own)
        assert abs(sum(n * t for n, t in own) - target) <= 21
        assert all(0 <= t <= 3 for _, t in own)
    many = lambda x: sorted(map(tuple, mixing.times_taken(x).groupBy("doc_id", "times").count().collect()), key=repr)
    assert many(mixing.plan(docs.repartition(5), sources)) == many(decided)
    assert mixing.repeated(decided).count() == sum(r.times for r in got)
    assert mixing.plan(empty(spark), sources).cuts == []


def test_rows_alike_are_taken_one_by_one(spark):
    from pyspark.sql import functions as F

    half = [(1, "one and the same text", "a")] * 3000 + [(None, "a b c", "a")] * 3000
    for rows in (half, [(5, prose(random.Random(i), 9), "a") for i in range(500)] + [(i, "x y z", "b") for i in range(1500)]):
        table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows + [(7, "w " * 40, "b")] * 100], "doc_id long, text string, source string, times int, copy int, pattern int, h int, Row int").repartition(5)
        decided = mixing.plan(table, F.array("source"))
        out = mixing.repeated(decided)
        assert out.columns == table.columns
        got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
        for s, (_, target) in decided.targets.items():
            assert abs(got.get(s, 0) - target) <= 40


def plain_flow(edges, n, source, sink):
    """Cost of the cheapest largest flow, a unit at a time."""
    cap, total = {}, 0
    arcs = []
    for a, b, c, w in edges:
        arcs += [[a, b, c, w, len(arcs) + 1], [b, a, 0, -w, len(arcs)]]
    while True:
        dist, via = [1e9] * n, [None] * n
        dist[source] = 0
        for _ in range(n):
            for i, (a, b, c, w, _) in enumerate(arcs):
                if c and dist[a] + w < dist[b]:
                    dist[b], via[b] = dist[a] + w, i
        if dist[sink] >= 1e9:
            return total
        x = sink
        while x != source:
            arcs[via[x]][2] -= 1
            arcs[arcs[via[x]][4]][2] += 1
            x = arcs[via[x]][0]
        total += dist[sink]


def test_flows_are_largest_and_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        p, q = rng.randrange(1, 6), rng.randrange(1, 4)
        edges = [(0, 1 + i, rng.randrange(6), c) for i in range(p) for c in (0, 1, 3)]
        edges += [(1 + i, 1 + p + j, rng.randrange(9), rng.randrange(2)) for i in range(p) for j in range(q) if rng.random() < 0.7]
        edges += [(1 + p + j, 1 + p + q, rng.randrange(9), 0) for j in range(q)]
        flow = mixing.min_cost_flow(edges, 2 + p + q, 0, 1 + p + q)
        assert all(0 <= f <= e[2] for f, e in zip(flow, edges))
        for x in range(1, 1 + p + q):
            assert sum(f for f, e in zip(flow, edges) if e[1] == x) == sum(f for f, e in zip(flow, edges) if e[0] == x)
        assert sum(f * e[3] for f, e in zip(flow, edges)) == plain_flow(edges, 2 + p + q, 0, 1 + p + q)


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("of", T.ArrayType(T.StringType()))])
    rows = [(i, "a b c d", [["x"], ["y"], ["x", "y"], ["y", "x"], [], None][i % 6]) for i in range(600)]
    docs = spark.createDataFrame(rows, schema)
    decided = mixing.plan(docs, F.col("of"), weights=(1, 1))
    taken = mixing.times_taken(decided).select("of", "times").collect()
    assert all(r.times == 0 for r in taken if not r.of)
    assert abs(sum(4 * r.times for r in taken) - sum(t for _, t in decided.targets.values())) <= 12


# sharding


def test_shards_have_equal_bytes_and_gapless_places(spark):
    rows = awkward() + [(5000 + i, "the same text", "s") for i in range(300)]
    got = sharding.shard_documents(frame(spark, rows), shards=4).collect()
    assert sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows) == sorted(r.text_crc32 for r in got)
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    for s in range(4):
        assert sorted(r.place for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_rows_alike_spread_over_shards(spark):
    rng = random.Random(2)
    for same in ((1, "t" * 999, "s"), (None, None, "s"), (None, "x" * 50, None)):
        rows = [same] * 3000 + [(i, prose(rng, rng.randrange(1, 60)), "s") for i in range(2000)]
        got = sharding.shard_documents(frame(spark, rows).repartition(7))
        loads = [0] * 8
        for r in got.collect():
            loads[r.shard] += r["size"]
        assert sorted((r.id is None, r.id or 0, r["size"]) for r in got.collect()) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t, _ in rows)
        assert max(loads) - min(loads) <= 1000
        again = sharding.shard_documents(frame(spark, rows).repartition(3))
        assert sorted(map(str, again.select("id", "size", "vslot").collect())) == sorted(map(str, got.select("id", "size", "vslot").collect()))


def test_maps_are_edited_not_made_anew(spark, tmp_path):
    rng = random.Random(3)
    old = sharding.new_map([rng.randrange(1, 100) for _ in range(500)], 5)
    assert max(old.loads()) - min(old.loads()) <= 2
    grown = sharding.rebalanced(old, list(old.sizes), 6)
    moved = [s for s in range(500) if old.shard_of[s] != grown.shard_of[s]]
    assert moved and len(moved) < 200 and max(grown.loads()) - min(grown.loads()) < 0.05 * max(grown.loads())
    sharding.save_map(spark, str(tmp_path / "maps"), old)
    sharding.save_map(spark, str(tmp_path / "maps"), grown)
    assert sharding.load_map(spark, str(tmp_path / "maps")) == grown
    assert sharding.load_map(spark, str(tmp_path / "maps"), 1) == old


def test_sharding_goes_by_the_stored_map(spark, tmp_path, monkeypatch):
    saved = []
    monkeypatch.setattr(sharding, "save_map", lambda *x, f=sharding.save_map: (saved.append(x[2].version), f(*x)))
    frame(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op2(spark, str(tmp_path)).count() == len(awkward()) and saved == [1]
    rng = random.Random(9)
    maps = str(tmp_path / "maps")
    rows = [(i, prose(rng, 20), "s") for i in range(400)]
    one = {r.id: r.shard for r in sharding.shard_documents(frame(spark, rows), shards=4, slots=256, maps=maps).collect()}
    two = {r.id: r.shard for r in sharding.shard_documents(frame(spark, rows), shards=5, slots=256, maps=maps).collect()}
    assert saved == [1, 1, 2] and sharding.load_map(spark, maps).version == 2
    assert 0 < sum(one[i] != two[i] for i in one) < 160 and set(two.values()) == set(range(5))


# chat


def test_chats_round_trip(spark):
    from pyspark.sql import functions as F

    nasty = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "<|sep|>", "a\n[/INST", "", None, "$1 \\ \\\\", "[/INST][INST]", "<\\|sep|>\n", "<s"]
    rows = [(c, i, ["user", "assistant", None, "[INST]tool"][(c + i) % 4], t) for c in range(4) for i, t in enumerate(nasty)]
    rows += [(50, None, "user", "b"), (50, None, "user", "a"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z"), (None, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns)
    formatted = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    got = {r.id: r.t for r in out.select("id", chat.read_back(formatted).alias("t")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(x.role, x.text) for x in got[c]] == [(r[2] or "", r[3] or "") for r in own]
    loss = {r.id: r.l for r in out.select("id", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"], chat.Template())).alias("l")).collect()}
    assert loss[50] == ["z", "z"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_the_machine_checks_turn_order(spark):
    good = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u"), (3, 0, "user", "u"), (4, 0, "assistant", "a"), (5, 0, "user", "u"), (5, 1, "tool", "t")]
    turns = spark.createDataFrame(good, "conv_id long, turn long, role string, text string")
    got = {r.id: (r.valid, r.first_bad) for r in chat.format_chats(turns).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, None), 4: (False, 0), 5: (False, 1)}


# licenses

#: Notices as projects have them, with the license that each names.
NOTICES = [line.rsplit(" => ", 1) for line in """
This project is licensed under the MIT License. => MIT
This project is licensed under the MIT License - see the LICENSE file for details. => MIT
MIT License Copyright (c) 2020 Jane Doe => MIT
MIT License\\n\\nCopyright (c) 2021 Some Company, Inc. => MIT
// SPDX-License-Identifier: MIT => MIT
Released under the MIT Licence. => MIT
license: MIT => MIT
Distributed under the MIT License. See LICENSE for more information. => MIT
The code is available under the MIT license. => MIT
The software is MIT licensed. => MIT
# SPDX-License-Identifier: Apache-2.0 => Apache-2.0
Licensed under the Apache License 2.0 => Apache-2.0
Licensed under the Apache License, Version 2.0. => Apache-2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 => Apache-2.0
This library is released under the Apache 2.0 License. => Apache-2.0
Code is distributed under the Apache License v2.0 => Apache-2.0
License: Apache-2.0 => Apache-2.0
available under the terms of the Apache License, Version 2.0 => Apache-2.0
/* SPDX-License-Identifier: GPL-2.0-only */ => GPL-2.0
SPDX-License-Identifier: GPL-3.0-or-later => GPL-3.0
This software is released under the GPLv3 license. => GPL-3.0
Licensed under GPLv3 => GPL-3.0
Licensed under the GNU GPL v3 => GPL-3.0
This work is licensed under the GNU General Public License v3.0 => GPL-3.0
This program is released under the GNU General Public License, version 2. => GPL-2.0
distributed under the terms of the GNU General Public License version 2.0 => GPL-2.0
Licensed under the GPL-3.0 license. => GPL-3.0
License: GPL v2 => GPL-2.0
This library is licensed under the LGPLv3 => LGPL-3.0
Licensed under the GNU Lesser General Public License v2.1 => LGPL-2.1
SPDX-License-Identifier: LGPL-2.1-or-later => LGPL-2.1
Licensed under the GNU Affero General Public License v3.0 => AGPL-3.0
Our server is licensed under the AGPLv3. => AGPL-3.0
SPDX-License-Identifier: AGPL-3.0-only => AGPL-3.0
Licensed under CC-BY-SA 4.0 => CC-BY-SA-4.0
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. => CC-BY-SA-4.0
This work is licensed under a Creative Commons Attribution 4.0 International License. => CC-BY-4.0
This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. => CC-BY-NC-ND-4.0
This article is licensed under a Creative Commons Attribution 3.0 Unported License. => CC-BY-3.0
Text is available under the Creative Commons Attribution-ShareAlike 3.0 License => CC-BY-SA-3.0
Content on this site is licensed under CC BY 4.0 => CC-BY-4.0
Pictures: licensed under CC BY-NC-SA 4.0. => CC-BY-NC-SA-4.0
License: CC-BY-4.0 => CC-BY-4.0
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. => CC0-1.0
Data is released under CC0 1.0 Universal => CC0-1.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. => MPL-2.0
Licensed under the Mozilla Public License 2.0 => MPL-2.0
SPDX-License-Identifier: MPL-2.0 => MPL-2.0
This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 => EPL-2.0
Eclipse Public License - v 2.0 license => EPL-2.0
made available under the terms of the Eclipse Public License v1.0 => EPL-1.0
Distributed under the Boost Software License, Version 1.0. => BSL-1.0
This is free and unencumbered software released into the public domain. => Unlicense
SPDX-License-Identifier: Unlicense => Unlicense
Licensed under the BSD 3-Clause License => BSD-3-Clause
Released under the New BSD License => BSD-3-Clause
This code is distributed under the 2-Clause BSD License. => BSD-2-Clause
SPDX-License-Identifier: BSD-3-Clause => BSD-3-Clause
Released under the ISC License => ISC
SPDX-License-Identifier: ISC => ISC
SPDX-License-Identifier: Zlib => Zlib
Licensed under the zlib License. => Zlib
Everything here is in the public domain, do what you like. => none
See the file COPYING for the license terms of this package. => none
Dual licensed: the terms are in LICENSE.txt => none
""".strip().splitlines()]


def license_of(template):
    for end in ("-phrase", "-header", "-text", "-full-text", "-opening", "-notice"):
        template = template.removesuffix(end)
    return template.removesuffix("-full")


def test_ordinary_notices_are_named(spark):
    rows = [(i, text.replace("\\n", "\n"), "s") for i, (text, _) in enumerate(NOTICES)]
    got = {r.id: {license_of(n.template) for n in r.notices} for r in licenses.scan(frame(spark, rows)).collect()}
    want = {i: set() if name == "none" else {name} for i, (_, name) in enumerate(NOTICES)}
    wrong = [(NOTICES[i], got[i]) for i in want if got[i] - want[i]]
    missed = [NOTICES[i] for i in want if want[i] - got[i]]
    assert not wrong and len(missed) <= 0.1 * len(NOTICES), (wrong, missed)
    assert {r.id: len(r.notices) for r in licenses.scan(frame(spark, [(1, "The GNU General Public License is a license.", "s"), (2, "They license music under terms that the MIT Press likes.", "s"), (3, "GPL or not, that license fits.", "s")])).collect()} == {1: 0, 2: 0, 3: 0}


def test_notices_are_named_and_differences_shown(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, "prose here\nReleased under the MIT License.\nmore prose", "s"), (2, "Licensed under CC BY-NC 4.0.", "s"), (3, "Licensed under CC BY-SA 4.0.", "s"), (4, "my driving license expired", "s"), (5, None, "s"), (6, "", "s")]
    rows += [(7, mit.replace("free of charge", "for a charge"), "s"), (8, "This work is licensed under the GNU General Public License, version 2.", "s"), (9, "All rights reserved.\n\nAll rights reserved.", "s")]
    got = {r.id: r for r in licenses.scan(frame(spark, rows)).collect()}
    name = lambda i: [n.template for n in got[i].notices]
    assert name(1) == ["MIT"] and got[1].notices[0].line == 1
    assert name(2) == ["CC-BY-NC-4.0"] and name(3) == ["CC-BY-SA-4.0"] and name(8) == ["GPL-2.0"]
    assert name(4) == [] and got[4].n_blocks == 1 and name(5) == name(6) == []
    assert name(7) == ["MIT-text"] and got[7].notices[0].differences == ["-free", "-of", "+for", "+a"]
    assert name(9) == ["all-rights-reserved"] * 2
    assert licenses.scan(empty(spark)).count() == 0


def test_every_template_knows_itself():
    m = licenses.Matcher()
    for name, text in licenses.TEMPLATES.items():
        assert m.identify(text)[0] == name and m.identify(text)[2] == ()


def test_notices_inside_long_lines_are_found(spark):
    rng = random.Random(5)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": licenses.TEMPLATES["GPL-3.0"]}
    rows = [(100 * k + j, f"{prose(rng, n)}. {text} {prose(rng, n)}", "s") for k, text in enumerate(notices.values()) for j, n in enumerate([15, 60, 300, 5000])]
    got = {r.id: [(n.template, list(n.differences)) for n in r.notices] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {100 * k + j: [(name, [])] for k, name in enumerate(notices) for j in range(4)}


def test_wording_decides_alone():
    m = licenses.Matcher()
    assert m.identify("This work is licensed under the GNU Affero General Public License, version 3.").template == "AGPL-3.0-phrase"
    assert licenses.Matcher(dict(licenses.TEMPLATES)).identify("This work is licensed under the GNU Affero General Public License, version 3.") is None  # not GPL, where short notices aren't known
    assert m.identify("This work is licensed under the GNU General Public License, version 1.") is None
    found = m.identify("see the files. " * 40 + "This work is now licensed under the GNU General Public License, version 3.")
    assert found.template == "GPL-3.0" and found.differences == ("+now",)


def test_a_block_yields_all_its_notices(spark):
    apache, mit, header = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    rows = [(1, f"{apache}\n{mit}", "s"), (2, f"Copyright 2020 Jane Doe. All rights reserved.\n{mit}", "s"), (3, f"{mit} {apache} {mit}\n{mit}", "s"), (4, f"{header}\n{apache} All rights reserved.", "s")]
    got = {r.id: [(n.line, n.template) for n in r.notices] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == [(0, "Apache-2.0"), (1, "MIT")]
    assert got[2] == [(0, "all-rights-reserved"), (1, "MIT")]
    assert got[3] == [(0, "MIT"), (0, "Apache-2.0"), (0, "MIT"), (1, "MIT")]
    assert got[4] == [(0, "Apache-2.0-header"), (1, "Apache-2.0"), (1, "all-rights-reserved")]


def test_full_wordings_are_found_as_they_are_wrapped(spark):
    import textwrap

    def wrapped(name, width, mark=""):
        text = licenses.TEMPLATES[name]
        for start in ("The above copyright notice", "THE SOFTWARE IS", "THIS SOFTWARE IS", "1. ", "2. ", "3. N", "This program is distributed", "You should have"):
            text = text.replace(" " + start, "\n\n" + start)
        return "\n".join(mark + x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""])

    full = ["MIT-full-text", "BSD-2-Clause-text", "BSD-3-Clause-text"] + [f"{x}-{y}" for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for y in ("notice", "opening")]
    rows = [(10 * i + j, "Some prose.\n" + wrapped(name, width, mark) + "\nMore prose.", "s") for i, name in enumerate(full) for j, (width, mark) in enumerate([(40, ""), (70, " * "), (9999, "")])]
    got = {r.id: [(n.line, n.template, list(n.differences)) for n in r.notices] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {10 * i + j: [(1, name, [])] for i, name in enumerate(full) for j in range(3)}


def test_versions_and_names_within_full_wordings():
    m = licenses.Matcher()
    gpl = licenses.TEMPLATES["GPL-3.0-notice"]
    assert m.notices(gpl.replace("version 3", "version 4")) == []
    assert m.notices(gpl.replace("GNU General", "GNU Other General")) == []
    assert [x.template for x in m.notices(gpl.replace("This program", "Frobnicate"))] == ["GPL-3.0-notice"]
    assert [x.template for x in m.notices(gpl[: gpl.index("This program is distributed")])] == ["GPL-3.0-opening"]
    mit = licenses.TEMPLATES["MIT-full-text"]
    assert [x.template for x in m.notices(mit[: mit.index(", and to permit")])] == ["MIT-text"]


# search


def brute_top(rows, is_query, k):
    """(query's place in ``rows``, rank, id, score)."""
    out = []
    for at, (q, x) in enumerate(rows):
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(x, v)), i) for n, (i, v) in enumerate(rows) if n != at and len(v) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0, 3, 60])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "PROBE", 40)
    rng = random.Random(spread)
    centre = [rng.randrange(-50, 50) for _ in range(8)]
    rows = [(i, [c * (i % 5 + 1) + rng.randrange(-spread, spread + 1) for c in centre]) for i in range(300)]
    rows += [(1000 + i, centre) for i in range(120)] + [(2000, [0] * 8), (2001, [1, 2])]
    rows += [(20, [7] * 8), (20, [7] * 8), (40, centre), (41, centre), (41, centre)]  # repeated ids are rows, and queries, each
    table = spark.createDataFrame(rows + [(3000, None), (None, centre)], "id long, v array<bigint>")
    got = topk.exact_top_k(table, table.id % 20 == 0, k=9)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, lambda i: i % 20 == 0, 9)
    assert got.groupBy("query_row").count().where("count <> 9").count() == 0


def test_top_k_of_nothing_and_of_bad_vectors(spark):
    table = spark.createDataFrame([(20, [1.0, 0.5]), (21, [1.0, None]), (22, [float("nan"), 1.0]), (23, None), (24, [float("inf"), 1.0]), (25, [-0.01, 0.0])], "vec_id long, embedding array<float>")
    rows = table.select(table.vec_id.alias("id"), topk.whole_numbers().alias("v"))
    best = lambda rows: [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(rows, rows.id % 20 == 0).collect()]
    assert best(rows) == [(20, 1, 25, -64)]
    assert best(rows.limit(0)) == [] and best(rows.where("id = 25")) == []


def test_large_components_are_ranked_exactly(spark):
    big = [1e9, 3.4e38, 1e25, 2.0**57]
    rows = [(20 + i, [x, 1.0]) for i, x in enumerate(big)] + [(60, [1.0, 1.0]), (61, [1e9, -1.0]), (62, [-1e30, 0.0]), (63, [1e25, 1.0]), (64, [0.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.select(table.vec_id.alias("id"), topk.whole_numbers().alias("v"))
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(table, table.id % 20 == 0).collect())
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == [(q, n, i, clip(s)) for q, n, i, s in brute_top(whole, lambda i: i % 20 == 0, 20)]
