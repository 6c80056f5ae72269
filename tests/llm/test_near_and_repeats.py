"""Near duplicates and repeats against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import _kernel, components, minhash, repeats
from palimpsest.llm._scratch import settled
from tests.llm.helpers import awkward, empty, frame, prose, words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out += [(rows[m][0], len(sets[m]), min(ids) if ids else None) for m in members]
    return sorted(out, key=repr)


def test_near_duplicates_match_brute_force(spark):
    rows = awkward()
    got = minhash.near_duplicates(frame(spark, rows)).select("id", "n_shingles", "component").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_a_group_without_a_common_centre(spark):
    rng = random.Random(3)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(60):  # a chain: neighbours are linked, ends are far apart
        base = list(base)
        base[rng.randrange(len(base))] = f"x{i}"
        rows.append((i, " ".join(base), "s"))
    got = minhash.near_duplicates(frame(spark, rows)).select("id", "n_shingles", "component").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None, None), (2, "", None)])).select("id", "component").orderBy("id").collect() == [(1, 1), (2, 2)]


def test_representatives_keep_one_row_of_each_component(spark):
    rows = [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (None, "a b c d e f", "s"), (7, None, "s"), (None, "z y x", "s")]
    docs = settled(frame(spark, rows))
    assert minhash.representatives(docs).count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (200, 200), (300, 250)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 300: 250, 250: 250}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 750, dtype=np.uint64)
    x, y = (np.concatenate([both, rng.integers(0, 2**63, 125, dtype=np.uint64)]) for _ in range(2))
    assert (minhash.signature(x) == minhash.signature(y)).sum() >= minhash.MATCHES


@given(st.lists(st.text(alphabet="ab \n\tüA", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_of_many_texts(texts):
    import pyarrow as pa

    for lo, hi, raw, offsets in _kernel.steps(pa.array(texts, pa.string()), limit=16):
        w = _kernel.Words(raw, offsets)
        got = [[raw[s:e].tobytes().decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])] for d in range(hi - lo)]
        assert got == [words(t) for t in texts[lo:hi]]


def brute_removed(rows, n):
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for (doc_id, _, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted((x for x in out if x[1]), key=repr)


def test_repeats_match_brute_force_on_both_ways(spark):
    rows = awkward(seed=11)
    docs = settled(frame(spark, rows))
    ids = repeats.rows_with_id(docs, "doc_id")
    expected = brute_removed(rows, 200)
    for most in (repeats.MOST_SUFFIXES, 1):
        found = repeats.repeated_bytes(docs, most=most).join(ids, "rid").select("doc_id", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, found.collect()), key=repr) == expected


@pytest.mark.parametrize("alone", [True, False])
def test_repeats_of_periodic_texts_match_brute_force_on_both_ways(spark, alone):
    """Grams of one hash close to each other share a context: alone in it, and with tails of their own."""
    rng = random.Random(31)
    texts = ["b" * 201]
    if not alone:
        for _ in range(60):
            parts = [""]
            for _ in range(rng.randrange(1, 5)):
                period = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 240)))
                old = rng.choice(texts)
                at = rng.randrange(len(old) + 1)
                parts.append(rng.choice([(period * 600)[: rng.randrange(1, 600)], old[at : at + rng.randrange(1, 800)], period]))
            texts.append("".join(parts))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = settled(frame(spark, rows))
    ids = repeats.rows_with_id(docs, "doc_id")
    expected = brute_removed(rows, 200)
    for most in (repeats.MOST_SUFFIXES, 1):
        found = repeats.repeated_bytes(docs, most=most).join(ids, "rid").select("doc_id", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, found.collect()), key=repr) == expected


def all_places(raw, x):
    return {(d, i) for d, b in enumerate(raw) for i in range(len(b) - len(x) + 1) if b.startswith(x, i)}


def brute_maximal(raw, n):
    """Strings of ``n`` bytes or more with two places whose neighbours differ on both sides; the ends of a text differ from all."""
    out, todo = {}, {b[i : i + n] for b in raw for i in range(len(b) - n + 1)}
    while todo:
        x = todo.pop()
        at = all_places(raw, x)
        if len(at) < 2:
            continue
        after = {raw[d][i + len(x)] if i + len(x) < len(raw[d]) else (d,) for d, i in at}
        before = {raw[d][i - 1] if i else (d,) for d, i in at}
        if len(after) > 1 and len(before) > 1:
            out[x] = at
        todo |= {x + bytes([y]) for y in after if not isinstance(y, tuple)}
    return out


@pytest.mark.parametrize("case", ["XXYY", "XXY", "mixed"])
def test_groups_are_the_maximal_repeats_with_all_their_places(spark, case):
    n, gram, rng = 24, 6, random.Random(len(case))
    letters = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = letters(40)
    x, y = letters(50) + passage + letters(30), letters(20) + passage + letters(60)
    texts = {"XXYY": [x, x, y, y], "XXY": [x, x, y]}.get(case)
    if texts is None:
        texts = [x, y, x, letters(90), "ab" * 60, "q" + "ab" * 40, passage[:30] + letters(9), passage[5:] + passage[:35], "z" * 70 + passage, "", None, "short"]
        texts += [letters(15) + passage[:28] + letters(15) for _ in range(4)]
    raw = [(t or "").encode() for t in texts]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    seen = []
    for most in (repeats.MOST_SUFFIXES, 2):
        groups = {}
        for r in repeats.repeat_groups(docs, min_length=n, gram=gram, most=most).collect():
            groups.setdefault(r.group, []).append((r.length, r.id, r.s))
        strings = {}
        for members in groups.values():
            assert len({length for length, _, _ in members}) == 1 and len(set(members)) == len(members)
            string = {raw[d][s : s + length] for length, d, s in members}
            assert len(string) == 1
            strings[string.pop()] = {(d, s) for _, d, s in members}
        assert len(strings) == len(groups)
        for string, at in strings.items():
            assert at == all_places(raw, string)
        for string in brute_maximal(raw, n):
            first = np.frombuffer(string[:n], dtype=np.uint8)
            full = int(repeats.contexts(first, np.array([0, n]), n, gram)["full"][0])
            assert string[:full] in strings
        seen.append(strings)
    assert seen[0] == seen[1] and len(seen[0]) > 1


def test_text_without_repeats_is_valid_and_whole(spark):
    rows = [(1, "ü" * 300 + "end", "s"), (2, "x" + "ü" * 300, "s"), (3, "short", None), (4, None, None)]
    out = {r.doc_id: r.text for r in repeats.without_repeats(frame(spark, rows)).collect()}
    assert out[3] == "short" and out[4] is None and out[1] == "end" and out[2] == "x"
    assert repeats.without_repeats(empty(spark)).count() == 0


@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"abc", b"aab"]), min_size=1, max_size=60), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_every_window_belongs_to_one_anchor(parts, copies):
    one = b"".join(parts)
    raw, offsets = np.frombuffer(one * copies, dtype=np.uint8), np.arange(copies + 1) * len(one)
    found = repeats.contexts(raw, offsets, 20, 5)
    owner = {}
    for s, w, e, h, full in zip(*(found[x].tolist() for x in ("s", "w", "e", "h", "full"))):
        assert e == min(full, next(o for o in offsets if o > s)) and e >= s + w - 1 + 20
        for p in range(s, s + w):
            assert p not in owner
            owner[p] = h
    assert sorted(owner) == [o + i for o in offsets[:-1] for i in range(len(one) - 19)]
    of = {}
    for p, h in owner.items():  # equal windows have one anchor
        assert of.setdefault(raw[p : p + 20].tobytes(), h) == h


def test_long_texts_are_cut_where_contexts_end(monkeypatch):
    rng = random.Random(2)
    raw = np.frombuffer((prose(rng, 900) + "ab" * 3000 + prose(rng, 900)).encode(), dtype=np.uint8)
    whole = repeats.contexts(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(repeats, "SEGMENT", 1500)
    parts = list(repeats._of_long_text(raw, 200, 32))
    joined = {k: np.concatenate([x[k] for x in parts]) for k in whole}
    covered = lambda x: [(p, h) for s, w, h in zip(x["s"], x["w"], x["h"]) for p in range(s, s + w)]
    assert len(parts) > 5 and covered(whole) == covered(joined)


def test_files_are_read_in_place_and_shuffles_are_written_first(spark, tmp_path):
    frame(spark, [(1, "a", "s")]).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    assert settled(files) is files and settled(shuffled := files.repartition(2)) is not shuffled


def test_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(9)
    base = prose(rng, 100).split(" ")
    rows = []
    for i in range(90):  # near and not so near copies of one text, some of them linked to each other only
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(w), "s"))
    got = minhash.near_duplicates(frame(spark, rows)).select("id", "n_shingles", "component").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_suffixes_are_sorted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SUFFIXES", 64)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rows = awkward(seed=21, n=25)
    docs = settled(frame(spark, rows))
    found = repeats.repeated_bytes(docs).join(repeats.rows_with_id(docs, "doc_id"), "rid").select("doc_id", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == brute_removed(rows, 200)
