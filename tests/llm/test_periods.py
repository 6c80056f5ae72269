"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import periods
from tests.llm.helpers import awkward, empty, frame, words


def brute_runs(w):
    """All (start, length, period): for each period the stretches that keep it; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def brute_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = brute_planted(doc_id, words(text)) if doc_id is not None else words(text)
    found = brute_runs(w)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    power = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, power, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def periodic_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("ab c dd é".split()) for _ in range(rng.randrange(1, 9))]
            parts += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
        rows.append((i, " ".join(parts), "s"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_runs_match_a_plain_search(spark, seed, monkeypatch):
    rows = periodic_rows(seed) + [r for r in awkward() if r[0] != 908 and len(r[1] or "") < 2500]
    if seed:
        monkeypatch.setattr(periods, "STEP_WORDS", 50)
        monkeypatch.setattr(periods, "STEP_PAIRS", 17)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r)[:8] for r in periods.periodic_runs(frame(spark, rows), edit=periods.planted).collect()), key=key)
    assert got == sorted((brute_row(i, t) for i, t, _ in rows), key=key)
    assert sum(r[1] for r in got) > 100


@pytest.mark.parametrize("seed", range(20))
def test_extensions_are_what_words_say(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 60, 5)
    sequences = [rng.integers(0, 2 + seed % 3, n) for n in sizes]
    shifted = np.concatenate([s + 10 * i for i, s in enumerate(sequences)])
    end = np.repeat(np.cumsum(sizes), sizes)
    array = periods.SuffixArray(shifted, end)
    for i in range(5):
        at = np.cumsum(sizes)[i] - sizes[i]
        for a in range(sizes[i]):
            for b in range(a):
                want = 0
                while a + want < sizes[i] and sequences[i][a + want] == sequences[i][b + want]:
                    want += 1
                assert array.extension(np.array([at + a]), np.array([at + b]))[0] == want


def test_a_long_periodic_text_and_no_rows(spark):
    unit = [f"w{i}" for i in range(7000)]
    rows = [(3, " ".join(["lead"] + unit * 5 + ["end"]), None), (4, "x " * 100_000, None), (3, " ".join(["lead"] + unit * 5 + ["end"]), None)]
    got = sorted(tuple(r)[:6] for r in periods.periodic_runs(frame(spark, rows)).collect())
    assert got == [(3, 1, 1, 35_000, 7000, 5000)] * 2 + [(4, 1, 0, 100_000, 1, 100_000_000)]
    assert periods.periodic_runs(empty(spark)).count() == 0
