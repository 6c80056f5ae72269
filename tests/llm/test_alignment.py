"""Alignment of two tokenizers against a plain version with byte sets."""

import hashlib
import os
from collections import Counter

import pytest

from palimpsest.llm import alignment
from tests.llm.helpers import awkward, empty, frame

FILES = [os.path.join(alignment.TOKENIZERS, f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
pytestmark = pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="no tokenizer files")

ODD = [
    (3000, "naïve façade — 東京タワー 🙂🙃 é", "s"),
    (3001, "a▁b is not a space", "s"),
    (3002, "nul\0 tab\t\ttwo  spaces   three \n\n end ", "s"),
    (3003, "<|endoftext|> <s> </s> <unk> <0x41>", None),
    (3004, " leading", "s"),
    (3005, "=" * 3000 + "-" * 77, "s"),
    (3006, " 　x\r\n", "s"),
    (3007, "the the the the", "s"),
    (3008, "x▁ y a▁ ▁b fine words", "s"),
    (3009, "a\u00a0 b \u2003c\u180e d\x1c e \x85 f\u200b g don't I'll 've 12 345 'll", "s"),
    (3010, "日本 語 の 文 です 。 12 ３ é́ e\u0301 x", "s"),
]


def plain(rows, kind):
    """Per row and pair, with no more than the definition."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    coder_a, coder_b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    coder_a.encode_special_tokens = True
    byte_of = alignment._byte_of_character()
    out, count = [], Counter()
    for id_, text, _ in rows:
        whole = (" " + (text or "")).encode()
        a = coder_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = coder_b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in coder_a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(coder_b.id_to_piece, b)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((id_, 0, 0, 0, [], ""))
            continue
        end_a = [sum(map(len, bytes_a[: i + 1])) for i in range(len(a))] if len(a) < 400 else _ends(bytes_a)
        end_b = [sum(map(len, bytes_b[: i + 1])) for i in range(len(b))] if len(b) < 400 else _ends(bytes_b)
        cuts = sorted(set(end_a) & set(end_b))
        groups, found, i, j = [], [], 0, 0
        for cut in cuts:
            x, y = i, j
            while x < len(a) and end_a[x] <= cut:
                x += 1
            while y < len(b) and end_b[y] <= cut:
                y += 1
            groups.append((a[i:x], b[j:y]))
            found += [(a[x - 1], b[y - 1])] if kind == "ends" else [(p, q) for p in a[i:x] for q in b[j:y]]
            i, j = x, y
        assert (i, j) == (len(a), len(b))
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        count.update(found)
        out.append((id_, len(a), len(b), len(groups), found, hashlib.sha256(listed.encode()).hexdigest()))
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(highest.get(y, 0), n)
    full = [(i, x, y, g, len(f), sum(count[p] == highest[p[1]] for p in f), sum(count[p] for p in f), s) for i, x, y, g, f, s in out]
    return full, {(x, y, n, n == highest[y]) for (x, y), n in count.items()}


def _ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


@pytest.mark.parametrize("kind,frequent,known,step", [("ends", 50_000, 1 << 20, 1 << 20), ("ends", 20, 10, 1 << 20), ("members", 20, 1 << 20, 7)])
def test_alignment_is_what_the_definition_says(spark, monkeypatch, kind, frequent, known, step):
    rows = awkward() + ODD
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "KNOWN_CHARS", known)
    monkeypatch.setattr(alignment._kernel.steps, "__defaults__", (1 << 19 if known > 10 else 900,))
    monkeypatch.setattr(alignment, "STEP_LINKS", step)
    texts, pairs = alignment.align(frame(spark, rows), alignment.Vocabularies.read(*FILES), kind)
    key = lambda r: tuple((x is not None, x) for x in r)
    want, want_pairs = plain(rows, kind)
    assert sorted((tuple(r) for r in texts.collect()), key=key) == sorted(want, key=key)
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    by_id = {r[0]: r for r in want}
    assert by_id[3001][1] == 0 and by_id[3002][1] > 0 and by_id[3003][1] > 0


def test_components_are_those_of_the_graph():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 30)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(40))]
        want = list(range(n))
        for _ in range(n):
            for x, y in edges:
                want[x] = want[y] = min(want[x], want[y])
        x, y = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        assert alignment.components(x, y, n).tolist() == want


def test_no_rows(spark):
    texts, pairs = alignment.align(empty(spark), alignment.Vocabularies.read(*FILES))
    assert texts.count() == pairs.count() == 0
    texts, pairs = alignment.align(frame(spark, [(1, None, None), (2, "", "s")]), alignment.Vocabularies.read(*FILES))
    assert sorted(tuple(r) for r in texts.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert pairs.count() == 0
