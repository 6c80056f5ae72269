"""Fixtures that hold what is awkward: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
import re

WORDS = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, id string, v int, h int, token string, size int"


def words(text):
    return re.findall(WORDS, text or "")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "é", ",", "."]) for _ in range(n))


def awkward(seed=7, n=60):
    """(doc_id, text, source) rows with copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 80)
    for i in range(n):
        text = prose(rng, rng.choice([3, 20, 60, 150, 300]))
        rows.append((i, text, f"s{i % 5}"))
    base = rows[4][1] if len(rows[4][1]) > 900 else prose(rng, 200)
    for i in range(n, n + 12):
        w = base.split(" ")
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        rows.append((i, " ".join(w), "s0"))
    for i in range(n + 12, n + 20):
        rows.append((i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30), "s1"))
    rows += [(900, None, None), (901, "", "s1"), (902, " \n\t ", "s2"), (903, "One two", "s2"), (904, "one TWO", None), (905, "ü" * 500, "s3"), (906, "ab" * 3000, "s3"), (907, "ab" * 200 + "c" + "ab" * 200, "s3")]
    rows += [(908, prose(rng, 20000), "s4"), (None, rows[3][1], "s4"), (910, rows[3][1], None), (911, rows[3][1].upper(), "s1"), (911, rows[3][1].upper(), "s1")]
    return rows


def frame(spark, rows):
    """As a table with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), 1, "x", 2, 3, "y", 4) for i, t, s in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
