"""Hunks replay to the other text, find the least changes of small texts, and scale to a million words."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from quire.operators import compare as C


def replayed(a, b, found):
    out, at = [], 0
    for _, a0, a1, b0, b1 in found:
        out += a[at:a0] + b[b0:b1]
        at = a1
    return out + a[at:]


@pytest.mark.parametrize("words", ["ab", "abcdefgh", [str(i) for i in range(200)]])
def test_hunks_turn_one_text_into_the_other(words):
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        b = list(a) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = [rng.choice(words) for _ in range(rng.randint(0, 3))]
        for bridge in (0, 3):
            found = C.hunks(a, b, bridge)
            assert replayed(a, b, found) == b
            assert all(y[1] - x[2] > bridge for x, y in zip(found, found[1:]))


def longest(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_alignment_is_the_longest(monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = C.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b)


def test_stretches_without_anchors(monkeypatch):
    a, b = ["x"] * 600 + ["y"] * 600, ["y"] * 600 + ["x"] * 600
    assert replayed(a, b, C.hunks(a, b)) == b and C.hunks(a, b) == [("replace", 0, 1200, 0, 1200)]
    monkeypatch.setattr(C, "WORK", 10_000_000)
    assert sum(h[2] - h[1] for h in C.hunks(a, b)) == 600


def test_a_million_words_in_linear_memory():
    rng = random.Random(1)
    a = [f"w{rng.randint(0, 300_000)}" for _ in range(1_000_000)]
    b = list(a)
    for _ in range(2000):
        at = rng.randint(0, len(b) - 20)
        b[at : at + rng.randint(0, 9)] = [f"n{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9))]
    tracemalloc.start()
    began = time.time()
    found = C.hunks(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert replayed(a, b, found) == b and 1000 < len(found) <= 2000
    assert peak < 400e6 and time.time() - began < 120


def test_sections(spark):
    text = "intro one\n# First *h*\nfoo bar\n\n## Second\nbaz\n#no heading"
    other = "intro two\n# First *h*\nfoo qux bar\n\n## Third\nbaz\n#no heading more"
    texts = spark.createDataFrame([(1, text, other), (2, "same", "same"), (3, None, "all new")], "doc_id long, a string, b string")
    heads = C.markdown_headings(texts.selectExpr("doc_id", "a as text"))
    assert sorted(map(tuple, heads.collect())) == [(1, 2, "First *h*"), (1, 7, "Second")]
    found = C.sections(C.compare(texts), heads)
    got = sorted((r.doc_id, r.kind, r.was, r.becomes, r.section) for r in found.collect())
    # up to three equal words lie between the later changes, so they are one hunk, which begins in the first section
    assert got == [(1, "replace", "bar ## Second baz #no heading", "qux bar ## Third baz #no heading more", "First *h*"), (1, "replace", "one", "two", None), (3, "insert", "", "all new", None)]
    assert C.compare(texts.where("false")).count() == 0
