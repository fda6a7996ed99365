"""Op 3 in hard cases: periodic texts, one letter, null and repeated ids, an empty table, and small ranges."""

import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import lpf


def truth(rows, length=50):
    """By row: a null id counts as the largest, and rows with one id do not remove each other's bytes."""
    order = lambda i: (i is None, i or 0)
    first = {}
    raw = [(order(i), (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            if w not in first or i < first[w]:
                first[w] = i
    out = []
    for (i, t), (own, _) in zip(raw, rows):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < i:
                gone[j : j + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((own, len(t), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 3, "s") for i, t in rows], "doc_id long, text string, size int, key string").repartition(3)
    return sorted(map(tuple, lpf.dedup_substrings(docs).collect()), key=str)


@pytest.mark.parametrize("hot,range_", [(512, 1 << 17), (2, 64), (512, 16)])
def test_hard_texts(spark, monkeypatch, hot, range_):
    monkeypatch.setattr(lpf, "HOT", hot)
    monkeypatch.setattr(lpf, "RANGE", range_)
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    passage = say(200)
    rows = [(3, "a" * 700), (1, "a" * 80), (2, "ab" * 300), (9, "b" + "a" * 400 + "b"), (None, "ab" * 100 + passage), (None, passage), (7, passage), (7, passage + "x"), (7, "a" * 60), (4, None), (5, ""), (6, "a" * 50), (8, "a" * 49)]
    rows += [(20 + i, say(60) + passage[i : i + 120] + say(60) + "abc" * 50) for i in range(10)]
    rows += [(40, "é" * 100), (41, "x" + "é" * 100)]
    assert found(spark, rows) == truth(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_the_query_takes_its_verdicts_from_the_factors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    at, place = np.arange(500), np.repeat(np.arange(10), 50)
    want = [any(place[j] < place[i] and (text[at[j] : at[j] + 9] == text[at[i] : at[i] + 9]).all() for j in range(500)) for i in range(500)]
    for size in (1 << 17, 40, 7):
        monkeypatch.setattr(lpf, "RANGE", size)
        assert lpf.reaching(text, at, place, 9).tolist() == want
    monkeypatch.setattr(lpf, "RANGE", 1 << 17)
    monkeypatch.setattr(lpf, "longest_previous", lambda order, common, place: np.zeros(len(order), np.int64))
    assert not lpf.reaching(text, at, place, 9).any()
