"""Op 12 against brute force: features as strings, sums as dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def features(text, most, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1))


def truth(docs, target, buckets, most, min_words, percent, seed):
    rows = [(d, len(words(t)), features(t, most, buckets)) for d, t in docs]
    s, t = sum((x[2] for x in rows), Counter()), sum((features(x, most, buckets) for x in target), Counter())
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in rows:
        weight = sum(gain[b] * c for b, c in f.items())
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, f.total(), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[2] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranks = [(d, f, w, sc, i + 1 if i < percent * len(able) // 100 else None) for i, (d, f, n, w, sc) in enumerate(able)]
    return sorted(ranks + [(d, f, w, sc, None) for d, f, n, w, sc in out if n < min_words], key=repr)


def tables(rng):
    pool = ["apple", "Größe", "x1", "ÉTÉ", "été", "B", "don", "9", "long" * 40, "naïve", "日本"]
    say = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choice(pool) for _ in range(n))
    docs = [(i, say(rng.choice([0, 1, 5, 19, 20, 21, 60, 300]))) for i in range(160)]
    docs += [(None, None), (None, say(40)), (3, docs[3][1]), (500, None), (501, ""), (502, "z " * 20000)]
    docs += [(7, docs[20][1])] * 9
    return docs, [say(30) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("buckets,most,percent", [(10000, 1, 10), (50, 3, 35), (300, 2, 100)])
def test_importance(spark, buckets, most, percent):
    docs, target = tables(random.Random(buckets))
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, weight int, idx string").repartition(5)
    bench = spark.createDataFrame([(t, "w") for t in target], "text string, doc_id string").repartition(2)
    got = importance.importance(table, bench, buckets, most, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = truth(docs, target, buckets, most, 20, percent, 2024)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r.rank for r in importance.importance(table, bench.where("false"), buckets, most, 20, percent).collect()} == {x[4] for x in want}
    assert importance.importance(table.where("false"), bench, buckets, most).count() == 0


def test_rows_of_the_matrix():
    docs, _ = tables(random.Random(8))
    texts = [(t or "").encode() for _, t in docs]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    m = importance.sparse_rows(np.frombuffer(b"".join(texts), np.uint8), offsets, 997, 3)
    at = 0
    for (_, t), end in zip(docs, m.ends):
        assert dict(zip(m.indices[at:end].tolist(), m.counts[at:end].tolist())) == dict(features(t, 3, 997))
        at = end
