"""Null and repeated doc_ids, empty tables and clashing columns in ops 5, 9 and 10."""

import hashlib

from quire.llm import cms, jaccard, tokencount
from quire.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, block_id string, hash int, node string, sig int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "n", 2) for i, t in rows], SCHEMA).repartition(3)


def order(i):
    return (i is None, i or 0)


A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(20))
ROWS = [(5, A), (5, A + " x"), (None, A), (None, B), (2, B), (2, B), (9, A + " " + B), (1, ""), (3, None), (7, "a b"), (8, "a b"), (4, "c")]


def test_windows(spark):
    first = {}
    for i, t in ROWS:
        w = (t or "").split()
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, order(i)), order(i))
    want = []
    for i, t in ROWS:
        w = (t or "").split()
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < order(i):
                gone |= set(range(j, j + 13))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, cms.dedup_windows(frame(spark, ROWS)).collect()), key=str) == sorted(want, key=str)
    assert cms.dedup_windows(frame(spark, [])).count() == 0


def test_classes(spark):
    sets = []
    for _, t in ROWS:
        w = (t or "").split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {r: min((ROWS[i][0] for i in range(len(ROWS)) if root[i] == r), key=order) for r in root}
    want = sorted(((ROWS[i][0], len(sets[i]), least[root[i]]) for i in range(len(ROWS))), key=str)
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, ROWS)).collect()), key=str) == want
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0 and jaccard.keep_first(frame(spark, [])).count() == 0


def test_counts(spark):
    path = vocabulary("byte_bpe_50k.json")
    got = tokencount.token_counts(frame(spark, ROWS), path).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=str) == sorted(((i, len(t or "")) for i, t in ROWS), key=str)
    assert tokencount.token_counts(frame(spark, []), path).count() == 0
