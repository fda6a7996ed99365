"""Op 4 against brute force, by both ways of joining seeds."""

import random
import re

import pytest

from quire.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]


def truth(docs, items):
    out = []
    for d, text in docs:
        w = words(text)
        for i, t in items:
            v = words(t)
            if i is None or not v:
                continue
            width, best = min(13, len(v)), None
            for diagonal in range(-len(v) + 1, len(w)):
                same = [0 <= diagonal + j < len(w) and w[diagonal + j] == v[j] for j in range(len(v))]
                if any(100 * sum(same[j : j + width]) >= 80 * width for j in range(len(v) - width + 1)):
                    got = (sum(same), -max(0, diagonal))
                    best = max(best or got, got)
            if best:
                out.append((d, i, best[0], len(v), -best[1]))
    return sorted(out, key=str)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "the Quick brown fox jumps; quick brown FOX"), (2, "quick fox"), (3, "fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "fox"), (2, "fox"), (3, "brown dog")], "item_id long, text string")
    assert sorted(map(tuple, decontam.leaks(docs, items).collect())) == [(1, 1, 3, 3, 1), (1, 2, 1, 1, 3), (2, 2, 1, 1, 1), (3, 2, 1, 1, 0)]
    assert decontam.clean(docs, items).count() == 3


def cases(rng):
    pool = [f"w{i}" for i in range(60)] + ["Été", "x-ray", "K9"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 20, 40]))) for i in range(40)]
    items += [(3, items[3][1]), (90, items[5][1]), (91, None), (92, ""), (93, "one two"), (None, items[1][1])]
    docs = [(0, None), (1, ""), (2, say(30))]
    for i in range(150):
        own = items[rng.randrange(40)][1].split()
        for at in rng.sample(range(len(own)), rng.randint(0, len(own) // 4)):
            own[at] = "changed"
        docs.append((10 + i, f"{say(rng.randint(0, 20))}. {' '.join(own[rng.randint(0, 2) :]).upper()} , {say(rng.randint(0, 20))}"))
    return docs + [(10, docs[5][1]), (10, docs[5][1]), (None, docs[7][1])], items


@pytest.mark.parametrize("most", [4 << 20, 0])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "PART_BYTES", most)
    docs, items = cases(random.Random(12))
    table = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, seed string, gone int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = truth(docs, list(dict.fromkeys(items)))
    got = sorted(map(tuple, decontam.leaks(table, bench).collect()), key=str)
    assert got == want
    leaking = {t for d, t in docs if any(x[3] >= decontam.MIN_WORDS for x in truth([(d, t)], items))}
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((d for d in docs if d[1] not in leaking), key=str)
    none, nothing = bench.where("false"), table.where("false")
    assert decontam.leaks(table, none).count() == 0 and decontam.clean(table, none).count() == len(docs)
    assert decontam.leaks(nothing, bench).count() == 0 and decontam.clean(nothing, bench).count() == 0
