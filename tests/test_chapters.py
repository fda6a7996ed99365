"""Chapters against a plain walk over the units."""

import random

from quire.operators import sinks


def truth(units):
    count = {}
    for _, level, _ in units:
        if level is not None:
            count[level] = count.get(level, 0) + 1
    seen, cut = 0, 6
    for level in range(1, 7):
        seen += count.get(level, 0)
        if seen >= 2:
            cut = level
            break
    parts = []
    for u in units:
        if not parts or u[1] is not None and u[1] <= cut:
            parts.append([])
        parts[-1].append(u)
    weight = lambda p: sum(u[2] for u in p)
    i = 0
    while i < len(parts) and len(parts) > 1:
        if weight(parts[i]) >= sinks.MIN_CHAPTER:
            i += 1
        elif i + 1 < len(parts):
            light = parts.pop(i)
            parts[i] = light + parts[i]
        else:
            light = parts.pop(i)
            parts[i - 1] += light
    return [(i + 1, p[0][0], p[-1][0], weight(p)) for i, p in enumerate(parts)]


def test_chapters(spark):
    rng = random.Random(2)
    docs = {d: [(i, rng.choice([None, None, 1, 2, 3, 4]), rng.choice([0, 30, 120, 400])) for i in range(rng.randint(1, 25))] for d in range(60)}
    rows = [(d, *u) for d, us in docs.items() for u in us]
    found = {}
    for r in sinks.chapters(spark.createDataFrame(rows, "doc_id long, ord long, level long, weight long")).collect():
        found.setdefault(r.doc_id, []).append((r.chapter, r.first, r.last, r.weight))
    assert {d: sorted(c) for d, c in found.items()} == {d: truth(us) for d, us in docs.items()}
