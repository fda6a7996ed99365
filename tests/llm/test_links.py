"""Links of op 10 in hard cases: lists longer than a part, random near copies, and words that collide in weak hashes."""

import random

import pytest

from quire.llm import blocks, cms, jaccard, quality


def truth(rows, k=5):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


def family(rng, n, words, changes):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, changes)):
            own[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("part,proposed,most_light", [(512, 1, None), (7, 1, None), (3, 2, 1), (5, 1, 10**6)])
def test_families(spark, monkeypatch, part, proposed, most_light):
    rng = random.Random(part)
    texts = family(rng, 60, 120, 4) + family(rng, 40, 30, 1) + family(rng, 30, 300, 9) + family(rng, 5, 8, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "PROPOSED", proposed)
    if most_light:
        monkeypatch.setattr(jaccard, "boundary", lambda nodes: most_light)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == truth(rows)


def thue_morse(n):
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 8, 9, 64, 65])
def test_words_that_collide_in_a_polynomial(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    tail = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in cms.dedup_windows(docs).orderBy("doc_id").collect()] == [0, 0]
    # two windows of eight words that differ in that word only are no repeats
    text = f"{a} 1 2 3 4 5 6 7 {b} 1 2 3 4 5 6 7"
    data = blocks.np.frombuffer(text.encode(), blocks.np.uint8)
    counts, _ = quality.statistics(data, blocks.np.array([0, len(data)]))
    assert counts[0, 4] == 0


def test_hashes_do_not_depend_on_the_place():
    np = blocks.np
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(1, 100, 3000)
    got = blocks.byte_hashes(data, starts, ends)
    seen = {}
    for h, a, b in zip(got.tolist(), starts.tolist(), ends.tolist()):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
