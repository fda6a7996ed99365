"""Intervals of trees of depth 1 to 50 against plain walks."""

import random

import pytest

from quire.operators import trees as R


def forest(rng):
    """Documents: a chain of 50, a star, random trees, two roots, a parent that is not there."""
    up = {1: {i: i - 1 if i else None for i in range(51)}, 2: {i: 0 if i else None for i in range(30)}, 3: {0: None, 5: None, 7: 5, 6: 0}, 4: {1: 99, 2: 1}}
    for d in range(5, 15):
        names = rng.sample(range(1000), rng.randint(1, 60))
        up[d] = {n: rng.choice(names[:i]) if i else None for i, n in enumerate(names)}
    return up


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(9)
    up = forest(rng)
    rows = [(d, n, p, rng.random() < 0.2, rng.random() < 0.5, rng.randint(0, 9)) for d, t in up.items() for n, p in t.items()]
    nodes = spark.createDataFrame(rows, "doc_id long, node long, parent long, hidden boolean, inline boolean, v long").repartition(3)
    return up, rows, nodes, R.numbered(nodes)


def chain(up, d, n):
    out = [n]
    while up[d][out[-1]] in up[d]:
        out.append(up[d][out[-1]])
    return out


def test_numbers(trees):
    up, rows, _, numbers = trees
    got = {(r.doc_id, r.node): r for r in numbers.collect()}
    assert len(got) == len(rows)
    for (d, n), r in got.items():
        assert r.path == chain(up, d, n)[::-1] and r.depth == len(r.path) - 1
        below = {m for m in up[d] if n in chain(up, d, m)}
        assert {m for m in up[d] if r.pre <= got[d, m].pre <= r.last} == below
    assert max(r.depth for r in got.values()) == 50


def test_hidden_subtrees(trees):
    up, rows, nodes, numbers = trees
    hidden = {(d, n) for d, n, _, h, _, _ in rows if h}
    want = {(d, n) for d, n, *_ in rows if not any((d, a) in hidden for a in chain(up, d, n))}
    assert {tuple(r) for r in R.shown(numbers, nodes).collect()} == want


def test_owners_and_sums(trees):
    up, rows, nodes, numbers = trees
    inline = {(d, n): i for d, n, _, _, i, _ in rows}
    value = {(d, n): v for d, n, *_, v in rows}
    owners = {(r.doc_id, r.node): r.owner for r in R.owners(numbers, nodes).collect()}
    sums = {(r.doc_id, r.node): r.total for r in R.subtree_sums(numbers, nodes, "v").collect()}
    for d, n, *_ in rows:
        own = chain(up, d, n)
        assert owners[d, n] == next((a for a in own if not inline[d, a]), own[-1])
        assert sums[d, n] == sum(value[d, m] for m in up[d] if n in chain(up, d, m))


def test_texts_reach_any_depth(spark):
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, i > 0, 0, 20 - i) for i in range(20)] + [(1, 30, 3, False, 0, 1)], "doc_id long, node long, parent long, inline boolean, ref_page long, ref long")
    blocks = spark.createDataFrame([(1, 0, i, f"t{i} ") for i in range(21)], "doc_id long, page_no long, ord long, text string")
    got = {r.node: r.text for r in R.node_texts(R.numbered(nodes), nodes, blocks).collect()}
    assert got == {0: " ".join(f"t{i}" for i in range(1, 21)), 30: "t1"}


def test_circles_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(R, "ROUNDS", 5)
    with pytest.raises(ValueError, match="circle"):
        R.numbered(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "doc_id long, node long, parent long"))
    assert R.numbered(spark.createDataFrame([], "doc_id long, node long, parent long")).count() == 0
