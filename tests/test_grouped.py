"""Operators by group: cases whose answer is plain, and brute force where there is one."""

import random
import unicodedata

from quire.operators import grouped as G


def run(no, x0, y0, x1, y1, size=10, axis=0):
    return {"run": no, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": size, "axis": axis}


def numbers(lines):
    return [[r["run"] for r in line] for line in lines]


def test_lines_join_overlapping_runs_and_part_at_gaps():
    runs = [run(1, 0, 0, 20, 10), run(2, 22, 2, 40, 12), run(3, 100, 1, 120, 11), run(4, 0, 20, 30, 30)]
    assert numbers(G.lines_of(runs)) == [[1, 2], [3], [4]]
    assert numbers(G.lines_of([run(1, 0, 0, 20, 10), run(2, 21, 0, 40, 10, axis=90)])) == [[1], [2]]
    # a large letter over a small one is no neighbour
    assert numbers(G.lines_of([run(1, 0, 0, 20, 30, size=30), run(2, 2, 5, 12, 15)])) == [[2], [1]]


def test_gate():
    assert G.gate([0.1, 0.9]) == G.STYLE
    assert 0.1 < G.gate([0.0, 0.02, 0.03, 0.05, 1.0, 1.1, 1.0]) < 1.0
    assert G.gate([0.01] * 8) == float("inf")


def block(no, x0, y0, x1, y1):
    return {"ord": no, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def test_two_columns_are_read_one_after_the_other():
    left = [block(i, 50, 100 + 100 * i, 450, 185 + 100 * i) for i in range(4)]
    right = [block(10 + i, 520, 40 + 115 * i, 950, 153 + 115 * i) for i in range(4)]
    assert [r["ord"] for r in G.page_order(left + right)] == [0, 1, 2, 3, 10, 11, 12, 13]
    assert [r["ord"] for r in G.reading_order([block(2, 0, 50, 10, 60), block(1, 0, 0, 10, 10), block(3, 5, 5, 5, 9)])] == [1, 2, 3]
    assert G.page_order([]) == []


def test_a_wide_head_comes_first():
    head = block(9, 50, 10, 950, 60)
    left, right = block(1, 50, 100, 450, 800), block(2, 520, 100, 950, 800)
    assert [r["ord"] for r in G.page_order([left, right, head])] == [9, 1, 2]


def test_every_item_is_read_once():
    rng = random.Random(1)
    for _ in range(50):
        items = [block(i, x := rng.randrange(900), y := rng.randrange(900), x + rng.randrange(0, 300), y + rng.randrange(0, 200)) for i in range(rng.randint(0, 25))]
        assert sorted(r["ord"] for r in G.page_order(items)) == [r["ord"] for r in items]


def test_lines_are_split_at_wide_distances():
    lines = [{"line": i, "y0": y, "y1": y + 10, "size": 10} for i, y in enumerate((0, 12, 24, 60, 72))]
    assert [[r["line"] for r in b] for b in G.split_lines(lines)] == [[0, 1, 2], [3, 4]]


def test_graphics():
    path = lambda z, x: {"z": z, "x0": x, "y0": 0, "x1": x + 10, "y1": 10}
    assert [[p["z"] for p in g] for g in G.graphics([path(1, 0), path(2, 12), path(3, 300), path(4, 311)])] == [[1, 2], [3, 4]]
    assert G.graphics([path(i, 0) for i in range(5)], most=4) == []


def test_first_object():
    assert G.first_object('x {"a": "}\\"{", "b": {"c": 1}} {"d": 2}') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert G.first_object("{ open") is None and G.first_object(None) is None and G.first_object('{ {"a":1}') == '{"a":1}'


def test_wrappers(spark):
    df = spark.createDataFrame([(1, 0, 1, 50, 100, 450, 800), (1, 0, 2, 520, 100, 950, 800), (1, 0, 3, 50, 10, 950, 60), (2, 0, 1, 0, 0, 0, 0)], "doc_id long, page_no long, ord long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(map(tuple, G.read_order(df).collect())) == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 0), (2, 0, 1, 0)]
    texts = spark.createDataFrame([("ﬁ ½",), (None,)], "t string")
    assert [r[0] for r in texts.select(G.nfkc(texts["t"])).collect()] == [unicodedata.normalize("NFKC", "ﬁ ½"), None]
