"""Matches over runs and cutting within runs, on hand-made lettered runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import spans as P

RUNS = "doc_id long, page_no long, ord long, run long, line long, text string, xs array<double>, y0 long, size long"
ZONES = "doc_id long, page_no long, x0 long, y0 long, x1 long, y1 long"


def lettered(spark, rows):
    return spark.createDataFrame([(d, p, o, r, ln, t, [float(x + 10 * i) for i in range(len(t))], y, 10) for d, p, o, r, ln, t, x, y in rows], RUNS)


def test_two_matches_in_one_run_and_one_over_three(spark):
    runs = lettered(spark, [(1, 0, 0, 0, 0, "call Ann Lee and Bob ", 100, 50), (1, 0, 0, 1, 0, "or X", 400, 50), (1, 0, 0, 2, 0, "av", 450, 50), (1, 0, 0, 3, 0, "ier now", 480, 50), (1, 0, 1, 0, 0, "Zed", 100, 80)])
    got = sorted((r.ord, r.run, r.match, r.said, r.x0, r.x1, r.y0, r.y1) for r in P.pattern_zones(runs, "[A-Z][a-z]+( [A-Z][a-z]+)*").collect())
    assert got == [
        (0, 0, 0, "Ann Lee", 150.0, 230.0, 50.0, 61.0), (0, 0, 1, "Bob", 270.0, 296.0 + 0.0, 50.0, 61.0), (0, 1, 2, "Xavier", 430.0, 436.0, 50.0, 61.0), (0, 2, 2, "Xavier", 450.0, 466.0, 50.0, 61.0), (0, 3, 2, "Xavier", 480.0, 520.0, 50.0, 61.0),
        (1, 0, 0, "Zed", 100.0, 126.0, 80.0, 91.0),
    ]


def test_lines_and_empty_matches(spark):
    runs = lettered(spark, [(1, 0, 0, 0, 0, "ab", 0, 0), (1, 0, 0, 1, 1, "cab", 0, 12), (1, 0, 1, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "aXaa", 0, 0)])
    found = lambda p: sorted((r.doc_id, r.run, r.said, r.x0) for r in P.pattern_zones(runs, p).collect())
    assert found("b\nc") == [(1, 0, "b\nc", 10.0), (1, 1, "b\nc", 0.0)]
    assert found("a*") == [(1, 0, "a", 0.0), (1, 1, "a", 10.0), (2, 0, "a", 0.0), (2, 0, "aa", 20.0)]
    assert found("nothing") == []


@pytest.mark.parametrize("pattern", ["[ab]+c?", "b*", "(ab|ba) ?c", "a\\n?b", "c$"])
def test_spans_equal_a_plain_walk(spark, pattern):
    rng = random.Random(pattern)
    rows, texts = [], {}
    for o in range(30):
        for r in range(rng.randint(1, 9)):
            rows.append((1, 0, o, r, r // 3, "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 7, 400]))), rng.randint(0, 50), 0))
    want = set()
    for o in range(30):
        own = [r for r in rows if r[2] == o]
        text, at = "", []
        for i, r in enumerate(own):
            if i and r[4] != own[i - 1][4]:
                text, at = text + "\n", at + [None]
            text, at = text + r[5], at + [(r[3], k) for k in range(len(r[5]))]
        for m in re.finditer(pattern.replace("$", "\\Z"), text):
            for run in {a[0] for a in at[m.start() : m.end()] if a}:
                ks = [a[1] for a in at[m.start() : m.end()] if a and a[0] == run]
                want.add((o, run, m[0], float(next(r[6] for r in own if r[3] == run) + 10 * min(ks))))
    got = {(r.ord, r.run, r.said, r.x0) for r in P.pattern_zones(lettered(spark, rows), pattern.replace("$", "\\z")).collect()}
    assert got == want


def zones(spark, rows):
    return spark.createDataFrame(rows, ZONES)


def test_runs_are_cut_letter_by_letter(spark):
    runs = lettered(spark, [(1, 0, 0, 0, 0, "abcdefghij", 0, 0), (1, 0, 0, 1, 0, " x ", 200, 0), (1, 0, 0, 2, 0, "far", 0, 100), (1, 1, 0, 3, 0, "other page", 0, 0), (1, 0, 0, 4, 0, "", 0, 0)])
    own = zones(spark, [(1, 0, 20, 0, 40, 10), (1, 0, 30, 0, 50, 10), (1, 0, 80, 3, 81, 4), (1, 0, 82, 0, 83, 9), (1, 0, 205, 0, 215, 9), (2, 0, 0, 0, 999, 999)])
    left = P.pieces(P.cut_runs(runs, own)).collect()
    # bodies lie 2.5 right of a letter's x and 3.5 below its run's y0
    assert sorted((r.run, r.piece, r.text, r.xs[0], r.n_dropped) for r in left) == [(0, 0, "ab", 0.0, 4), (0, 1, "fgh", 50.0, 4), (0, 2, "j", 90.0, 4), (2, 0, "far", 0.0, 0), (3, 0, "other page", 0.0, 0)]
    cut = {r.run: (r.n_dropped, len(r.spans)) for r in P.cut_runs(runs, own).collect()}
    assert cut == {0: (4, 3), 1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0)}
    assert [tuple(r) for r in P.proof(runs, P.pieces(P.cut_runs(runs, own)), own).collect()] == [(1, 5, 0, True)]
    assert P.apply(runs, own).count() == 5
    dirty = P.proof(runs, runs.where("run = 0"), own)
    assert [tuple(r) for r in dirty.collect()] == [(1, 5, 4, False)]
    with pytest.raises(ValueError, match="4 letters are left in document 1"):
        P.checked(dirty)
    assert P.apply(runs, own.where("false")).count() == 4 and P.apply(runs.where("false"), own).count() == 0


def test_boxes_lose_what_is_in_zones(spark):
    rng = random.Random(4)
    boxes, own = [], []
    for i in range(40):
        x, y = rng.randint(0, 20), rng.randint(0, 20)
        boxes.append((i, i % 3, x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)))
    for d in range(40):
        for _ in range(rng.randint(0, 5)):
            x, y = rng.randint(0, 25), rng.randint(0, 25)
            own.append((d, d % 3, x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)))
    got = P.clipped(spark.createDataFrame(boxes, ZONES), zones(spark, own), "doc_id").collect()
    cells = lambda b: {(i, j) for i in range(int(b[0]), int(b[2])) for j in range(int(b[1]), int(b[3]))}
    for d, p, *b in boxes:
        parts = [cells((r.x0, r.y0, r.x1, r.y1)) for r in got if r.doc_id == d]
        want = cells(b).difference(*(cells(z[2:]) for z in own if z[:2] == (d, p)))
        assert sum(map(len, parts)) == len(want) and set().union(*parts) == want
    assert P.clipped(spark.createDataFrame(boxes, ZONES), zones(spark, own).where("false"), "doc_id").where(F.col("part") == 0).count() == 40
