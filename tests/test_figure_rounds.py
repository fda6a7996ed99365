"""What figure_regions deals and writes: texts are read once, pages that are done leave the rounds, crowded pages have a grid."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_figures import both, line, page_of, picture, text, walk

from quire.catalogue import grouped as C
from quire.catalogue.surgery import boxed
from quire.operators import figures as V
from quire.plans import model as M
from quire.registry import documents

KEY, SIDE = ("doc_id", "page_no"), ("x0", "y0", "x1", "y1")


def test_pages_that_are_done_leave_the_rounds(spark, monkeypatch):
    seen, plain = [], V.written

    def noted(df, name="step"):
        out = plain(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(V, "written", noted)
    # each would join the smaller one before it, so a round joins two of them
    chain = ([picture(i, 10 * 2**i - 10, 0, 10 * 2 ** (i + 1) - 10, 10) for i in range(8)], [text(9, 6, 900, 0, 20, 900, 90)], [line(9, 0, 20, 900, 30)])
    still = ([picture(1, 0, 0, 50, 50)], [text(9, 6, 900, 0, 60, 900, 90)], [line(9, 0, 60, 900, 70)])
    pages = [chain] + [still] * 40
    got = both(spark, pages)
    assert [sorted(g[0]) for g in got] == [[0]] + [[1]] * 40
    assert got[0][1] == {("picture", i, 0) for i in range(8)}
    assert sum(name == "merges" and n == 1 for name, n in seen) == 7
    # the parts of all pages: at the start, after the first round, and at the two ends, however many rounds there are
    assert sum(name == "parts" and n >= 40 for name, n in seen) == 4
    assert all(n <= 1 for name, n in seen if name == "body")


def test_texts_are_read_once(spark, sf_dir, monkeypatch):
    reads, plain = Counter(), V.written

    def noted(df, name="step"):
        reads[any(f.endswith("/documents.parquet") for f in df.inputFiles())] += 1
        return plain(df, name)

    for module in (V, C):
        monkeypatch.setattr(module, "written", noted, raising=False)
    got = C.figure_regions(spark, sf_dir)
    rows = sorted(map(tuple, got.collect()))
    assert reads[True] == 1 and reads[False] > 1 and rows
    # the same with runs as lines, and the number of lines counted
    docs = documents(spark, sf_dir)
    runs = boxed(docs)
    pieces = M.pictures(docs).where("not running").select(*KEY, F.col("ord").alias("id"), F.lit(True).alias("picture"), *SIDE)
    pieces = pieces.unionByName(M.fills(docs).where("fill = 'cover'").select(*KEY, (F.col("ord") + 1_000_000).alias("id"), F.lit(False).alias("picture"), *SIDE))
    n_lines = runs.groupBy("doc_id", "ord").agg((F.max(F.expr("run div 4")) + 1).alias("n_lines"))
    texts = M.blocks(docs).where("text <> ''").join(n_lines, ["doc_id", "ord"]).select(*KEY, "ord", "n_lines", "n_chars", (F.col("size") >= 14).alias("heading"), *SIDE)
    assert rows == sorted(map(tuple, V.summed(*V.regions(pieces, texts, runs.select(*KEY, "ord", *SIDE))).select(*got.columns).collect()))


def test_crowded_pages_equal_the_walk(spark, monkeypatch):
    monkeypatch.setattr(V, "CROWD", 5)
    rng = random.Random(4)
    pages = [page_of(rng) for _ in range(60)]
    assert len({len(p[0]) > 5 for p in pages}) == 2
    for got, page in zip(both(spark, pages), pages):
        assert got == walk(*page)
