"""How work grows: plans that deal no more than they must, and walks whose steps are counted; results against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quire import queries as Q
from quire.catalogue import sources as C
from quire.functions import edits
from quire.operators import glyphs as Y
from quire.operators import grouped as G
from quire.plans import bridge
from quire.plans import model as M
from quire.sources import words as O


def plan(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_glyphs_are_dealt_as_strips(spark, sf_dir):
    rng = random.Random(3)
    rows = []
    for doc in range(3):
        for page in range(2):
            seq, base = 0, 0.0
            for _ in range(400):
                seq += rng.choice((1, 1, 1, 1, 1, 1, 1, 7))
                base = rng.choice((base, base, base + 0.008, base + 1))
                rows.append((doc, page, seq, rng.choice("abc "), float(seq), None if rng.random() < 0.02 else 6.0, base, rng.random() < 0.5, rng.choice(("f", "f", None)), rng.choice((0, 0, 0, 1))))
    schema = "doc_id long, page_no long, seq long, ch string, x double, width double, baseline double, shown boolean, font string, fill int"
    want, open_ = [], None
    for r in rows:
        key = (r[0], r[1], r[8], r[9])
        if open_ is not None and open_[0] == key and abs(r[6] - open_[1]) <= 0.01:
            open_[2].append(r)
        else:
            run = 1 if open_ is None or open_[0][:2] != key[:2] else open_[3] + 1
            open_ = [key, r[6], [r], run]
            want.append(open_)
        open_[1] = r[6]
    want = sorted((k[0], k[1], run, "".join(g[3] for g in own), min(g[4] for g in own), max((g[4] + g[5] for g in own if g[5] is not None), default=-1.0)) for k, _, own, run in want if any(g[7] for g in own))
    for given in (rows, rng.sample(rows, len(rows))):
        got = Y.form_runs(spark.createDataFrame(given, schema).repartition(3))
        assert sorted(tuple(r)[:5] + (-1.0 if r.x1 is None else r.x1,) for r in got.collect()) == want
    # no window of single letters over pages
    own = plan(Q.QUERIES["run_formation"](spark, sf_dir))
    assert own.count("Window [") == 1 and own.count("MapInArrow") == 2


def test_letters_are_not_dealt(spark, sf_dir):
    # texts are dealt once, by document; letters and pieces of runs are not
    own = plan(Q.QUERIES["run_formation"](spark, sf_dir))
    assert own.count("Exchange ") == 1 and "explode(split(text" not in own
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aé漢😀e\u0301\u200d\x00-") for _ in range(rng.randint(1, 30)))
    docs = [(i, "\n".join(" \t".join(word() for _ in range(rng.choice((0, 1, 3, 4, 9, 40)))) for _ in range(rng.choice((1, 2, 7, 20, 70))))) for i in range(25)]
    docs = spark.createDataFrame([*docs, (30, None), (31, ""), (32, " \n\t\n  "), (33, "x" * 70_000 + "\n" + "y z " * 9000)], "doc_id long, text string").repartition(3)
    rows = C.set_runs(docs)
    events = C.letters(docs)
    (batch,) = rows.toArrow().combine_chunks().to_batches()
    made = C.letters_of(batch).to_pydict()
    assert list(made) == events.columns
    assert sorted(zip(*made.values())) == sorted(map(tuple, events.collect()))
    want = sorted(map(tuple, Y.form_runs(events).collect()))
    dealt = rows.repartition(3, "doc_id")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            # pages are joined past the ends of batches, and put in order where they are not
            for own in (dealt.sortWithinPartitions("doc_id", "ord", "run"), dealt.sortWithinPartitions("doc_id", "page_no", F.desc("ord"), F.col("run") % 3)):
                assert sorted(map(tuple, Y.form_runs(own, made=C.letters_of).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_seams_are_judged_without_python(spark):
    rng = random.Random(5)
    lines = {i: [rng.choice((rng.random() / 10, rng.random(), 0.28, 0.0, 0.6 + rng.random())) for _ in range(rng.randint(1, 25))] for i in range(300)}
    rows = [(1, i, k, x) for i, xs in lines.items() for k, x in enumerate(xs)]
    got = G.word_gaps(spark.createDataFrame(rows, "doc_id long, line long, seam long, ratio double"))
    assert sorted(map(tuple, got.collect())) == sorted((1, i, k, x >= G.gate(lines[i])) for _, i, k, x in rows)
    assert "Arrow" not in plan(got)


def plain_lines(runs):
    """lines_of() as a walk over all lines for each run."""
    lines = []
    for r in sorted(runs, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["run"])):
        for line in lines:
            tall = max(line, key=lambda m: m["y1"] - m["y0"])
            low = min(r["y1"] - r["y0"], tall["y1"] - tall["y0"])
            stacked = any(max(r["size"], m["size"]) >= 2 * min(r["size"], m["size"]) and G.shared(r["x0"], r["x1"], m["x0"], m["x1"]) > 0.5 * min(r["x1"] - r["x0"], m["x1"] - m["x0"]) for m in line)
            if r["axis"] == line[0]["axis"] and low > 0 and G.shared(r["y0"], r["y1"], tall["y0"], tall["y1"]) >= low / 3 and not stacked:
                line.append(r)
                break
        else:
            lines.append([r])
    out = []
    for line in lines:
        line.sort(key=lambda r: (r["x0"], r["run"]))
        part = [line[0]]
        for a, b in zip(line, line[1:]):
            if b["x0"] - max(m["x1"] for m in part) > 0.5 * max(a["size"], b["size"]):
                out.append(part)
                part = []
            part.append(b)
        out.append(part)
    return [[r["run"] for r in line] for line in out]


def test_lines_that_end_above_are_not_asked_again(monkeypatch):
    rng = random.Random(7)
    for _ in range(60):
        runs = [{"run": i, "x0": (x := rng.randrange(300)), "y0": (y := rng.randrange(200)), "x1": x + rng.randrange(60), "y1": y + rng.randrange(0, 40), "size": rng.choice((5, 10, 20)), "axis": rng.choice((0, 0, 90))} for i in range(rng.randint(0, 60))]
        assert [[r["run"] for r in line] for line in G.lines_of(runs)] == plain_lines(runs)
    asked, shared = [0], G.shared
    monkeypatch.setattr(G, "shared", lambda *a: asked.__setitem__(0, asked[0] + 1) or shared(*a))
    G.lines_of([{"run": i, "x0": 100 * (i % 4), "y0": 12 * (i // 4), "x1": 100 * (i % 4) + 60, "y1": 12 * (i // 4) + 10, "size": 10, "axis": 0} for i in range(2000)])
    assert asked[0] < 20_000


def plain_valley(spans):
    """valley() bin by bin."""
    lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
    if hi <= lo:
        return None
    n = min(G.BINS, max(1, int(hi - lo)))
    profile = [0] * n
    for a, b in spans:
        i = min(n - 1, int((a - lo) * n / (hi - lo)))
        for k in range(i, min(n, max(int((a - lo) * n / (hi - lo)) + 1, int((b - lo) * n / (hi - lo))))):
            profile[k] += 1
    best, i = None, 0
    while i < n:
        j = i
        while j < n and profile[j] <= G.NOISE * max(profile):
            j += 1
        if j > i:
            depth = min(max(profile[:i], default=0), max(profile[i:], default=0)) / max(profile)
            if j < n and depth >= G.DEPTH and (best is None or depth > best[0]):
                best = (min(max(profile[:i], default=0), max(profile[j:])) / max(profile), lo + (i + j) / 2 * (hi - lo) / n)
        i = max(j, i + 1)
    return best


def test_valleys_are_found_from_steps(spark):
    rng = random.Random(11)
    for _ in range(300):
        spans = [(a := rng.choice((rng.randrange(60), rng.random() * 50)), a + rng.choice((0, 3, rng.random() * 9))) for _ in range(rng.randint(1, 9))]
        assert G.valley(spans) == plain_valley(spans)
    # pages come to Python many at a time
    df = spark.createDataFrame([(i, 0, 1, 0, 0, 5, 5) for i in range(300)], "doc_id long, page_no long, ord long, x0 long, y0 long, x1 long, y1 long")
    assert "FlatMapGroups" not in plan(G.read_order(df)) and G.read_order(df).count() == 300


@pytest.mark.parametrize("name", ["ocr_words", "ocr_page_text"])
def test_rows_of_a_word_table_are_split_once(spark, sf_dir, name):
    own = plan(Q.QUERIES[name](spark, sf_dir))
    assert own.count("split(row#") + own.count("split(concat_ws(") == 1
    rows = spark.createDataFrame([(1, 1, "5\t1\t1\t1\t0\t0\t1\t2\t3\t4\t50\t a "), (1, 2, "5\t1"), (1, 3, None), (1, 4, "5\t1\t1\t1\t0\t0\tx\t2\t3\t4\t50\ta"), (1, 5, "4\t1\t1\t1\t0\t0\t1\t2\t3\t4\t50\ta"), (1, 6, "5\t1\t1\t1\t1\t0\t1\t2\t3\t4\t-1\tb")], "doc_id long, no long, row string")
    assert sorted(map(tuple, O.ocr_words(rows).collect())) == [(1, 1, "a", 1.0, 2.0, 3.0, 4.0, 0.5, 0), (1, 6, "b", 1.0, 2.0, 3.0, 4.0, -1.0, 1)]


@pytest.mark.parametrize("name", ["redact_cut_runs", "redact_apply_proof", "redact_purge_refs"])
def test_letters_come_without_a_window(spark, sf_dir, name):
    assert "Window" not in plan(M.lettered(Q.documents(spark, sf_dir))) and "Exchange" not in plan(M.lettered(Q.documents(spark, sf_dir)))
    assert "Window" not in plan(Q.QUERIES[name](spark, sf_dir))


def test_a_pair_is_compared_once(spark, sf_dir):
    assert plan(Q.QUERIES["compare_texts"](spark, sf_dir)).count("MapInArrow") == 1


def test_lines_are_made_once(spark, sf_dir):
    # a plain explode has a filter below it that makes the list as well
    assert "Filter (" not in plan(bridge.lines(Q.documents(spark, sf_dir)))


def test_runs_are_numbered_without_a_window(spark, sf_dir):
    texts = ["one two three four five\n\n \t\nsix", "", None, "\n\n", "a  b\tc d e f g h i", "x " * 30 + "\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = M.runs(docs).columns
    got = [tuple(r) for r in M.numbered_runs(docs).select("doc_id", "n", *names[1:]).orderBy("doc_id", "n").collect()]
    want, n = [], {}
    for r in M.runs(docs).orderBy("doc_id", "ord", "run").collect():
        n[r[0]] = n.get(r[0], 0) + 1
        want.append((r[0], n[r[0]], *r[1:]))
    assert got == want
    own = plan(M.numbered_runs(Q.documents(spark, sf_dir)))
    assert "Window" not in own and "Exchange" not in own
    # the next run, and the joins with the words that are written
    assert plan(Q.QUERIES["hyphen_join"](spark, sf_dir)).count("Window [") == 1


def test_cells_are_made_of_tables_only(spark, sf_dir):
    own = plan(M.cells(Q.documents(spark, sf_dir)))
    assert "Join" not in own and "Exchange" not in own


def test_edit_distances_of_many_pairs(spark):
    rng = random.Random(13)
    texts = ["", "a", "ab", "日本語😀", "x" * 700, "x" * 350 + "y" * 349] + ["".join(rng.choice(rng.choice(("ab", "abcdefgh é", "𝒳ß \0"))) for _ in range(rng.choice((3, 7, 8, 31, 63, 64, 65, 90)))) for _ in range(150)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(1500)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert edits.distances(*zip(*pairs)) == [r.x for r in df.select(F.levenshtein("a", "b").alias("x")).collect()]


@pytest.mark.parametrize("name", ["furniture_header", "furniture_footer"])
def test_lines_of_a_document_are_dealt_once(spark, sf_dir, name):
    # once as lines, once as scores, and the pages of the document; no distance letter by letter
    own = plan(Q.QUERIES[name](spark, sf_dir))
    assert own.count("Exchange hashpartitioning") <= 3 and "levenshtein" not in own


def test_joined_lines_meet_titles_by_hash(spark, sf_dir):
    assert "xxhash64" in plan(Q.QUERIES["outline_alignment"](spark, sf_dir))


def test_pages_keep_their_partitions(spark, sf_dir):
    # partitions that are put together by their size on the way are large in memory
    own = plan(Q.QUERIES["paragraph_flow"](spark, sf_dir))
    assert own.count("Exchange") == 1 and "REPARTITION_BY_NUM" in own
