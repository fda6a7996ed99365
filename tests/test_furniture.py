"""Furniture against brute force: two means by neighbour, runs over all lines of a page, heads and feet."""

from pyspark.sql import functions as F

from quire import queries as Q
from quire.functions import text as T
from quire.operators import layout

SCHEMA = "doc_id long, page_no long, slot long, line string, size double, y double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, z in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != z))
    return row[-1]


def score(a, b, gap):
    import re

    m, n = re.findall("[0-9]+", a), re.findall("[0-9]+", b)
    if re.sub("[0-9]+", "#", a) == re.sub("[0-9]+", "#", b):
        steps = [int(y) - int(x) for x, y in zip(m, n)]
        if steps.count(gap) == 1 and steps.count(0) == len(steps) - 1:
            return 1.0
    return 1 - distance(a, b) / max(len(a), len(b))


def brute(rows):
    """rows: (page, slot, key, size, y) of one document -> {(page, slot): (strength, is_header, foot_strength, is_footer)}."""
    n_pages = max(r[0] for r in rows) + 1
    pages = [sorted(r[1:] for r in rows if r[0] == p and r[2]) for p in range(n_pages)]
    sizes = sorted(r[2] for page in pages for r in page)
    if n_pages < 3 or not sizes:
        return {}
    body = sizes[len(sizes) // 2]
    out = {}
    for p, page in enumerate(pages):
        got = {}
        for edge in (0, 1):
            order = [page, page[::-1]][edge]
            good, before = True, None
            for d, (slot, key, size, y) in enumerate(order):
                means = []
                for span in (1, 2):
                    at = [q for q in (p - span, p + span) if 0 <= q < n_pages]
                    there = [(q, [pages[q], pages[q][::-1]][edge]) for q in at]
                    means.append(sum(score(key, t[d][1], q - p) if d < len(t) else 0.0 for q, t in there) / len(at) if at else 0.0)
                strength = round(max(means), 6)
                good = good and strength >= 0.6 and size <= 1.25 * body and (before is None or abs(before[3] - y) <= 2 * before[2])
                before = (slot, key, size, y)
                got.setdefault(slot, []).extend([strength, good])
        out |= {(p, slot): (g[0], g[1], g[2], g[3] and not g[1]) for slot, g in got.items()}
    return out


def rows_of(pages, doc=1):
    return [(doc, p, i, line, 10.0, 770.0 - 14 * i) for p, page in enumerate(pages) for i, line in enumerate(page)]


def found(spark, rows):
    got = layout.furniture(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.page_no, r.slot): tuple(r)[3:] for r in got}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k][1], got[k][3]) == (v[1], v[3]) and abs(got[k][0] - v[0]) < 2e-6 and abs(got[k][2] - v[2]) < 2e-6


def test_alternating_heads_do_not_cancel(spark):
    rows = rows_of([[["abcdefghij", "zzzzzzzzzj"][p % 2], f"text {'qwertyuiop'[p] * 9}"] for p in range(6)])
    got = found(spark, rows)
    assert all(got[p, 0][:2] == (1.0, True) for p in range(6))


def test_deep_runs_feet_and_bounds(spark):
    body = ["Otter swims", "blue marmalade!", "x", "quick 77 foxes jump", "nnnnnn", "Vienna"]
    pages = [[f"head {i}" for i in "abcde"] + ([""] if p == 2 else []) + [body[p], body[-p]] + ["a foot line", f"{p + 1}"] + ([""] if p % 2 else []) for p in range(6)]
    rows = rows_of(pages) + [(2, p, 0, "same", 10.0, 770.0) for p in range(2)] + [(3, p, 0, "Title", 16.0 if p == 1 else 10.0, 770.0) for p in range(3)]
    got = found(spark, [r for r in rows if r[0] == 1])
    same(got, brute([(p, s, line.lower(), size, y) for d, p, s, line, size, y in rows if d == 1]))
    assert all(got[p, s][1] for p in range(6) for s in range(5)) and got[0, 8][3] and got[0, 7][3] and not got[0, 6][3]
    assert not found(spark, [r for r in rows if r[0] == 2])
    assert [found(spark, [r for r in rows if r[0] == 3])[p, 0][1] for p in range(3)] == [True, False, True]


def test_queries_equal_brute_force_on_unchanged_lines(spark, tmp_path):
    words = ["été", "Straße", "日本語", "привет", "norm", "Ελλάδα", "x"]
    page = lambda d, p: "\n".join(["Überschrift é", "中文" * 4 if p % 2 else "привет ми", *[f"{words[(d + p * i) % 7]} {words[(p + i) % 7]}" for i in range(18)]])
    docs = [(d, "\n".join(page(d, p) for p in range(3 + d)), "quelle é") for d in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.with_heads(spark, str(tmp_path)).select("doc_id", "page_no", "slot", T.line_key(F.col("line")), "size", "y").collect()
    head = {tuple(r)[:3]: tuple(r)[3:] for r in Q.furniture_header(spark, str(tmp_path)).collect()}
    foot = {tuple(r)[:3]: tuple(r)[3:] for r in Q.furniture_footer(spark, str(tmp_path)).collect()}
    assert head.keys() == foot.keys()
    for d in range(4):
        want = brute([tuple(r)[1:] for r in rows if r[0] == d])
        same({k[1:]: (*head[k], *foot[k]) for k in head if k[0] == d}, want)
    # unlike letters are unlike
    assert head[0, 1, 3][0] < 0.6
