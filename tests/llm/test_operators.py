"""Operators against brute force, on small tables with nulls, empty and long texts, ties, copies and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import cms, decontam, gbt, html, jaccard, license, lpf, mixing, quality, tokencount, tokenstore
from quire.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block_id long, replies string"


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "délta", "eps", "zeta", "eta", "thêta", "iota", "kappa", "la", "mu", "nu"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    out = [None, "", " \n\t", "one two", "One two", "x", say(4000), "a" * 3000, "GNU General Public License and MIT License, cc-by!"]
    out += [say(40) + " " + passage + " " + say(40) for _ in range(6)]
    base = say(200).split()
    for i in range(8):
        own = list(base)
        own[i * 9] = "changed"
        out.append(" ".join(own))
    return out + [out[9], out[9], "tail <|endoftext|> it's 'll 're  two\n\n"] + [say(30) for _ in range(10)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", ["a", "b", None][i % 3], 1, 7, "x") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_windows(docs, rows, empty):
    seen, want = {}, {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in split.items():
        for j in range(len(w) - 12):
            seen.setdefault(tuple(w[j : j + 13]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if seen[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert by_id(cms.dedup_windows(docs)) == want
    assert cms.dedup_windows(empty).count() == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_substrings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(lpf, "HOT", hot)
    seen, want = {}, {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, t in raw.items():
        for j in range(len(t) - 49):
            seen.setdefault(t[j : j + 50], i)
    for i, t in raw.items():
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if seen[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\x01" * 50
        want[i] = (len(t), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    assert by_id(lpf.dedup_substrings(docs)) == want


def test_longest_previous():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.integers(97, 99, 30).astype(np.uint8)
        b, order = t.tobytes(), lpf.suffix_array(t)
        assert [b[i:] for i in order] == sorted(b[i:] for i in range(30))
        shared = lambda x, y: next(k for k in range(31) if max(x, y) + k >= 30 or b[x + k] != b[y + k])
        common = np.array([0, *(shared(x, y) for x, y in zip(order, order[1:]))])
        assert lpf.longest_previous(order, common, np.arange(30)).tolist() == [max([0, *(shared(i, j) for j in range(i))]) for i in order]


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert by_id(jaccard.near_duplicates(docs)) == {i: (len(s), root[i]) for i, s in sets.items()}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if root[i] == i)
    assert jaccard.near_duplicates(empty).count() == 0


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert by_id(tokenstore.token_output(docs, path)) == want
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert by_id(tokencount.token_counts(docs, path)) == {i: (len((t or "").encode()), n[i], n[i] > 512) for i, t in rows}


def test_counts_equal_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pool = "aabstremvlld'''    \t\n\r\x1c\x85.,!?0123éßñÄ中文́🙂Zq"
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>a<|endoftext|>", "", "'s 's"]
    path = vocabulary("byte_bpe_50k.json")
    assert tokencount.count_tokens(odd, path).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]


def test_licenses(docs, empty):
    got = by_id(license.licenses(docs))
    assert got[8] == (9, 3, 0, 7, "cc-by,gpl,mit", "cc-by,gpl,mit", 1.0) and got[0] == (0, 0, None, None, "", "", 0.0)
    assert license.licenses(empty).count() == 0


def test_leaks(spark, docs, rows):
    item = " ".join(rows[9][1].split()[40:80])
    changed = item.split()
    changed[5], changed[17], changed[30] = "x1", "x2", "x3"
    bench = spark.createDataFrame([(1, item), (2, " ".join(changed)), (3, None), (4, ""), (None, item), (5, "words nobody ever wrote down in such an order as this one here today")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    holds = {i for i, t in rows if t and item in t}
    assert {d for d, i in found if i == 1} >= holds and {d for d, i in found if i == 2} >= holds and not {i for _, i in found} & {3, 4, 5}
    assert not {r.doc_id for r in decontam.clean(docs, bench).collect()} & holds


def test_mixing(docs, rows, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(2)).collect()}
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    mix = mixing.repeated(docs.withColumn("unit", F.lit(7)).withColumn("Copies", F.lit("x")))
    assert mix.columns == docs.columns + ["unit", "Copies"]
    want = collections.Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mix.collect()) == +want
    own = dict(rows)
    assert all(r.text == own[r.doc_id] and r.unit == 7 for r in mix.collect())
    assert mixing.repeated(empty).count() == 0
    assert mixing.targets({"a": 10, "b": 1000, None: 10}) == {"a": 30.0, "b": 960.0, None: 30.0}
    assert mixing.mixed(empty).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 2000).astype(float), rng.random(2000)
    out = mixing.fly(np.sort(size)[::-1], p, rng.random(2000))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ np.sort(size)[::-1] - p @ np.sort(size)[::-1]) < 1e-3


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(rows) and got[0].base_failed and not got[0].kept and got[4].n_words == 2
    none = labels.where("false")
    assert all(r.kept != r.base_failed for r in quality.quality(docs, none).collect())
    assert quality.keep_good(docs, none).columns == docs.columns and quality.quality(empty, labels).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(2000) > 0.6).astype(float)
    forest = gbt.fit(x, y, {0: 1})
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4), np.full(50, 0.5)])
    assert (np.diff(forest.score(grid)) >= -1e-12).all() and ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_pages(spark):
    rng = random.Random(99)
    right = total = 0
    for _ in range(60):
        source, truth = html.made_up(rng)
        page = html.Page(source)
        kept = html.decode(page.parent, html.forest().score(html.features(page)))
        right += sum(a == bool(b) for a, b in zip(kept, truth))
        total += len(truth)
    assert right / total > 0.97
    one = "<html><body><nav><ul><li><a href=x>y</a></li></ul></nav><article><h1>T &amp; x</h1><p><b>one<br>two<p>three  four</article><footer>no</footer>"
    pages = spark.createDataFrame([(1, "u", one), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()} == {1: ("T & x\none two\nthree four", 24), 2: ("", 0), 3: ("", 0)}
