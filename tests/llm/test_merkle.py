"""Op 11 against a plain recursion, over tables that fall into many segments and partitions."""

import hashlib
import random
import zlib

import pytest

from quire.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def truth(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r, leaf(r)))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = {k: tree([x[1] for x in by_lang[k]]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for i, (r, own) in enumerate(by_lang[k]):
            path = sides(trees[k], i) + sides(top, n)
            d = r["doc_id"]
            f = leaf(r | {"text": lowered(r["text"])}) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else own
            for a, b in path:
                f = h(*a, f, *b)
            out.append((d, own, trees[k][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), f, f == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(rng, n, langs):
    out = [{"doc_id": rng.choice([i, i, i, 7, None, -i]), "text": rng.choice([None, "", "Größe A", f"Text {i} ÀB", "x" * 3000, "plain"]), "lang": rng.choice(langs), "source": rng.choice([None, "a", "ü"]), "n_chars": rng.choice([None, i]), "leaf": "clash", "grp": 3} for i in range(n)]
    return out + out[: n // 5] + out[:3] * 9


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int"


@pytest.mark.parametrize("n,segment,langs", [(1, 4, ["en"]), (7, 5, ["en", None]), (60, 3, ["", "en", None, "zz"]), (700, 37, ["en"] * 8 + ["é", None, "fr"]), (90, 2, [f"l{i}" for i in range(30)])])
def test_proofs(spark, monkeypatch, n, segment, langs):
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    rows = rows_of(random.Random(n), n, langs)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = merkle.verified(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == truth(rows)


def test_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SEGMENT", 11)
    rows = rows_of(random.Random(3), 150, ["en", "de"])
    trees, over = merkle.manifest(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    want = set()
    for lang in ("en", "de"):
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)) for r in rows if r["lang"] == lang))
        want |= {("=" + lang, k, i, x) for k, level in enumerate(tree([x[2] for x in own])) for i, x in enumerate(level)}
    assert {tuple(r) for r in merkle.node_records(trees).collect()} == want
    assert over.spine.where("count = 1").count() == 1


def test_empty(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mountain_emits_only_what_reaches_beyond():
    m = merkle.Mountain(5, 64 * 8)
    for i in range(5, 140):
        m.push(i, b"%064d" % i)
    m.close()
    assert [(k, i) for k, i, _ in m.edges if k == 0] == [(0, i) for i in (5, 6, 7, *range(136, 140))]
    assert [(k, i) for k, i, _ in m.edges if k == 1] == [(1, i) for i in (*range(1, 8), 16)]
    assert [(k, i) for k, i, _ in m.edges if k == 2] == [(2, 1)]
