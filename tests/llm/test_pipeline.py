"""The corpus pipeline against a plain version of its stages, on a small folder of tables."""

import importlib.util
import os
import random
import sys
import zlib

import numpy as np
import pytest

from quire.llm import decontam, jaccard, mixing, quality
from quire.llm.queries import vocabulary

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(HERE, "corpus_pipeline.py"))
    module = importlib.util.module_from_spec(spec)
    sys.modules.setdefault("corpus_pipeline", module)
    spec.loader.exec_module(module)
    return module


def made(rng):
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item = say(30)
    rows = []
    for i in range(60):
        text = say(rng.randint(25, 90))
        if i % 10 == 3:
            text = say(30) + " " + item + " " + say(20)
        if i % 10 == 5:
            text = rows[i - 1][1] if i % 20 == 5 else rows[i - 1][1].replace(" ", "  ", 1)
        if i % 10 == 7:
            text = rows[i - 5][1] + " tail"
        rows.append((i, text, "en", f"s{i % 3}" if i % 8 else None, len(text)))
    return rows + [(60, None, None, "s1", None), (61, "", "en", "s1", 0), (62, "too short", "en", "s0", 9), (None, say(40), "en", "s0", 1), (None, None, None, None, None)], item


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}


def truth(spark, rows, labels, item):
    frame = lambda own: spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.n_words) for r in quality.quality(frame(rows), labels).collect() if r.kept}
    rows = [r for r in rows if (r[0], len((r[1] or "").split())) in kept]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    rows = [rows[min((i for i in range(len(rows)) if root[i] == c), key=order)] for c in sorted(set(root))]
    want = item.split()

    def leaks(text):
        w = text.split()
        return any(sum(a == b for a, b in zip(w[i : i + 13], want[j : j + 13])) >= 11 for i in range(len(w) - 12) for j in range(len(want) - 12))

    rows = [r for r in rows if not leaks(r[1])]
    copies = {(r.doc_id, r["size"]): r.copies for r in mixing.mixed(frame(rows)).collect()}
    rows = [r for r in rows for _ in range(copies[r[0], len(r[1].split())])]
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = [*tool.encode(r[1], add_special_tokens=False).ids, 2]
        out.append((-1 if r[0] is None else r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out)


def test_stages(spark, pipeline, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing sources", "token output"]
    rng = random.Random(9)
    rows, item = made(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == truth(spark, rows, labels, item)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()


def test_every_stage_but_the_last_keeps_the_columns(spark, pipeline, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, hashes int"
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)), "en", "s", 1, "x", 2)], schema)
    empty = docs.where("false")
    assert quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).columns == docs.columns
    bench = spark.createDataFrame([], "item_id long, text string")
    for stage in (jaccard.keep_first, lambda d: decontam.clean(d, bench), mixing.repeated):
        assert stage(docs).columns == docs.columns and [tuple(r) for r in stage(docs).collect()] == [tuple(r) for r in docs.collect()]
        assert stage(empty).count() == 0
