"""Op 1's counts against brute force on odd texts, training on repeated rows, and what the trees learn."""

import random
import re

from quire.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def truth(text):
    text = text or ""
    words = WORD.findall(text)
    seen, twice = {}, [False] * len(words)
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                twice[i : i + 8] = [True] * 8
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n, repeat = len(words), sum(twice)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, n < 20 or 100 * repeat > 30 * n


def odd_texts(rng):
    pool = ["a", "b", "é", "#", "**", "x|y", "\n", "\n", "\t", "\r", "\x0b", " ", "\x1c", " ", "中文", "🙂", "", "long" * 50]
    out = [None, "", "\n\n", "a\n a\na\n\na ", "\x0c\x0b"]
    for _ in range(600):
        out.append(rng.choice([" ", "\n", ""]).join(rng.choice(pool) for _ in range(rng.randint(0, 60))))
    return out + [" ".join(["same words again and again and again ok"] * 30), "a " * 5000, " ".join(str(i) for i in range(30))]


def test_counts(spark):
    texts = odd_texts(random.Random(4))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs, docs.selectExpr("doc_id", "0 as quality").where("false")).collect()}
    assert got == {i: truth(t) for i, t in enumerate(texts)}


def test_reruns_agree_and_bad_texts_go(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(300):
        good = i % 2
        n = rng.randint(30, 120)
        text = " ".join(rng.choice(words) for _ in range(n)) if good else " ".join(rng.choice(["BUY", "$$$", "#1", "NOW!!!", "99%"]) + str(rng.randint(0, 9)) for _ in range(n))
        rows.append((i, text))
    rows += [(7, "another text with an id that is there already"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    first = sorted((-1 if r.doc_id is None else r.doc_id, r.score, r.kept) for r in quality.quality(docs, labels).collect())
    again = sorted((-1 if r.doc_id is None else r.doc_id, r.score, r.kept) for r in quality.quality(docs.repartition(5), labels).collect())
    assert first == again
    held_out = [(i, k) for i, _, k in first if i >= 200]
    assert sum(k == bool(i % 2) for i, k in held_out) >= 0.95 * len(held_out)
