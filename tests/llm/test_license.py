"""License scans: base counts against brute force, and texts that must and must not get a label."""

import random
import re

import pytest

from quire.llm import license

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in license.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, n long, w string, key string").repartition(3)
    return license.licenses(docs).collect()


def test_base_counts(spark):
    rng = random.Random(8)
    pool = ["gnu", "GNU", "general", "public", "license", "License,", "apache", "cc", "by", "BY-", "mit", "4.0", "2", "été", "K", "--", "\n", "x"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "...,"), (503, " mit license"), (504, "mit license"), (505, "MIT-License" * 3000)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(spark, rows)}
    assert got == {i: base(t) for i, t in rows}


def test_repeated_rows_and_null_ids(spark):
    got = scan(spark, [(1, "mit license"), (1, "mit license"), (None, "cc by"), (None, None), (1, "cc by")])
    assert sorted((r.doc_id or -1, r.n_words, r.base_labels) for r in got) == [(-1, 0, ""), (-1, 2, "cc-by"), (1, 2, "cc-by"), (1, 2, "mit"), (1, 2, "mit")]
    assert scan(spark, []) == []


@pytest.mark.parametrize(
    "text,labels",
    [
        ("4.0 4.0 4.0", ""),
        ("2.0 2.0 2.0 2.0 2.0", ""),
        ("creative commons creative commons", ""),
        ("public license public license", ""),
        (" ".join(f"{i}.0" for i in range(200)), ""),
        ("creative commons attribution", "cc-by"),
        ("GNU General Public License (GPL) version 2", "gpl,gpl-2.0"),
        ("GNU General Public License version 3", "gpl,gpl-3.0"),
        ("the Apache License, Version 2.0", "apache,apache-2.0"),
        ("CC BY 4.0", "cc-by,cc-by-4.0"),
        ("license public mozilla", ""),
    ],
)
def test_labels(spark, text, labels):
    assert scan(spark, [(1, text)])[0].labels == labels


def test_texts_with_changes(spark):
    rng = random.Random(1)
    rows = []
    for i, (text, _) in enumerate(license.TEXTS):
        words = text.split()
        changed = list(words)
        changed[len(words) // 2] = "changed"
        added = words[: len(words) // 3] + ["one", "more"] + words[len(words) // 3 :]
        shuffled = list(words)
        rng.shuffle(shuffled)
        rows += [(10 * i, " ".join(["before"] * 9 + words)), (10 * i + 1, " ".join(changed if len(words) > 20 else words)), (10 * i + 2, " ".join(added if len(words) > 20 else words)), (10 * i + 3, " ".join(shuffled)), (10 * i + 4, " ".join(words[: len(words) // 2]))]
    got = {r.doc_id: r for r in scan(spark, rows)}
    for i, (_, label) in enumerate(license.TEXTS):
        for j in range(3):
            assert label in got[10 * i + j].labels.split(","), (i, j)
        # the notices of gpl and mpl name them
        assert got[10 * i + 3].labels == "" and (label not in got[10 * i + 4].labels.split(",") or label in ("gpl", "mpl"))
        assert got[10 * i].score == 1.0
