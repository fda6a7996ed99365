"""Script counts against brute force, on texts whose second script begins after the language sample."""

import unicodedata

from quire.functions.words import SAMPLE_CHARS
from quire.operators import language

NAMES = {"latin": "LATIN", "cyrillic": "CYRILLIC", "greek": "GREEK", "arabic": "ARABIC", "hebrew": "HEBREW", "han": "CJK", "hangul": "HANGUL", "devanagari": "DEVANAGARI", "thai": "THAI"}


def test_script_counts_look_at_whole_texts(spark):
    late = ["привет", "漢字", "ελλάδα", "שלום", "한국", "नमक", "ไทย", "مرحبا"]
    texts = ["a b, " * 2000 + " ".join(late), " ".join(late) * 900 + " tail", "x" * (SAMPLE_CHARS - 1) + "жя1", "short", "", None]
    rows = {r.doc_id: r for r in language.script_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].letters is None
            continue
        letters = [unicodedata.name(c) for c in t if unicodedata.category(c)[0] == "L"]
        assert rows[i].letters == len(letters)
        assert {n: rows[i][n] for n in NAMES} == {n: sum(x.startswith(p) for x in letters) for n, p in NAMES.items()}


def test_guess_looks_at_the_sample(spark):
    docs = [(1, "the cat and the dog of it is that was " * 200 + "привет мир " * 5000)]
    assert [tuple(r) for r in language.guess(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [(1, "en")]
