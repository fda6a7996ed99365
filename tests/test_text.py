"""Folding, number shapes and escapes on chosen texts."""

import unicodedata

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.layout import similar_lines


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.x for r in rows.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_fold_drops_all_accents(spark):
    texts = ["Čeština ŘŮŽ", "Łódź Ő ş ā", "ÀÉÎõü ÿ Ñ", "é x̣̂", "ß ﬁ ø ł", "Ệ ǘ ḍ", "ΆΈ ά", "Й й", None, ""]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(c) <= 0x36F) for t in texts]
    assert column(spark, texts, T.fold) == want


def test_long_numbers_count_no_pages(spark):
    rows = spark.createDataFrame([("page 9", "page 10"), ("no 123456", "no 123457"), ("id 1234567", "id 1234568"), ("3 of 12", "4 of 12"), ("3 of 12", "4 of 13")], "a string, b string")
    got = [r.x for r in rows.select(similar_lines(F.col("a"), F.col("b"), 1).alias("x")).collect()]
    assert [x == 1.0 for x in got] == [True, True, False, True, False]


def test_escapes(spark):
    text = '<a b="c">&\x01￿\t'
    assert column(spark, [text, None], T.escape_xml) == ['&lt;a b="c"&gt;&amp;\t', None]
    assert column(spark, [text], T.escape_attribute) == ["&lt;a b=&quot;c&quot;&gt;&amp;\t"]
