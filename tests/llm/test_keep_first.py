"""One row of each class is kept by row: null ids, repeated ids with unlike texts, and equal rows."""

from collections import Counter

from quire.llm import jaccard

A = " ".join(f"a{i}" for i in range(60))
A2 = A + " end"
B_ = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))
D = " ".join(f"d{i}" for i in range(60))


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    out = jaccard.keep_first(docs)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_repeated_ids_with_unlike_texts_both_stay(spark):
    assert kept(spark, [(1, A), (1, B_), (2, A2), (3, C)]) == Counter([(1, A), (1, B_), (3, C)])


def test_the_near_copy_of_a_smaller_id_goes(spark):
    # (5, A2) copies (1, A); the other row of id 5 is the first of its own class
    assert kept(spark, [(1, A), (5, A2), (5, D), (6, D)]) == Counter([(1, A), (5, D)])


def test_rows_without_an_id_are_kept_once_and_only_without_another(spark):
    assert kept(spark, [(1, A), (None, A), (None, A2), (None, C), (None, C), (None, B_)]) == Counter([(1, A), (None, C), (None, B_)])


def test_equal_rows_and_rows_without_words(spark):
    assert kept(spark, [(4, C), (4, C), (7, C), (8, ""), (8, ""), (None, None), (9, " ")]) == Counter([(4, C), (8, ""), (8, ""), (None, None), (9, " ")])
