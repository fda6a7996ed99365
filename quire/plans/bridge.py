"""Lines, pages and boxes made of plain texts, so that layout operators have something to work on.

A paragraph is a line of the text; its words are set twelve to a line, and lines thirty or so to a page, from the top
down in steps of 14 points.  The first line of a document is its title.  All of it is a projection of the document's row:
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_A_LINE = 12
LINES_A_PAGE = 20


def lines(docs: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """doc_id, source, line_no, page_no, slot, para_no, part, line, n_words, size, y of every line."""
    # words are split once a paragraph, before the lambda that asks for them again and again
    paras = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda para: F.split(para, " ", -1))

    def lines_of(words, no):
        parts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / WORDS_A_LINE).cast("int"))
        return F.transform(parts, lambda i: F.struct(no.alias("para_no"), i.alias("part"), F.slice(words, i * WORDS_A_LINE + 1, WORDS_A_LINE).alias("words")))

    # the list is never empty; a plain explode would test that, and make the list twice
    rows = docs.select("doc_id", "source", F.posexplode_outer(F.flatten(F.transform(paras, lines_of))).alias("line_no", "l"))
    rows = rows.select("doc_id", "source", "line_no", "l.para_no", "l.part", F.array_join("l.words", " ").alias("line"), F.size("l.words").cast("long").alias("n_words"))
    title = (F.col("para_no") == 0) & (F.col("part") == 0)
    number = F.col("line_no").cast("long")
    page = F.floor(number / lines_a_page)
    slot = number % lines_a_page
    return rows.select("doc_id", "source", number.alias("line_no"), page.alias("page_no"), slot.alias("slot"), F.col("para_no").cast("long").alias("para_no"), F.col("part").cast("long").alias("part"), "line", "n_words", F.when(title, 16.0).otherwise(10.0).alias("size"), (F.lit(770.0) - 14.0 * slot).alias("y"))


#: The same lines for DuckDB.
LINES_SQL = f"""
paras AS (SELECT doc_id, source, unnest(range(len(ps))) AS para_no, unnest(ps) AS para FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents)),
words AS (SELECT doc_id, source, para_no, unnest(range(len(ws))) AS word_no, unnest(ws) AS word FROM (SELECT *, string_split(para, ' ') AS ws FROM paras)),
grouped AS (SELECT doc_id, source, para_no, word_no // {WORDS_A_LINE} AS part, string_agg(word, ' ' ORDER BY word_no) AS line, count(*)::BIGINT AS n_words FROM words GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no, part) - 1 AS line_no FROM grouped),
lines AS (SELECT doc_id, source, line_no::BIGINT AS line_no, (line_no // {LINES_A_PAGE})::BIGINT AS page_no, (line_no % {LINES_A_PAGE})::BIGINT AS slot, para_no::BIGINT AS para_no, part::BIGINT AS part, line, n_words,
  CASE WHEN para_no = 0 AND part = 0 THEN 16.0::DOUBLE ELSE 10.0::DOUBLE END AS size, (770 - 14 * (line_no % {LINES_A_PAGE}))::DOUBLE AS y FROM numbered)"""
