"""Queries of block signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import signals as S
from quire.plans import model as M
from quire.registry import documents, query

_BANDS = f"""
narrow AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_no ORDER BY x0, x1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM blocks WHERE x1 - x0 <= {S.BAND_WIDTH} AND x1 > x0),
banded AS (SELECT *, sum(CASE WHEN x0 - reach < {S.BAND_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY x0, x1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS band FROM narrow),
bands AS (SELECT doc_id, page_no, band, min(x0) AS bx0, max(x1) AS bx1 FROM banded GROUP BY ALL)"""


@query(M.sql("runs") + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY n_chars DESC, run) AS r FROM runs)
SELECT doc_id, ord, max(size) FILTER (r = 1)::BIGINT AS size, max(family) FILTER (r = 1) AS family, sum(n_chars)::BIGINT AS n_chars, sum(CASE WHEN bold THEN n_chars ELSE 0 END)::BIGINT AS bold_chars FROM ranked GROUP BY 1, 2""")
def dominant_run(spark, sf_dir):
    return S.dominant_runs(M.runs(documents(spark, sf_dir)))


@query(M.sql("runs") + """, by_size AS (SELECT doc_id, ord, floor(size * 2.0 + 0.5) / 2 AS style, sum(n_chars) AS ink, sum(CASE WHEN bold THEN n_chars ELSE 0 END) AS heavy FROM runs GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY ink DESC, style DESC) AS r FROM by_size)
SELECT doc_id, ord, max(style) FILTER (r = 1)::DOUBLE AS style, sum(heavy) * 100 >= sum(ink) * 60 AS bold FROM ranked GROUP BY 1, 2""")
def line_style(spark, sf_dir):
    return S.line_styles(M.runs(documents(spark, sf_dir)))


@query(M.sql() + "," + _BANDS + " SELECT * FROM bands")
def column_bands(spark, sf_dir):
    return S.column_bands(M.blocks(documents(spark, sf_dir)))


@query(M.sql() + "," + _BANDS + """,
own AS (SELECT b.doc_id, b.ord, b.x0, b.x1, min({'band': band, 'bx0': bx0, 'bx1': bx1}) FILTER (b.x0 + b.x1 >= 2 * bx0 AND b.x0 + b.x1 <= 2 * bx1) AS c FROM blocks b LEFT JOIN bands USING (doc_id, page_no) GROUP BY 1, 2, 3, 4)
SELECT doc_id, ord, coalesce(c.band, 0)::BIGINT AS band, floor((x0 - coalesce(c.bx0, 0)) * 1000.0 / coalesce(c.bx1 - c.bx0, 1000) + 0.5)::BIGINT AS indent, floor((x1 - x0) * 1000.0 / coalesce(c.bx1 - c.bx0, 1000) + 0.5)::BIGINT AS width FROM own""")
def column_places(spark, sf_dir):
    b = M.blocks(documents(spark, sf_dir))
    return S.column_places(b, S.column_bands(b))


@query(M.sql("fills") + f""", small AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM fills WHERE (x1 - x0) * (y1 - y0) * 100 <= 1000000 * {S.PAGE_SHARE}),
pairs AS (SELECT b.doc_id, b.ord, f.colour, row_number() OVER (PARTITION BY b.doc_id, b.ord ORDER BY f.area, f.z DESC) AS r FROM blocks b JOIN small f USING (doc_id, page_no)
  WHERE f.z < b.ord * 10 AND b.x1 > b.x0 AND b.y1 > b.y0 AND greatest(0, least(b.x1, f.x1) - greatest(b.x0, f.x0)) * greatest(0, least(b.y1, f.y1) - greatest(b.y0, f.y0)) * 100 >= (b.x1 - b.x0) * (b.y1 - b.y0) * {S.COVERED})
SELECT doc_id, ord, colour FROM pairs WHERE r = 1""")
def block_background(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.backgrounds(M.blocks(docs), M.fills(docs))


def block_lines(docs):
    """Lines of blocks for alignment: four runs to a line, edges that waver with the block's number."""
    own = M.runs(docs).withColumn("line", F.expr("run div 4")).groupBy("doc_id", "ord", "line").agg(F.sum("n_chars").alias("n"))
    k = F.col("doc_id") + F.col("ord")
    x0 = F.when(k % 4 == 2, 100 + F.col("line") * 37 % 90).when(k % 4 == 3, 300 - F.expr("n div 2") * 2).otherwise(100)
    x1 = F.when(k % 4 == 0, 500).when(k % 4 == 2, 500).when(k % 4 == 3, 300 + F.expr("n div 2") * 2).otherwise(100 + 5 * F.col("n"))
    return own.select("doc_id", "ord", "line", x0.cast("long").alias("x0"), x1.cast("long").alias("x1"), F.lit(100).alias("left"), F.lit(500).alias("right"))


@query(M.sql("runs") + f""", l0 AS (SELECT doc_id, ord, run // 4 AS line, sum(n_chars)::BIGINT AS n FROM runs GROUP BY 1, 2, 3),
l1 AS (SELECT *, CASE WHEN (doc_id + ord) % 4 = 2 THEN 100 + line * 37 % 90 WHEN (doc_id + ord) % 4 = 3 THEN 300 - (n // 2) * 2 ELSE 100 END AS x0,
  CASE WHEN (doc_id + ord) % 4 IN (0, 2) THEN 500 WHEN (doc_id + ord) % 4 = 3 THEN 300 + (n // 2) * 2 ELSE 100 + 5 * n END AS x1, max(line) OVER (PARTITION BY doc_id, ord) AS last FROM l0),
g AS (SELECT doc_id, ord, count(*) AS n, max(x0) - min(x0) AS l, max(x1) FILTER (line < last) - min(x1) FILTER (line < last) AS r, max(x1) - min(x1) AS e, max(x0 + x1) - min(x0 + x1) AS m FROM l1 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, ord, CASE WHEN l * 100 <= 400 * {S.EDGE} AND r * 100 <= 400 * {S.EDGE} AND n >= 3 THEN 'justify' WHEN l * 100 <= 400 * {S.EDGE} THEN 'left' WHEN e * 100 <= 400 * {S.EDGE} THEN 'right' WHEN m * 100 <= 800 * {S.EDGE} THEN 'center' ELSE '' END AS align FROM g""")
def alignment(spark, sf_dir):
    return S.alignments(block_lines(documents(spark, sf_dir)))


@query(M.sql() + " SELECT doc_id, ord, CASE WHEN abs(angle) < 5 THEN 0 ELSE angle END::BIGINT AS rotation FROM blocks")
def block_rotation(spark, sf_dir):
    return S.rotations(M.blocks(documents(spark, sf_dir)))


@query(M.sql("runs") + """, s AS (SELECT doc_id, 'size' AS kind, size::VARCHAR AS value, sum(n_chars)::BIGINT AS ink FROM runs GROUP BY ALL UNION ALL SELECT doc_id, 'family', family, sum(n_chars)::BIGINT FROM runs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ink DESC, value) AS rank FROM s)
SELECT doc_id, kind, rank, value, ink FROM r WHERE rank <= CASE WHEN kind = 'size' THEN 5 ELSE 3 END
UNION ALL SELECT doc_id, 'bold', 1, floor(100.0 * sum(CASE WHEN bold THEN n_chars ELSE 0 END) / sum(n_chars) + 0.5)::BIGINT::VARCHAR, sum(n_chars)::BIGINT FROM runs GROUP BY doc_id HAVING sum(n_chars) > 0""")
def signal_profile_topk(spark, sf_dir):
    return S.profiles(M.runs(documents(spark, sf_dir)))


@query(M.sql("runs") + """, body AS (SELECT doc_id, (list_sort(list(size)))[len(list(size)) // 2 + 1] AS body FROM runs GROUP BY 1),
f AS (SELECT doc_id, body, family, sum(n_chars) AS ink FROM runs JOIN body USING (doc_id) WHERE size * 100 >= body * 85 AND size * 100 <= body * 120 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ink DESC, family DESC) AS r FROM f) SELECT doc_id, body::BIGINT AS body, family FROM r WHERE r = 1""")
def body_size_family(spark, sf_dir):
    return S.body_sizes(M.runs(documents(spark, sf_dir)))


@query(M.sql() + """, g AS (SELECT doc_id, page_no, y0 - lag(y1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, ord) AS gap FROM blocks)
SELECT doc_id, page_no, (list_sort(list(gap)))[len(list(gap)) // 2 + 1]::BIGINT AS gap FROM g WHERE gap >= 0 GROUP BY 1, 2""")
def median_gap(spark, sf_dir):
    return S.gaps(M.blocks(documents(spark, sf_dir)))
