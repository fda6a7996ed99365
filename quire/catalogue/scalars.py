"""Queries of scalar functions: strings, boxes, maps, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.plans import bridge
from quire.plans import model as M
from quire.registry import documents, query

_LINES = "WITH " + bridge.LINES_SQL.strip()


def marked_lines(docs):
    """The bridge's lines; some get a control character, Hebrew, Greek or Chinese letters, by their number."""
    tail = F.element_at(F.array(F.lit(""), F.lit("\x01"), F.lit(" שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם"), F.lit(" 文字"), F.lit(" Ωμέγα-"), F.lit("￾")), (F.col("line_no") % 6 + 1).cast("int"))
    return bridge.lines(docs).withColumn("line", F.concat("line", tail))


_MARKED = _LINES + """, marked AS (SELECT doc_id, line_no, line || ['', chr(1), ' שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם שלום עולם', ' 文字', ' Ωμέγα-', chr(65534)][(line_no % 6 + 1)::INT] AS line FROM lines)"""


@query(_MARKED + " SELECT doc_id, line_no, replace(replace(line, chr(1), chr(65533)), chr(65534), chr(65533)) AS line FROM marked")
def sanitize_text(spark, sf_dir):
    return marked_lines(documents(spark, sf_dir)).select("doc_id", "line_no", T.sanitize(F.col("line")).alias("line"))


@query(_MARKED + """ SELECT doc_id, line_no, len(regexp_extract_all(line, '[\\x{0590}-\\x{05F4}]')) * 2 > len(regexp_extract_all(line, '\\p{L}')) AS rtl,
  NOT len(regexp_extract_all(line, '[\\x{0590}-\\x{05F4}]')) * 2 > len(regexp_extract_all(line, '\\p{L}')) AND NOT regexp_matches(line, '[\\x{4E00}-\\x{9FFF}]') AS ltr_words,
  CASE WHEN line = '' OR regexp_matches(line, '[ \\t\\n\\x0B\\f\\r-]$') THEN line ELSE line || ' ' END AS open FROM marked""")
def script_direction(spark, sf_dir):
    c = F.col("line")
    return marked_lines(documents(spark, sf_dir)).select("doc_id", "line_no", T.is_rtl(c).alias("rtl"), T.is_ltr_words(c).alias("ltr_words"), T.ends_open(c).alias("open"))


def box_pairs(docs):
    """Each block's box beside the next one's and a shifted copy."""
    from pyspark.sql import Window as W

    b = M.blocks(docs)
    own = G.rect(*(F.col(c) for c in G.SIDES))
    rows = b.select("doc_id", "ord", own.alias("a"), F.lead(own).over(W.partitionBy("doc_id").orderBy("ord")).alias("next"))
    shifted = lambda r: G.rect(r["x0"] - 300, r["y0"] - 140, r["x1"], r["y1"])
    return rows.where("next is not null").select("doc_id", "ord", "a", shifted(F.col("next")).alias("b"))


_PAIRS = """
p AS (SELECT doc_id, ord, x0, y0, x1, y1, lead(x0) OVER o - 300 AS bx0, lead(y0) OVER o - 140 AS by0, lead(x1) OVER o AS bx1, lead(y1) OVER o AS by1 FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY ord))"""


@query(M.sql() + "," + _PAIRS + """ SELECT doc_id, ord, least(x0, bx0) AS ux0, greatest(y1, by1) AS uy1, x0 < bx1 AND bx0 < x1 AND y0 < by1 AND by0 < y1 AS meets,
  CASE WHEN x0 < bx1 AND bx0 < x1 AND y0 < by1 AND by0 < y1 THEN (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) END AS shared, x0 - 10 <= bx0 AND y0 - 10 <= by0 AND x1 + 10 >= bx1 AND y1 + 10 >= by1 AS holds FROM p WHERE bx0 IS NOT NULL""")
def rect_algebra(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    both = G.intersection(a, b)
    area = (both["x1"] - both["x0"]) * (both["y1"] - both["y0"])
    return box_pairs(documents(spark, sf_dir)).select("doc_id", "ord", G.union(a, b)["x0"].alias("ux0"), G.union(a, b)["y1"].alias("uy1"), G.intersects(a, b).alias("meets"), area.alias("shared"), G.contains(G.inflate(a, F.lit(10)), b).alias("holds"))


_MAPS = """
m AS (SELECT doc_id, ord, x0, y0, x1, y1, [2, 0, -1, 0, 3][(h % 5 + 1)::INT]::DOUBLE AS a, [0, 2, 0, -1, 4][(h % 5 + 1)::INT]::DOUBLE AS b, [0, -2, 0, 1, 1][(h % 5 + 1)::INT]::DOUBLE AS c, [1, 0, -1, 0, 2][(h % 5 + 1)::INT]::DOUBLE AS d, (h % 100)::DOUBLE AS e, 7.0::DOUBLE AS f FROM blocks)"""


def maps(docs):
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("h") % 5 + 1).cast("int"))
    m = G.affine(pick(2, 0, -1, 0, 3), pick(0, 2, 0, -1, 4), pick(0, -2, 0, 1, 1), pick(1, 0, -1, 0, 2), F.col("h") % 100, F.lit(7))
    return M.blocks(docs).withColumn("m", m).withColumn("r", G.rect(*(F.col(c) for c in G.SIDES)))


@query(M.sql() + "," + _MAPS + """ SELECT doc_id, ord, least(a*x0+c*y0+e, a*x0+c*y1+e, a*x1+c*y0+e, a*x1+c*y1+e) AS mx0, greatest(b*x0+d*y0+f, b*x0+d*y1+f, b*x1+d*y0+f, b*x1+d*y1+f) AS my1, a * d - b * c AS det,
  pmod_(floor(atan2(b, a) / (pi() / 2) + 0.5)::BIGINT) AS turns, x0::DOUBLE AS back FROM m""".replace("pmod_(floor(atan2(b, a) / (pi() / 2) + 0.5)::BIGINT)", "((floor(atan2(b, a) / (pi() / 2) + 0.5)::BIGINT % 4) + 4) % 4"))
def affine_maps(spark, sf_dir):
    m, r = F.col("m"), F.col("r")
    there = G.mapped(m, r["x0"], r["y0"])
    back = G.mapped(G.inverse(m), there["x"], there["y"])["x"]
    return maps(documents(spark, sf_dir)).select("doc_id", "ord", G.mapped_rect(m, r)["x0"].alias("mx0"), G.mapped_rect(m, r)["y1"].alias("my1"), G.determinant(m).alias("det"), G.quarter_turns(m["a"], m["b"]).alias("turns"), F.round(back, 6).alias("back"))


@query(M.sql() + """, t AS (SELECT doc_id, ord, [0, 90, 180, 270][(h % 4 + 1)::INT] AS rot, x0 / 1000.0 AS x, (1000 - y1) / 1000.0 AS y, (x1 - x0) / 1000.0 AS w, (y1 - y0) / 1000.0 AS h FROM blocks),
g AS (SELECT doc_id, ord, CASE rot WHEN 90 THEN 1 - (y + h) WHEN 180 THEN 1 - (x + w) WHEN 270 THEN y ELSE x END AS l, CASE rot WHEN 90 THEN x WHEN 180 THEN 1 - (y + h) WHEN 270 THEN 1 - (x + w) ELSE y END AS t, CASE WHEN rot IN (90, 270) THEN h ELSE w END AS a, CASE WHEN rot IN (90, 270) THEN w ELSE h END AS d FROM t)
SELECT doc_id, ord, least(500, greatest(0, floor(round(l * 500, 6) + 0.5)))::BIGINT AS gx0, least(500, greatest(0, floor(round(t * 500, 6) + 0.5)))::BIGINT AS gy0, least(500, greatest(0, floor(round((l + a) * 500, 6) + 0.5)))::BIGINT AS gx1, least(500, greatest(0, floor(round((t + d) * 500, 6) + 0.5)))::BIGINT AS gy1 FROM g""")
def grid_rotated(spark, sf_dir):
    rot = F.element_at(F.array(*(F.lit(x) for x in (0, 90, 180, 270))), (F.col("h") % 4 + 1).cast("int"))
    page = G.rect(*(F.lit(v) for v in (0, 0, 1000, 1000)))
    cell = G.on_grid(G.rect(*(F.col(c) for c in G.SIDES)), page, rot, 500)
    return M.blocks(documents(spark, sf_dir)).select("doc_id", "ord", *(cell[c].alias(f"g{c}") for c in G.SIDES))


@query("""
WITH c AS (SELECT event_id, (event_id * 2654435761) % 16777216 + CASE WHEN event_id % 3 = 0 THEN 4278190080 ELSE 2147483648 END AS argb FROM events),
p AS (SELECT *, (argb >> 24) & 255 AS a, (argb >> 16) & 255 AS r, (argb >> 8) & 255 AS g, argb & 255 AS b FROM c)
SELECT event_id, CASE WHEN a = 255 THEN '#' || lpad(lower(to_hex(argb & 16777215)), 6, '0') ELSE 'rgba(' || r || ',' || g || ',' || b || ',' || printf('%.3f', a / 255.0) || ')' END AS css, CASE WHEN a = 255 THEN argb END AS back FROM p""")
def colour_css(spark, sf_dir):
    argb = (F.col("event_id") * 2654435761) % 16777216 + F.when(F.col("event_id") % 3 == 0, F.lit(4278190080)).otherwise(F.lit(2147483648))
    shown = G.css(argb)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", shown.alias("css"), G.from_hex(shown).alias("back"))
