"""Queries of structure recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout
from quire.operators import structure as S
from quire.catalogue.signals import block_lines
from quire.plans import bridge
from quire.plans import model as M
from quire.registry import documents, query

#: Characters from which on a block counts as running text.
COPY_CHARS = 200


def styled(docs):
    """Blocks with text as lines: one line for every 90 characters."""
    b = M.blocks(docs).where("text <> ''")
    return b.withColumns({"copy": F.col("n_chars") >= COPY_CHARS, "n_lines": F.expr("n_chars div 90 + 1"), "running": F.col("h") % 23 == 0})


_STYLES = f"""
lines AS (SELECT *, n_chars >= {COPY_CHARS} AS copy, n_chars // 90 + 1 AS n_lines, h % 23 = 0 AS running, max(size) OVER (PARTITION BY doc_id, page_no) AS top FROM blocks WHERE text <> ''),
s0 AS (SELECT doc_id, size, bold, sum(n_chars)::BIGINT AS ink, count(*) AS n_lines, count(DISTINCT page_no) AS n_pages, list(DISTINCT page_no) AS pages, bool_and(size >= top - {S.SAME_SIZE}) AS tops, sum(copy::INT) AS copies FROM lines GROUP BY 1, 2, 3),
s1 AS (SELECT *, first_value(size) OVER o AS bsize, first_value(bold) OVER o AS bbold FROM s0 WINDOW o AS (PARTITION BY doc_id ORDER BY ink DESC, size DESC, bold DESC)),
s2 AS (SELECT *, size = bsize AND bold = bbold AS is_body, size >= bsize * {S.LARGER} AS larger FROM s1),
s3 AS (SELECT *, NOT is_body AND copies < {S.COPY_BLOCKS} AND (larger OR (bold AND NOT bbold AND abs(size - bsize) <= {S.SAME_SIZE})) AS raised FROM s2),
s4 AS (SELECT *, raised AND (n_pages >= {S.MIN_PAGES} OR n_lines >= {S.MIN_LINES}) AS head FROM s3),
s5 AS (SELECT *, NOT is_body AND copies < {S.COPY_BLOCKS} AND NOT head AND larger AND tops AS display FROM s4),
shown AS (SELECT doc_id, count(DISTINCT p) AS shown FROM (SELECT doc_id, unnest(pages) AS p FROM s5 WHERE display) GROUP BY 1),
s6 AS (SELECT s5.*, count(*) FILTER (display) OVER (PARTITION BY s5.doc_id) > 1 AND coalesce(shown, 0) >= {S.MIN_LINES} AS magazine FROM s5 LEFT JOIN shown ON s5.doc_id = shown.doc_id),
heads AS (SELECT *, row_number() OVER o AS r, lag(size) OVER o AS lsize, lag(bold) OVER o AS lbold FROM s6 WHERE head WINDOW o AS (PARTITION BY doc_id ORDER BY size DESC, bold DESC)),
ranked AS (SELECT *, sum(CASE WHEN lsize IS NULL OR lsize - size > {S.SAME_SIZE} OR lbold <> bold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC) AS own FROM heads),
tophead AS (SELECT doc_id, size AS hsize, tops AS htops FROM heads WHERE r = 1),
largest AS (SELECT doc_id, size AS tsize, bold AS tbold FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC) AS r FROM s6 WHERE raised) WHERE r = 1),
styles AS (SELECT s6.doc_id, s6.size, s6.bold, s6.ink, s6.n_lines, s6.n_pages, s6.is_body,
  NOT s6.magazine AND NOT s6.head AND coalesce(s6.size = tsize AND s6.bold = tbold, FALSE) AND (hsize IS NULL OR s6.size > hsize + {S.SAME_SIZE}) AS is_title,
  (CASE WHEN s6.head THEN own + CASE WHEN s6.magazine AND NOT htops THEN 1 ELSE 0 END WHEN s6.magazine AND s6.display THEN 1 ELSE 0 END)::BIGINT AS level
  FROM s6 LEFT JOIN ranked ON ranked.doc_id = s6.doc_id AND ranked.size = s6.size AND ranked.bold = s6.bold LEFT JOIN tophead ON tophead.doc_id = s6.doc_id LEFT JOIN largest ON largest.doc_id = s6.doc_id),
headings AS (SELECT l.doc_id, l.ord, (CASE WHEN is_title THEN 1 ELSE least(level, 6) END)::BIGINT AS level, l.text AS title FROM lines l JOIN styles s ON s.doc_id = l.doc_id AND s.size = l.size AND s.bold = l.bold
  WHERE NOT running AND regexp_matches(l.text, '\\p{{L}}{{2,}}') AND l.n_lines <= 2 AND l.n_chars <= 160 AND (is_title OR level > 0))"""


@query(M.sql() + "," + _STYLES + " SELECT doc_id, size, bold, ink, n_lines, n_pages, is_body, is_title, level FROM styles")
def style_levels(spark, sf_dir):
    return S.style_levels(styled(documents(spark, sf_dir)))


def _headings(docs):
    lines = styled(docs)
    return S.headings(lines, S.style_levels(lines))


@query(M.sql() + "," + _STYLES + " SELECT * FROM headings")
def heading_test(spark, sf_dir):
    return _headings(documents(spark, sf_dir))


@query(M.sql() + "," + _STYLES + """, parents AS (SELECT h.doc_id, h.ord, max(p.ord) AS parent FROM headings h LEFT JOIN headings p ON p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level GROUP BY 1, 2)
SELECT h.doc_id, h.ord, h.level, parent, CASE WHEN length(title) > 120 THEN substring(title, 1, 120) || '…' ELSE title END AS label FROM headings h JOIN parents USING (doc_id, ord)""")
def toc_nested(spark, sf_dir):
    own = _headings(documents(spark, sf_dir))
    label = F.when(F.length("title") > 120, F.concat(F.substring("title", 1, 120), F.lit("…"))).otherwise(F.col("title"))
    return layout.heading_parents(own, label.alias("label"))


_BLOCK_LINES = """
l0 AS (SELECT doc_id, ord, run // 4 AS line, sum(n_chars)::BIGINT AS n FROM runs GROUP BY 1, 2, 3),
blines AS (SELECT doc_id, ord, line, CASE WHEN (doc_id + ord) % 4 = 2 THEN 100 + line * 37 % 90 WHEN (doc_id + ord) % 4 = 3 THEN 300 - (n // 2) * 2 ELSE 100 END AS x0,
  CASE WHEN (doc_id + ord) % 4 IN (0, 2) THEN 500 WHEN (doc_id + ord) % 4 = 3 THEN 300 + (n // 2) * 2 ELSE 100 + 5 * n END AS x1 FROM l0),
last AS (SELECT *, max(line) OVER (PARTITION BY doc_id, ord) AS last FROM blines),
measured AS (SELECT doc_id, ord, count(*) AS n_lines, max(x1 - x0) AS own, min(x1 - x0) FILTER (line < last) AS wrapped, max(x1 - x0) FILTER (line = last) AS "end", max(x0) FILTER (line = 0) - max(x0) FILTER (line = 1) AS lead FROM last GROUP BY 1, 2)"""


def _carries(a: str, b: str, place: str) -> str:
    """Test for DuckDB that block b goes on where block a ended."""
    col = f"greatest({a}.own, {b}.own)"
    measure = f"(CASE WHEN {a}.own * 100 < {col} * {S.RAGGED} THEN {col} ELSE {a}.own END)"
    return f"""coalesce(abs({b}.size - {a}.size) * 2 <= 1 AND {col} > 0 AND {a}.n_lines >= 2 AND {a}."end" >= greatest(least({measure} * {S.FULL} / 100, {a}.wrapped), {measure} * {S.RAGGED} / 100)
      AND ({b}.n_lines < 2 OR {b}.lead * 100 <= {S.INDENT} * greatest(1, {b}.size)) AND ({place.format(a=a, b=b, col=col, slack=S.SLACK)}), FALSE)"""


_OVER = "abs({b}.x0 - {a}.x0) * 100 <= {slack} * {col} OR abs(({b}.x1 - {b}.x0) - ({a}.x1 - {a}.x0)) * 100 <= {slack} * {col}"
_BESIDE = "{b}.x0 * 100 >= {a}.x1 * 100 - {slack} * {col} AND {b}.x0 - {a}.x1 < {col} AND {b}.y0 < {a}.y1"


# The SQL walks block by block with what is open, carried and held; the query has no walk.
@query(M.sql("runs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _BLOCK_LINES + f""",
j AS MATERIALIZED (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS seq, page_no, size, x0, x1, y0, y1, n_chars, size >= 14 AS heading, m.n_lines, m.own, m.wrapped, m."end", m.lead FROM blocks JOIN measured m USING (doc_id, ord)),
w AS (SELECT doc_id, seq, page_no, 1::BIGINT AS para, 1::BIGINT AS n, NOT heading AS open, NULL::BIGINT AS carry, NULL::BIGINT AS carried FROM j WHERE seq = 1
  UNION ALL
  SELECT doc_id, seq, page_no, CASE WHEN late THEN carried WHEN goes THEN para ELSE n + 1 END, CASE WHEN late OR goes THEN n ELSE n + 1 END, NOT heading AND NOT late,
    CASE WHEN NOT late AND NOT goes AND label THEN carry END, CASE WHEN NOT late AND NOT goes AND label THEN carried END
  FROM (SELECT s.doc_id, b.seq, b.page_no, s.para, s.n, b.heading, s.carry, s.carried, NOT b.heading AND b.n_lines < {S.COLUMN_LINES} AND b.n_chars < {S.LABEL_LETTERS} AND c.page_no = b.page_no - 1 AS label,
      NOT first AND NOT b.heading AND c.page_no = b.page_no - 1 AND {_carries("c", "b", _OVER)} IS TRUE AND s.carry IS NOT NULL AS late,
      s.open AND NOT b.heading AND CASE WHEN first THEN b.page_no = a.page_no + 1 AND {_carries("a", "b", _OVER)} ELSE {_carries("a", "b", _BESIDE)} END AS goes
    FROM (SELECT w.doc_id, w.seq, w.para, w.n, w.open, x.page_no <> w.page_no AS first, CASE WHEN x.page_no = w.page_no THEN w.carry WHEN w.open THEN w.seq END AS carry, CASE WHEN x.page_no = w.page_no THEN w.carried WHEN w.open THEN w.para END AS carried
        FROM w JOIN j x ON x.doc_id = w.doc_id AND x.seq = w.seq + 1) s
      JOIN j b ON b.doc_id = s.doc_id AND b.seq = s.seq + 1 JOIN j a ON a.doc_id = s.doc_id AND a.seq = s.seq LEFT JOIN j c ON c.doc_id = s.doc_id AND c.seq = s.carry))
SELECT w.doc_id, ord, para FROM w JOIN j USING (doc_id, seq)""")
def paragraph_continuation(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.continued(M.blocks(docs).withColumn("interrupts", F.col("size") >= 14), S.measures(block_lines(docs)))


@query(M.sql("runs") + """, m AS (SELECT *, first_value(size) OVER (PARTITION BY doc_id, ord ORDER BY n_chars DESC, run) AS main FROM runs)
SELECT doc_id, ord, string_agg(text, ' ' ORDER BY run) AS title FROM m WHERE NOT (regexp_matches(text, '^[0-9]+$') AND size * 10 <= main * 8) GROUP BY 1, 2""")
def heading_text(spark, sf_dir):
    return S.heading_text(M.runs(documents(spark, sf_dir)))


_KEY = "lower(trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query(M.sql("outline") + f""", w AS (SELECT *, CASE WHEN regexp_matches(title, '\\p{{L}}{{2,}}') THEN {_KEY.format('title')} ELSE '' END AS want FROM outline),
p AS (SELECT w.doc_id, entry, ord, abs(y0 - y) AS far, CASE WHEN want <> '' AND {_KEY.format('b.text')} = want THEN 1 WHEN want <> '' AND (starts_with({_KEY.format('b.text')}, want) OR starts_with(want, {_KEY.format('b.text')}) OR contains({_KEY.format('b.text')}, want)) THEN 2 ELSE 3 END AS tier
  FROM w JOIN blocks b USING (doc_id, page_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY tier, far, ord) AS r FROM p),
b AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS sure FROM r WHERE r = 1)
SELECT doc_id, entry, ord, tier::BIGINT AS tier FROM b WHERE sure < 3""")
def outline_anchor_nearest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.anchors(M.outline(docs), M.blocks(docs))


def _titles(docs):
    """Bookmarks that spell two or three of the bridge's lines."""
    own = bridge.lines(docs).where("line <> ''").groupBy("doc_id", "para_no").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("part", "line"))), 1, 3), lambda x: x["line"]), "  ").alias("title"))
    return own.where("para_no % 3 = 0").select("doc_id", F.col("para_no").alias("entry"), "title")


@query("WITH " + bridge.LINES_SQL.strip() + f""", o0 AS (SELECT doc_id, para_no AS entry, line, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY part) AS r FROM lines WHERE line <> '' AND para_no % 3 = 0),
titles AS (SELECT doc_id, entry, {_KEY.format("string_agg(line, '  ' ORDER BY r)")} AS said FROM o0 WHERE r <= 3 GROUP BY 1, 2),
k AS (SELECT doc_id, line_no, {_KEY.format('line')} AS key FROM lines),
n AS (SELECT *, lead(key, 1) OVER o AS n1, lead(key, 2) OVER o AS n2, lead(key, 3) OVER o AS n3 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
s AS (SELECT doc_id, line_no, 1 AS k, key AS said FROM n UNION ALL SELECT doc_id, line_no, 2, concat_ws(' ', key, n1) FROM n UNION ALL SELECT doc_id, line_no, 3, concat_ws(' ', key, n1, n2) FROM n UNION ALL SELECT doc_id, line_no, 4, concat_ws(' ', key, n1, n2, n3) FROM n),
m AS (SELECT t.doc_id, entry, line_no, k, row_number() OVER (PARTITION BY t.doc_id, entry ORDER BY line_no, k) AS r FROM titles t JOIN (SELECT doc_id, line_no, k, trim(regexp_replace(said, ' +', ' ', 'g')) AS said FROM s) s USING (doc_id, said) WHERE said <> '')
SELECT doc_id, entry, line_no, k::BIGINT AS k FROM m WHERE r = 1""")
def outline_alignment(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.aligned_titles(_titles(docs), bridge.lines(docs))


@query(M.sql("outline", "nodes") + """, t AS (SELECT doc_id, sum(CASE WHEN type = 'HEADING' THEN 1 ELSE 0 END) > 2 AS tags FROM nodes GROUP BY 1), o AS (SELECT doc_id, count(*) > 0 AS marks FROM outline GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'heuristic' WHEN tags THEN 'tags' WHEN coalesce(marks, FALSE) THEN 'bookmarks' ELSE 'heuristic' END AS policy FROM t LEFT JOIN o USING (doc_id)""")
def outline_policy(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tags = M.nodes(docs).groupBy("doc_id").agg((F.count(F.when(F.col("type") == "HEADING", 1)) > 2).alias("tags"))
    marks = M.outline(docs).groupBy("doc_id").agg((F.count("*") > 0).alias("marks"))
    return tags.join(marks, "doc_id", "left").select("doc_id", S.outline_policy(F.col("tags"), F.coalesce("marks", F.lit(False)), F.col("doc_id") % 11 == 0).alias("policy"))


@query(M.sql() + """, s AS (SELECT doc_id, 'pdf' AS structure, ord AS seq, ord, h % 3 + 1 AS level FROM blocks WHERE doc_id % 3 = 0 AND h % 4 = 0
  UNION ALL SELECT doc_id, 'outline', ord + 1, ord, h % 2 + 1 FROM blocks WHERE doc_id % 3 < 2 AND size > 10 UNION ALL SELECT doc_id, 'heuristic', 1000 - ord, ord, 2 FROM blocks WHERE size > 11 UNION ALL SELECT doc_id, 'heuristic', ord, ord, 3 FROM blocks WHERE size > 17),
b AS (SELECT *, list_position(['default', 'pdf', 'outline', 'heuristic'], structure) AS rank FROM s), c AS (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS best FROM b),
f AS (SELECT doc_id, ord, level, row_number() OVER (PARTITION BY doc_id, ord ORDER BY seq, level) AS r FROM c WHERE rank = best)
SELECT doc_id, ord, CASE WHEN level IS NULL THEN 'P' ELSE 'H' || level END AS role FROM blocks LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (doc_id, ord)""")
def heading_roles(spark, sf_dir):
    b = M.blocks(documents(spark, sf_dir))
    row = lambda name, seq, level, when: F.when(when, F.struct(F.lit(name).alias("structure"), seq.cast("long").alias("seq"), level.cast("long").alias("level")))
    kinds = F.array(
        row("pdf", F.col("ord"), F.col("h") % 3 + 1, (F.col("doc_id") % 3 == 0) & (F.col("h") % 4 == 0)), row("outline", F.col("ord") + 1, F.col("h") % 2 + 1, (F.col("doc_id") % 3 < 2) & (F.col("size") > 10)),
        row("heuristic", 1000 - F.col("ord"), F.lit(2), F.col("size") > 11), row("heuristic", F.col("ord"), F.lit(3), F.col("size") > 17),
    )
    own = b.select("doc_id", "ord", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("s")).select("doc_id", "ord", "s.*")
    return S.heading_roles(own, b)


_DECOR = """
np AS (SELECT doc_id, max(page_no) + 1 AS n_pages FROM blocks GROUP BY 1),
decor AS (SELECT doc_id, ref, (floor(x0 / 2.0 + 0.5) * 2)::BIGINT AS x0, (floor(y0 / 2.0 + 0.5) * 2)::BIGINT AS y0, (floor(x1 / 2.0 + 0.5) * 2)::BIGINT AS x1, (floor(y1 / 2.0 + 0.5) * 2)::BIGINT AS y1, count(DISTINCT page_no) AS pages
  FROM pictures JOIN np USING (doc_id) GROUP BY 1, 2, 3, 4, 5, 6, n_pages HAVING count(DISTINCT page_no) >= greatest(3, (n_pages + 1) // 2))"""


def _decoration(docs):
    return S.repeated_pictures(M.pictures(docs), M.blocks(docs).groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages")))


@query(M.sql("pictures") + "," + _DECOR + " SELECT * FROM decor")
def repeated_pictures(spark, sf_dir):
    return _decoration(documents(spark, sf_dir))


def _walls(docs):
    """Pictures set as tiles: the page's number modulo 2 as their bytes."""
    b = M.blocks(docs).where("h % 2 = 0")
    return b.select("doc_id", "page_no", "ord", F.md5(F.concat(F.lit("t"), (F.col("page_no") % 2 + F.when(F.col("slot") == 4, 7).otherwise(0)).cast("string"))).alias("sha"))


@query(M.sql() + """, t AS (SELECT doc_id, page_no, ord, md5('t' || (page_no % 2 + CASE WHEN slot = 4 THEN 7 ELSE 0 END)::VARCHAR) AS sha FROM blocks WHERE h % 2 = 0),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, sha) AS n, row_number() OVER (PARTITION BY doc_id, page_no, sha ORDER BY ord) AS r FROM t) SELECT doc_id, page_no, ord, sha FROM c WHERE n < 3 OR r = 1""")
def tiled_pictures(spark, sf_dir):
    return S.tiles(_walls(documents(spark, sf_dir)))


@query(M.sql("pictures") + "," + _DECOR + """, big AS (SELECT doc_id, page_no, ord, ref, z, running, CASE WHEN ord % 5 = 0 THEN 0 ELSE x0 END AS x0, CASE WHEN ord % 5 = 0 THEN 0 ELSE y0 END AS y0, CASE WHEN ord % 5 = 0 THEN 900 ELSE x1 END AS x1, CASE WHEN ord % 5 = 0 THEN 900 ELSE y1 END AS y1 FROM pictures),
plain AS (SELECT * FROM big p WHERE x1 - x0 >= 24 AND y1 - y0 >= 24 AND NOT running AND NOT EXISTS (SELECT 1 FROM decor d WHERE d.doc_id = p.doc_id AND d.ref = p.ref AND d.x0 = (floor(p.x0 / 2.0 + 0.5) * 2)::BIGINT AND d.y0 = (floor(p.y0 / 2.0 + 0.5) * 2)::BIGINT AND d.x1 = (floor(p.x1 / 2.0 + 0.5) * 2)::BIGINT AND d.y1 = (floor(p.y1 / 2.0 + 0.5) * 2)::BIGINT))
SELECT doc_id, page_no, ord FROM plain p WHERE NOT ((x1 - x0) * (y1 - y0) * 2 >= 1000000 AND EXISTS (SELECT 1 FROM blocks t WHERE t.doc_id = p.doc_id AND t.page_no = p.page_no AND t.x0 < p.x1 AND p.x0 < t.x1 AND t.y0 < p.y1 AND p.y0 < t.y1 AND t.ord * 10 > p.z))""")
def shown_pictures(spark, sf_dir):
    docs = documents(spark, sf_dir)
    wide = lambda c, v: F.when(F.col("ord") % 5 == 0, v).otherwise(F.col(c)).cast("long")
    own = M.pictures(docs).withColumns({"x0": wide("x0", 0), "y0": wide("y0", 0), "x1": wide("x1", 900), "y1": wide("y1", 900)})
    texts = M.blocks(docs).withColumn("z", F.col("ord") * 10)
    return S.shown_pictures(own, _decoration(docs), texts).select("doc_id", "page_no", "ord")


@query(M.sql("pictures") + """, e AS (SELECT doc_id, ord AS entry, ord * 10 AS at FROM blocks WHERE ord % 2 = 0 AND ord > 2)
SELECT p.doc_id, p.ord AS fig, max(entry) AS after FROM pictures p LEFT JOIN e ON e.doc_id = p.doc_id AND e.at < p.z GROUP BY 1, 2""")
def figure_placement(spark, sf_dir):
    docs = documents(spark, sf_dir)
    entries = M.blocks(docs).where("ord % 2 = 0 and ord > 2").select("doc_id", F.col("ord").alias("entry"), (F.col("ord") * 10).alias("at"))
    return S.placed_figures(M.pictures(docs).select("doc_id", F.col("ord").alias("fig"), F.col("z").alias("at")), entries)


@query(M.sql() + """, r AS (SELECT doc_id, CASE WHEN h % 5 = 0 THEN ord + 5000 ELSE ord END AS ord, ['P', 'H', 'C'][(h % 3 + 1)::INT] AS label FROM blocks WHERE (doc_id + ord) % 4 < doc_id % 5),
k AS (SELECT doc_id, ord, min(label) AS label FROM r SEMI JOIN blocks USING (doc_id, ord) GROUP BY 1, 2), t AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY 1)
SELECT doc_id, ord, label FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS hit FROM k) JOIN t USING (doc_id) WHERE hit * 100 >= n * 50""")
def refine_grounding(spark, sf_dir):
    b = M.blocks(documents(spark, sf_dir))
    replies = b.where("(doc_id + ord) % 4 < doc_id % 5").select("doc_id", F.when(F.col("h") % 5 == 0, F.col("ord") + 5000).otherwise(F.col("ord")).alias("ord"), F.element_at(F.array(F.lit("P"), F.lit("H"), F.lit("C")), (F.col("h") % 3 + 1).cast("int")).alias("label"))
    return S.grounded(replies, b)


@query(M.sql() + """, p AS (SELECT doc_id, page_no, count(*) AS n FROM blocks GROUP BY 1, 2), w AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 4 OR sum(n) OVER (PARTITION BY doc_id) >= 80 THEN page_no ELSE 0 END AS win FROM p)
SELECT doc_id, win AS "window", min(page_no) AS first_page, max(page_no) AS last_page, sum(n)::BIGINT AS n_blocks FROM w GROUP BY 1, 2""")
def refine_windows(spark, sf_dir):
    return S.refine_windows(M.blocks(documents(spark, sf_dir)))


@query(M.sql("nodes") + """, i AS (SELECT doc_id, parent, node, h % 3 > 0 AS inline FROM nodes WHERE parent IS NOT NULL), f AS (SELECT *, sum(CASE WHEN inline THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, parent ORDER BY node)::BIGINT AS flow FROM i)
SELECT doc_id, parent, flow, min(node) AS first, count(*) AS n FROM f WHERE inline GROUP BY 1, 2, 3""")
def inline_flow(spark, sf_dir):
    own = M.nodes(documents(spark, sf_dir)).where("parent is not null").select("doc_id", "parent", "node", (F.col("h") % 3 > 0).alias("inline"))
    return S.inline_flow(own)


@query(M.sql() + """, n AS (SELECT doc_id, page_no, ord, ['t', 'v', 'i'][(h % 3 + 1)::INT] AS kind, CASE WHEN h % 4 = 0 THEN ['t', 'v', 'i'][(h % 3 + 1)::INT] || (ord * 2)::VARCHAR END AS id FROM blocks),
u AS (SELECT *, coalesce(max(TRY_CAST(regexp_extract(id, '^[a-z]([0-9]+)$', 1) AS BIGINT)) OVER (PARTITION BY doc_id, page_no, kind), 0) AS used, row_number() OVER (PARTITION BY doc_id, page_no, kind, id IS NULL ORDER BY ord) AS r FROM n)
SELECT doc_id, page_no, ord, coalesce(id, kind || (used + r)::VARCHAR) AS id FROM u""")
def id_stamping(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("t"), F.lit("v"), F.lit("i")), (F.col("h") % 3 + 1).cast("int"))
    own = M.blocks(documents(spark, sf_dir)).select("doc_id", "page_no", "ord", kind.alias("kind"), F.when(F.col("h") % 4 == 0, F.concat(kind, (F.col("ord") * 2).cast("string"))).alias("id"))
    return S.stamped(own).select("doc_id", "page_no", "ord", "id")


@query(M.sql() + """, p AS (SELECT *, lag(size) OVER o AS ps, lag(bold) OVER o AS pb, lag(angle) OVER o AS pa, lag(y1) OVER o AS py1, lag(x0) OVER o AS px0, lag(x1) OVER o AS px1 FROM blocks WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY ord)),
a AS (SELECT *, greatest(size, ps) * 10 < least(size, ps) * 12 AND bold = pb AND angle = pa AS alike FROM p WHERE ps IS NOT NULL OR TRUE),
f AS (SELECT *, coalesce((alike AND size * 10 >= 120 AND (y0 - py1) * 2 <= size * 3 AND x0 < px1 AND px0 < x1) OR (alike AND y0 - py1 <= size), FALSE) AND ps IS NOT NULL AS same FROM a)
SELECT doc_id, page_no, ord AS line, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY ord)::BIGINT AS block FROM f""")
def block_hard_breaks(spark, sf_dir):
    own = M.blocks(documents(spark, sf_dir)).select("doc_id", "page_no", F.col("ord").alias("line"), "size", "bold", F.col("angle").alias("axis"), "y0", "y1", "x0", "x1", F.lit(10).alias("body"))
    return S.hard_breaks(own)


def _dust(docs):
    """Blocks some of which have shrunk to two letters within another."""
    return M.blocks(docs).withColumns({"n_chars": F.when(F.col("h") % 6 == 1, F.col("h") % 3).otherwise(F.col("n_chars")), "x0": F.when(F.col("h") % 6 == 1, F.lit(200)).otherwise(F.col("x0")), "x1": F.when(F.col("h") % 6 == 1, F.lit(210)).otherwise(F.col("x1")), "y1": F.when(F.col("h") % 6 == 1, F.col("y0") + 10).otherwise(F.when(F.col("h") % 2 == 0, F.lit(960)).otherwise(F.col("y1")))})


@query(M.sql() + """, d AS (SELECT doc_id, ord, page_no, size, y0, CASE WHEN h % 6 = 1 THEN h % 3 ELSE n_chars END AS n_chars, CASE WHEN h % 6 = 1 THEN 200 ELSE x0 END AS x0, CASE WHEN h % 6 = 1 THEN 210 ELSE x1 END AS x1, CASE WHEN h % 6 = 1 THEN y0 + 10 WHEN h % 2 = 0 THEN 960 ELSE y1 END AS y1 FROM blocks),
p AS (SELECT t.doc_id, t.ord, h.ord AS host, row_number() OVER (PARTITION BY t.doc_id, t.ord ORDER BY (h.x1 - h.x0) * (h.y1 - h.y0), h.ord) AS r FROM d t JOIN d h USING (doc_id, page_no)
  WHERE t.n_chars BETWEEN 1 AND 2 AND h.n_chars > 2 AND t.x0 >= h.x0 - t.size * 0.5 AND t.x1 <= h.x1 + t.size * 0.5 AND t.y0 >= h.y0 - t.size * 0.5 AND t.y1 <= h.y1 + t.size * 0.5 AND t.size <= h.size * 1.05)
SELECT doc_id, ord, host FROM p WHERE r = 1""")
def dust_absorption(spark, sf_dir):
    return S.dust_hosts(_dust(documents(spark, sf_dir)))


@query(M.sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + """, walk AS (SELECT doc_id, node, 0::BIGINT AS depth, node::VARCHAR AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, w.depth + 1, w.path || '/' || n.node::VARCHAR FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.parent = w.node)
SELECT * FROM walk""")
def tree_walk(spark, sf_dir):
    return S.tree_paths(spark, M.nodes(documents(spark, sf_dir)))
