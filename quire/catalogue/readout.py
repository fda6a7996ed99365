"""Queries of text assembly and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalogue.surgery import inked
from quire.functions import text as T
from quire.operators import assembly as A
from quire.operators import redaction as R
from quire.operators import sinks as K
from quire.operators import spans as P
from quire.operators import tables as B
from quire.operators import trees as E
from quire.plans import model as M
from quire.registry import documents, query

_WORD = "[\\p{L}\\p{Nd}]"


def broken_runs(docs):
    """Runs numbered through a document; some end on a hyphen within a word, and the next goes on with its rest."""
    n = F.col("n")
    rows = M.numbered_runs(docs).select("doc_id", "text", "size", "y0", "x0", (n * 2).cast("long").alias("n"), *(F.when(n % 3 == 0, F.regexp_extract("text", f"^(.*{_WORD}{{3}})({_WORD}{{3}}.*)$", i)).alias(c) for i, c in ((1, "head"), (2, "rest"))))
    split = (F.col("n") % 6 == 0) & (F.col("head") != "")
    # capitals of ß differ between engines
    loose = (F.col("n") % 24 == 6) & ~F.contains("rest", F.lit("ß"))
    tail = F.when(loose, F.initcap("rest")).otherwise(F.col("rest"))
    parts = F.when(split, F.array(F.struct(F.col("n").alias("run"), F.concat("head", F.lit("-")).alias("text"), F.lit(0).alias("step")), F.struct((F.col("n") + 1).alias("run"), tail.alias("text"), F.lit(1).alias("step")))).otherwise(F.array(F.struct(F.col("n").alias("run"), F.col("text"), F.lit(0).alias("step"))))
    return rows.select("doc_id", "size", "n", F.explode(parts).alias("p"), "x0").select("doc_id", "p.run", "p.text", (F.col("n") * 2 + F.when(F.col("n") % 12 == 0, 0).otherwise(20) * F.col("p.step")).alias("y"), "size", "x0")


_BROKEN = f"""
n0 AS (SELECT doc_id, text, size, x0, row_number() OVER (PARTITION BY doc_id ORDER BY ord, run) * 2 AS n FROM runs),
n1 AS (SELECT *, regexp_extract(text, '^(.*{_WORD}{{3}})({_WORD}{{3}}.*)$', 1) AS head, regexp_extract(text, '^(.*{_WORD}{{3}})({_WORD}{{3}}.*)$', 2) AS rest FROM n0),
broken AS (SELECT doc_id, n AS run, CASE WHEN n % 6 = 0 AND head <> '' THEN head || '-' ELSE text END AS text, n * 2 AS y, size, x0 FROM n1
  UNION ALL SELECT doc_id, n + 1, CASE WHEN n % 24 = 6 AND NOT contains(rest, 'ß') THEN array_to_string(list_transform(string_split(rest, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE rest END, n * 2 + CASE WHEN n % 12 = 0 THEN 0 ELSE 20 END, size, x0 FROM n1 WHERE n % 6 = 0 AND head <> ''),
vocab AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}[\\p{{L}}\\p{{Nd}}-]*')) AS word FROM broken) WHERE NOT ends_with(word, '-'))"""


@query(M.sql("runs") + "," + _BROKEN + f""",
l AS (SELECT *, ltrim(lead(text) OVER o) AS nxt, lead(y) OVER o - y AS fall, greatest(size, lead(size) OVER o) AS em FROM broken WINDOW o AS (PARTITION BY doc_id ORDER BY run)),
s AS (SELECT doc_id, run, regexp_extract(text, '({_WORD}+)-$', 1) AS a, regexp_extract(nxt, '^({_WORD}+)', 1) AS b FROM l WHERE fall > 0.5 * em),
t AS (SELECT s.*, c.word IS NOT NULL AS hc, w.word IS NOT NULL AS hw FROM s LEFT JOIN vocab c ON c.doc_id = s.doc_id AND c.word = lower(a || '-' || b) LEFT JOIN vocab w ON w.doc_id = s.doc_id AND w.word = lower(a || b) WHERE a <> '' AND b <> ''),
k AS (SELECT *, CASE WHEN hc <> hw THEN hc ELSE NOT regexp_matches(b, '^\\p{{Ll}}') END AS kept FROM t)
SELECT doc_id, run, a || CASE WHEN kept THEN '-' ELSE '' END || b AS word, kept FROM k""")
def hyphen_join(spark, sf_dir):
    return A.joined_hyphens(broken_runs(documents(spark, sf_dir)))


@query(M.sql("runs") + """, n0 AS (SELECT doc_id, text, x0, row_number() OVER (PARTITION BY doc_id ORDER BY ord, run) AS run FROM runs),
l AS (SELECT *, lag(text) OVER o AS pt, lag(x0) OVER o AS px FROM n0 WINDOW o AS (PARTITION BY doc_id ORDER BY run))
SELECT doc_id, run, CASE WHEN coalesce(NOT ends_with(pt, '-') AND x0 <= px + 0.01 AND text <> '' AND pt <> '', FALSE) THEN ' ' ELSE '' END || text AS text FROM l""")
def line_back_space(spark, sf_dir):
    return A.spaced(M.numbered_runs(documents(spark, sf_dir)).select("doc_id", "text", "x0", F.col("n").cast("long").alias("run")))


_INLINE = "h % 3 = 1 AND parent IS NOT NULL"


@query(M.sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + f""", i AS (SELECT *, {_INLINE} AS inline FROM nodes),
o AS (SELECT doc_id, node, ref_page, ref, node AS owner, inline, parent FROM i UNION ALL SELECT o.doc_id, o.node, o.ref_page, o.ref, i.node, i.inline, i.parent FROM o JOIN i ON i.doc_id = o.doc_id AND i.node = o.parent WHERE o.inline)
SELECT o.doc_id, owner AS node, trim(regexp_replace(string_agg(b.text, ' ' ORDER BY ref_page, ref), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM o JOIN blocks b ON b.doc_id = o.doc_id AND b.page_no = o.ref_page AND b.ord = o.ref WHERE NOT o.inline GROUP BY 1, 2""")
def node_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = M.nodes(docs).withColumn("inline", F.expr(_INLINE))
    return E.node_texts(E.numbered(own), own, M.blocks(docs))


@query(M.sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT doc_id, node, node AS top, length(text) AS n FROM nodes UNION ALL SELECT u.doc_id, u.node, n.parent, u.n FROM u JOIN nodes n ON n.doc_id = u.doc_id AND n.node = u.top WHERE n.parent IS NOT NULL)
SELECT doc_id, top AS node, sum(n)::BIGINT AS total FROM u GROUP BY 1, 2""")
def subtree_letters(spark, sf_dir):
    own = M.nodes(documents(spark, sf_dir)).withColumn("n", F.length("text"))
    return E.subtree_sums(E.numbered(own), own, "n")


@query(M.sql() + """, u AS (SELECT doc_id, ord, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM blocks WHERE h % 23 <> 0 AND text <> '')
SELECT doc_id, before // 400 AS utterance, min(before) AS start, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY 1, 2""")
def read_aloud(spark, sf_dir):
    return A.utterances(M.blocks(documents(spark, sf_dir)).withColumn("running", F.col("h") % 23 == 0))


_PATTERNS = {"numbers": "[0-9]+", "mails": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "capitals": "[A-Z][a-z]+"}


@query(M.sql() + " SELECT doc_id, page_no, " + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {n}" for n, p in _PATTERNS.items()) + " FROM blocks GROUP BY 1, 2")
def regex_match_counts(spark, sf_dir):
    return A.pattern_counts(M.blocks(documents(spark, sf_dir)), _PATTERNS)


#: Names: capitalised words one after another, over runs and lines.
_NAMES = "[A-Z][a-z]+([ \\n][A-Z][a-z]+)*"


@query(M.sql("lettered") + f""", p0 AS (SELECT *, CASE WHEN line <> lag(line) OVER o THEN chr(10) ELSE '' END || text AS piece FROM lettered WINDOW o AS (PARTITION BY doc_id, ord ORDER BY run)),
p AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY doc_id, ord ORDER BY run) - length(text))::BIGINT AS start FROM p0),
u AS (SELECT doc_id, ord, string_agg(piece, '' ORDER BY run) AS t FROM p GROUP BY 1, 2),
s AS (SELECT doc_id, ord, unnest(range(len(said))) AS match, unnest(said) AS said, unnest(gaps[: len(said)]) AS gap FROM (SELECT doc_id, ord, regexp_extract_all(t, '{_NAMES}') AS said, regexp_split_to_array(t, '{_NAMES}') AS gaps FROM u)),
m AS (SELECT doc_id, ord, match, said, e - length(said) AS ms, e AS me FROM (SELECT *, sum(length(gap) + length(said)) OVER (PARTITION BY doc_id, ord ORDER BY match)::BIGINT AS e FROM s)),
j AS (SELECT p.*, match, said, greatest(ms, start) - start AS a, least(me, start + length(text)) - start AS b FROM p JOIN m ON m.doc_id = p.doc_id AND m.ord = p.ord AND ms < start + length(text) AND start < me),
k AS (SELECT *, b + length(regexp_extract(substr(text, b + 1), '^[ \\t\\n\\x0B\\f\\r]*', 0)) AS ink FROM j)
SELECT doc_id, page_no, ord, run, match::BIGINT AS match, said, (x0 + 6 * a)::DOUBLE AS x0, y0::DOUBLE AS y0, (CASE WHEN ink < length(text) THEN x0 + 6 * ink ELSE x0 + 6 * (b - 1) + 0.6 * size END)::DOUBLE AS x1, (y0 + 1.1 * size)::DOUBLE AS y1 FROM k""")
def regex_zones(spark, sf_dir):
    return P.pattern_zones(M.spaced_runs(documents(spark, sf_dir)), _NAMES, M.letter_places())


typed = M.typed


_MARK = f"^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+"
_TYPED = f"""
typed AS (SELECT *, CASE WHEN size >= 14 THEN 'HEADING' WHEN h % 8 = 1 THEN 'FIGURE' WHEN h % 12 = 7 THEN 'TABLE' WHEN regexp_matches(text, '{_MARK}.') OR h % 10 = 2 THEN 'ITEM' WHEN h % 9 = 4 THEN 'QUOTE' WHEN h % 14 = 5 THEN 'CODE' WHEN h % 11 = 3 THEN 'CAPTION' ELSE 'PARAGRAPH' END AS type,
  CASE WHEN size = 20 THEN 1 WHEN size = 18 THEN 2 ELSE 3 END AS level FROM blocks)"""
_LOC = " || ".join(f"'<loc_' || least(500, greatest(0, floor({c} * 500.0 / 1000 + 0.5)))::BIGINT || '>'" for c in ("x0", "y0", "x1", "y1"))
_ESC = "replace(replace(replace(regexp_replace({}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


cells = M.cells


#: The cells for DuckDB, placed one after the other by a walk that holds what spans have taken.
_CELLS = f"""
cells AS MATERIALIZED (SELECT r.doc_id, r.ord AS tbl, run // 4 AS r, run AS col, CASE WHEN (r.ord * 3 + run) % 6 = 0 THEN '' ELSE r.text END AS text, CASE WHEN run = 0 THEN 'both' WHEN run < 4 THEN 'column' WHEN run % 4 = 0 THEN 'row' ELSE '' END AS head,
  CASE WHEN (r.ord * 3 + run) % 7 = 5 THEN 2 ELSE 1 END AS cs, CASE WHEN (r.ord * 3 + run) % 5 = 2 THEN 2 + (r.ord * 3 + run) % 2 ELSE 1 END AS rs FROM runs r JOIN typed t USING (doc_id, ord) WHERE type = 'TABLE'),
size AS MATERIALIZED (SELECT doc_id, tbl, max(r) + 1 AS h, max(n)::BIGINT AS w FROM (SELECT doc_id, tbl, r, sum(cs) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
walk AS (SELECT c.doc_id, c.tbl, 0::BIGINT AS col, r, 0::BIGINT AS place, cs AS next, CASE WHEN rs > 1 THEN [[r + rs - 1, 0, cs - 1]] ELSE [] END AS busy FROM cells c WHERE col = 0
  UNION ALL SELECT doc_id, tbl, col, r, place, coalesce(place + cs, w), CASE WHEN rs > 1 AND place IS NOT NULL THEN list_append(busy, [r + rs - 1, place, place + cs - 1]) ELSE busy END
  FROM (SELECT *, list_filter(range(low, w), lambda x: len(list_filter(busy, lambda b: b[1] >= r AND b[2] <= x AND x <= b[3])) = 0)[1] AS place
    FROM (SELECT c.doc_id, c.tbl, c.col, c.r, c.cs, c.rs, s.w, CASE WHEN c.r = p.r THEN p.next ELSE 0 END AS low, list_filter(p.busy, lambda b: b[1] >= c.r) AS busy
      FROM walk p JOIN cells c ON c.doc_id = p.doc_id AND c.tbl = p.tbl AND c.col = p.col + 1 JOIN size s ON s.doc_id = p.doc_id AND s.tbl = p.tbl))),
spots AS (SELECT w.doc_id, w.tbl, w.col, w.r + j AS r, place + k AS c, CASE WHEN j > 0 AND k > 0 THEN '<xcel>' WHEN j > 0 THEN '<ucel>' WHEN k > 0 THEN '<lcel>' WHEN trim(text) = '' THEN '<ecel>' ELSE CASE head WHEN 'column' THEN '<ched>' WHEN 'both' THEN '<ched>' WHEN 'row' THEN '<rhed>' ELSE '<fcel>' END || trim(replace(replace(text, '<', '‹'), '>', '›')) END AS token
  FROM walk w JOIN cells x USING (doc_id, tbl, col) JOIN size s USING (doc_id, tbl), range(3) a(j), range(2) b(k) WHERE place IS NOT NULL AND j < rs AND k < cs AND w.r + j < h AND place + k < s.w),
grid AS (SELECT s.doc_id, s.tbl, y AS r, x AS c, coalesce(max_by(token, col), '<ecel>') AS token FROM (SELECT doc_id, tbl, y, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM size)) s LEFT JOIN spots p ON p.doc_id = s.doc_id AND p.tbl = s.tbl AND p.r = y AND p.c = x GROUP BY 1, 2, 3, 4),
tokens AS (SELECT doc_id, tbl, string_agg(line || '<nl>' || chr(10), '' ORDER BY r) AS otsl FROM (SELECT doc_id, tbl, r, string_agg(token, '' ORDER BY c) AS line FROM grid GROUP BY 1, 2, 3) GROUP BY 1, 2),
piped AS (SELECT c.doc_id, c.tbl, r, '| ' || string_agg(trim(replace(replace(text, chr(10), ' '), '|', '\\|')) || repeat(' | ', cs - 1), ' | ' ORDER BY col) || repeat(' | ', w - sum(cs)::BIGINT) || ' |' || CASE WHEN r = 0 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END AS line FROM cells c JOIN size s USING (doc_id, tbl) GROUP BY 1, 2, 3, w),
marked AS (SELECT doc_id, tbl, r, string_agg('<' || CASE WHEN head = '' THEN 'td' ELSE 'th' END || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || CASE WHEN rs > 1 THEN ' rowspan="' || rs || '"' ELSE '' END || CASE head WHEN 'column' THEN ' scope="col"' WHEN 'row' THEN ' scope="row"' ELSE '' END
  || '>' || {_ESC.format('text')} || '</' || CASE WHEN head = '' THEN 'td' ELSE 'th' END || '>' || chr(10), '' ORDER BY col) AS line FROM cells GROUP BY 1, 2, 3),
tables AS MATERIALIZED (SELECT * FROM tokens JOIN (SELECT doc_id, tbl, string_agg(line, chr(10) ORDER BY r) AS markdown FROM piped GROUP BY 1, 2) USING (doc_id, tbl)
  JOIN (SELECT doc_id, tbl, '<table>' || chr(10) || string_agg('<tr>' || chr(10) || line || '</tr>' || chr(10), '' ORDER BY r) || '</table>' || chr(10) AS html FROM marked GROUP BY 1, 2) USING (doc_id, tbl))"""
_TABLES = M.sql("runs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _TYPED + "," + _CELLS


@query(_TABLES + " SELECT * FROM tables")
def table_tokens(spark, sf_dir):
    return B.written_out(cells(documents(spark, sf_dir)))


def with_tables(docs):
    return K.with_tables(typed(docs), B.written_out(cells(docs)))


@query(_TABLES + f""", p AS (SELECT doc_id, ord, coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY ord), '') AS pt, coalesce(lead(type) OVER (PARTITION BY doc_id ORDER BY ord), '') AS nt, CASE WHEN lag(page_no) OVER (PARTITION BY doc_id ORDER BY ord) <> page_no THEN '<page_break>' || chr(10) ELSE '' END AS turn, {_LOC} AS loc, type,
  CASE type WHEN 'HEADING' THEN 'section_header_level_' || level WHEN 'ITEM' THEN 'list_item' WHEN 'FIGURE' THEN 'picture' ELSE 'text' END AS tag, trim(replace(replace(text, '<', '‹'), '>', '›')) AS said FROM typed)
SELECT p.doc_id, '<doctag>' || chr(10) || string_agg(CASE WHEN type = 'TABLE' THEN turn || '<otsl>' || loc || chr(10) || coalesce(otsl, '') || CASE WHEN nt = 'CAPTION' THEN '' ELSE '</otsl>' || chr(10) END
  WHEN type = 'CAPTION' AND pt = 'TABLE' THEN '<caption>' || loc || said || '</caption>' || chr(10) || '</otsl>' || chr(10) ELSE turn || '<' || tag || '>' || loc || CASE type WHEN 'FIGURE' THEN '' WHEN 'ITEM' THEN trim(regexp_replace(said, '{_MARK}', '')) ELSE said END || '</' || tag || '>' || chr(10) END, '' ORDER BY ord) || '</doctag>' || chr(10) AS doctags FROM p LEFT JOIN tables t ON t.doc_id = p.doc_id AND t.tbl = p.ord GROUP BY 1""")
def doctags_loc(spark, sf_dir):
    return K.doctags(with_tables(documents(spark, sf_dir)))


@query(_TABLES + f""", p AS (SELECT doc_id, ord, text, type, level, coalesce(lag(type) OVER o, '') AS pt, coalesce(lead(type) OVER o, '') AS nt FROM typed WINDOW o AS (PARTITION BY doc_id ORDER BY ord))
SELECT p.doc_id, string_agg(CASE type WHEN 'TABLE' THEN coalesce(t.html, '<table>' || chr(10) || '</table>' || chr(10)) WHEN 'HEADING' THEN '<h' || level || '>' || {_ESC.format('text')} || '</h' || level || '>' || chr(10)
  WHEN 'ITEM' THEN CASE WHEN pt <> 'ITEM' THEN '<ul>' || chr(10) ELSE '' END || '<li>' || {_ESC.format(f"trim(regexp_replace(text, '{_MARK}', ''))")} || '</li>' || chr(10) || CASE WHEN nt <> 'ITEM' THEN '</ul>' || chr(10) ELSE '' END
  WHEN 'FIGURE' THEN '<figure></figure>' || chr(10) WHEN 'QUOTE' THEN '<blockquote>' || {_ESC.format('text')} || '</blockquote>' || chr(10) WHEN 'CODE' THEN '<pre><code>' || {_ESC.format('text')} || '</code></pre>' || chr(10)
  ELSE '<p>' || {_ESC.format('text')} || '</p>' || chr(10) END, '' ORDER BY ord) AS html FROM p LEFT JOIN tables t ON t.doc_id = p.doc_id AND t.tbl = p.ord GROUP BY 1""")
def html_sink(spark, sf_dir):
    return K.html(with_tables(documents(spark, sf_dir)))


@query(_TABLES + f""", p AS (SELECT y.doc_id, ord, CASE WHEN type = 'FIGURE' THEN '<!-- image -->' WHEN type = 'TABLE' THEN t.markdown WHEN text = '' THEN NULL WHEN type = 'HEADING' THEN repeat('#', level) || ' ' || text WHEN type = 'QUOTE' THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN type = 'CAPTION' THEN '*' || text || '*'
  WHEN type = 'CODE' THEN '```' || chr(10) || text || chr(10) || '```' WHEN type = 'ITEM' THEN '- ' || trim(regexp_replace(text, '{_MARK}', '')) ELSE text END AS part FROM typed y LEFT JOIN tables t ON t.doc_id = y.doc_id AND t.tbl = y.ord)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS markdown FROM p WHERE part IS NOT NULL GROUP BY 1""")
def markdown_typed(spark, sf_dir):
    return K.markdown(with_tables(documents(spark, sf_dir)))


@query(M.sql() + "," + _TYPED + " SELECT doc_id, page_no, '{\"blocks\":[' || string_agg('{\"ord\":' || ord || ',\"type\":\"' || type || '\",\"x0\":' || x0 || '.0,\"y0\":' || y0 || '.0,\"x1\":' || x1 || '.0,\"y1\":' || y1 || '.0}', ',' ORDER BY ord) || ']}' AS json FROM typed GROUP BY 1, 2")
def stages_json(spark, sf_dir):
    return K.page_json(typed(documents(spark, sf_dir)))


_AUDIT = f"""
inked AS (SELECT r.*, b.ink, r.ord * 10 AS z FROM runs r JOIN blocks b USING (doc_id, ord)),
found AS (SELECT r.doc_id, r.page_no, r.ord, r.run, f.ord AS box, 'under' AS kind FROM inked r JOIN fills f USING (doc_id, page_no)
  WHERE f.fill = 'cover' AND r.z < f.z AND r.x0 + r.size * 0.25 >= f.x0 AND r.x0 + r.size * 0.25 <= f.x1 AND r.y0 + r.size * 0.35 >= f.y0 AND r.y0 + r.size * 0.35 <= f.y1)"""


@query(M.sql("runs", "fills") + "," + _AUDIT + " SELECT doc_id, '{\"findings\":[' || string_agg('{\"page_no\":' || page_no || ',\"ord\":' || ord || ',\"run\":' || run || ',\"box\":' || box || ',\"kind\":\"' || kind || '\"}', ',' ORDER BY page_no, ord, run, box) || ']}' AS json FROM found GROUP BY 1")
def audit_json(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return K.findings_json(R.text_findings(inked(docs), M.fills(docs).where("fill = 'cover'")).where("kind = 'under'"))


def units(docs):
    """Blocks as units of a book: headings weigh nothing, figures as much as a chapter."""
    return typed(docs).select("doc_id", "ord", F.when(F.col("type") == "HEADING", F.col("level")).alias("level"), F.when(F.col("type") == "HEADING", 0).when(F.col("type") == "FIGURE", K.MIN_CHAPTER).otherwise(F.col("n_chars")).cast("long").alias("weight"))


@query()
def chapter_split(spark, sf_dir):
    return K.chapters(units(documents(spark, sf_dir)))
