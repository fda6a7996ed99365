"""Registry of the document queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.words import LEAD, MIN_LETTERS, MIN_SHARE, MIN_TOKENS, SAMPLE_CHARS, STOPWORDS
from quire.operators import language, layout, readout
from quire.plans import bridge
from quire.registry import ORACLE_SQL, QUERIES, documents, query  # noqa: F401

WITH_LINES = "WITH " + bridge.LINES_SQL.strip()
_WS = "[ \\t\\n\\x0B\\f\\r]"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.lines(documents(spark, sf_dir))


# ---------------------------------------------------------------- language

_STOP = ", ".join(f"('{lang}', '{w}')" for lang, ws in STOPWORDS.items() for w in ws.split())


@query(f"""
WITH s AS (SELECT doc_id, substring(text, 1, {SAMPLE_CHARS}) AS t FROM documents),
stop(guess, token) AS (VALUES {_STOP}),
tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '')) AS token FROM s),
total AS (SELECT doc_id, count(*) AS total FROM tokens GROUP BY 1),
votes AS (SELECT doc_id, guess, count(*) AS n FROM tokens JOIN stop USING (token) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, guess DESC) AS r FROM votes),
best AS (SELECT doc_id, max(guess) FILTER (r = 1) AS guess, max(n) FILTER (r = 1) AS n1, coalesce(max(n) FILTER (r = 2), 0) AS n2 FROM ranked GROUP BY 1),
letters AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '\\p{{Latin}}')) AS latin FROM s)
SELECT s.doc_id, CASE WHEN letters < {MIN_LETTERS} THEN '' WHEN letters - latin > latin THEN '?' WHEN coalesce(total, 0) < {MIN_TOKENS} THEN ''
  WHEN n1 IS NULL OR n1 < {MIN_SHARE} * total THEN '' WHEN n2 > 0 AND n1 < {LEAD} * n2 THEN '' ELSE guess END AS guessed
FROM s LEFT JOIN total USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN letters USING (doc_id)""")
def lang_guess(spark, sf_dir):
    return language.guess(documents(spark, sf_dir))


@query(f"""
SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}'))::BIGINT AS letters, len(regexp_extract_all(t, '\\p{{Latin}}'))::BIGINT AS latin,
  len(regexp_extract_all(t, '\\p{{Cyrillic}}'))::BIGINT AS cyrillic, len(regexp_extract_all(t, '\\p{{Han}}'))::BIGINT AS han
FROM (SELECT doc_id, text AS t FROM documents)""")
def lang_script_counts(spark, sf_dir):
    return language.script_counts(documents(spark, sf_dir)).select("doc_id", "letters", "latin", "cyrillic", "han")


# ---------------------------------------------------------------- scalar functions


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS collapsed FROM documents")
def collapse_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.collapse(F.col("text")).alias("collapsed"))


@query("""WITH e AS (SELECT page_id, url, replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages)
SELECT page_id, escaped, replace(escaped, '"', '&quot;') AS attribute FROM e""")
def escape_markup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.escape_xml(F.col("html")).alias("escaped"), T.escape_attribute(F.col("html")).alias("attribute"))


@query(WITH_LINES + f"""
SELECT doc_id, line_no, trim(regexp_replace(line, '^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+', '')) AS item
FROM lines WHERE regexp_matches(line, '^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+.')""")
def list_marker_lines(spark, sf_dir):
    return lines(spark, sf_dir).where(T.is_list_item(F.col("line"))).select("doc_id", "line_no", T.strip_marker(F.col("line")).alias("item"))


@query(WITH_LINES + f"""
SELECT doc_id, line_no, len(regexp_extract_all(line, '\\p{{L}}')) >= 3 AND len(regexp_extract_all(line, '\\p{{Lu}}')) * 10 >= len(regexp_extract_all(line, '\\p{{L}}')) * 8 AS caps,
  (CASE WHEN len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]')) = 0 THEN 0 ELSE floor(100.0 * len(regexp_extract_all(line, '[0-9]')) / len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]')) + 0.5) END)::BIGINT AS digit_pct,
  regexp_matches(line, '[.!?…]{_WS}*$') AS ends_sentence, regexp_matches(line, '\\p{{L}}{{2,}}') AS has_word, length(trim(line))::BIGINT AS stripped
FROM lines""")
def line_signals(spark, sf_dir):
    c = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "line_no", T.is_caps(c).alias("caps"), T.digit_percent(c).alias("digit_pct"), T.ends_sentence(c).alias("ends_sentence"), T.has_word(c).alias("has_word"), F.length(F.trim(c)).cast("long").alias("stripped"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slug_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN '0' ELSE
  CASE WHEN regexp_replace(regexp_replace(printf('%.4f', value), '0+$', ''), '\\.$', '') IN ('-0', '') THEN '0' ELSE regexp_replace(regexp_replace(printf('%.4f', value), '0+$', ''), '\\.$', '') END END AS shown,
  floor(value * 2 + 0.5) / 2 AS half_points FROM events""")
def number_format(spark, sf_dir):
    v = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.four_decimals(v).alias("shown"), T.half_points(v).alias("half_points"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_id FROM documents")
def content_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))


@query("""
WITH c AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS argb FROM events)
SELECT event_id, ((argb >> 24) & 255)::BIGINT AS alpha, ((argb >> 16) & 255)::BIGINT AS red, ((argb >> 8) & 255)::BIGINT AS green, (argb & 255)::BIGINT AS blue FROM c""")
def colour_channels(spark, sf_dir):
    argb = (F.col("event_id") * 2654435761) % 4294967296
    part = lambda n: F.shiftrightunsigned(argb, n).bitwiseAND(255).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", part(24).alias("alpha"), part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"))


# ---------------------------------------------------------------- layout


@query(WITH_LINES + "SELECT doc_id, line_no, 72.0::DOUBLE AS x0, 72 + 5.0::DOUBLE * length(line) + 0.5::DOUBLE * size AS x1, y - 0.2::DOUBLE * size AS y0, y + 0.8::DOUBLE * size AS y1 FROM lines")
def line_bounds(spark, sf_dir):
    return layout.line_bounds(lines(spark, sf_dir)).select("doc_id", "line_no", "x0", "x1", "y0", "y1")


@query(WITH_LINES + "SELECT doc_id, page_no, 72.0::DOUBLE AS x0, min(y - 0.2::DOUBLE * size) AS y0, max(72 + 5.0::DOUBLE * length(line) + 0.5::DOUBLE * size) AS x1, max(y + 0.8::DOUBLE * size) AS y1 FROM lines WHERE line <> '' GROUP BY 1, 2")
def page_union_box(spark, sf_dir):
    return layout.page_boxes(lines(spark, sf_dir))


_GRID = """, grid AS (SELECT doc_id, line_no, page_no, para_no,
  least(1000, greatest(0, floor(72.0::DOUBLE / 612 * 1000 + 0.5)))::BIGINT AS gx0,
  least(1000, greatest(0, floor((842 - (y + 0.8::DOUBLE * size)) / 842 * 1000 + 0.5)))::BIGINT AS gy0,
  least(1000, greatest(0, floor((72 + 5.0::DOUBLE * length(line) + 0.5::DOUBLE * size) / 612 * 1000 + 0.5)))::BIGINT AS gx1,
  least(1000, greatest(0, floor((842 - (y - 0.2::DOUBLE * size)) / 842 * 1000 + 0.5)))::BIGINT AS gy1 FROM lines)
"""


@query(WITH_LINES + _GRID + "SELECT doc_id, line_no, gx0, gy0, gx1, gy1 FROM grid")
def grid_box(spark, sf_dir):
    return layout.grid_boxes(lines(spark, sf_dir))


@query(WITH_LINES + """, s AS (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS style, sum(length(line))::BIGINT AS ink, count(*)::BIGINT AS n_lines, count(DISTINCT page_no)::BIGINT AS n_pages FROM lines GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ink DESC, style DESC) = 1 AS is_body FROM s""")
def font_profile(spark, sf_dir):
    return layout.font_profile(lines(spark, sf_dir))


@query(WITH_LINES + """, s AS (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS style, sum(length(line)) AS ink FROM lines GROUP BY 1, 2),
b AS (SELECT doc_id, style AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ink DESC, style DESC) AS r FROM s) WHERE r = 1)
SELECT doc_id, line_no, line AS title FROM lines JOIN b USING (doc_id) WHERE size >= 1.08::DOUBLE * body AND regexp_matches(line, '\\p{L}{2,}') AND length(line) <= 160""")
def heading_candidates(spark, sf_dir):
    return layout.heading_candidates(lines(spark, sf_dir))


def _headings(spark, sf_dir):
    return lines(spark, sf_dir).where("part = 0").select("doc_id", F.col("para_no").alias("ord"), (F.col("n_words") % 6 + 1).alias("level"))


@query(WITH_LINES + """, h AS (SELECT doc_id, para_no AS ord, n_words % 6 + 1 AS level FROM lines WHERE part = 0)
SELECT a.doc_id, a.ord, a.level, max(b.ord) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY 1, 2, 3""")
def heading_tree_parent(spark, sf_dir):
    return layout.heading_parents(_headings(spark, sf_dir))


@query(WITH_LINES + """, b AS (SELECT DISTINCT doc_id, n_words * 7 AS size_pct FROM lines), r AS (SELECT *, (floor(size_pct / 5 + 0.5) * 5)::BIGINT AS bucket FROM b)
SELECT *, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY bucket DESC), 6)::BIGINT AS level FROM r""")
def level_reconcile(spark, sf_dir):
    return layout.level_reconcile(lines(spark, sf_dir).select("doc_id", (F.col("n_words") * 7).alias("size_pct")).distinct())


def with_heads(spark, sf_dir):
    """Pages with a head line and a folio over their own lines."""
    own = lines(spark, sf_dir)
    row = lambda slot, line, size, y: F.struct(slot.cast("long").alias("slot"), line.alias("line"), size.alias("size"), y.alias("y"))
    made = lambda slot, line: row(F.lit(slot), line, F.lit(10.0), F.lit(798.0 - 14 * slot))
    head = made(0, F.concat(F.lit("From "), F.coalesce("source", F.lit("?"))))
    folio = made(1, F.concat(F.lit("Page "), (F.col("page_no") + 1).cast("string")))
    body = row(F.col("slot") + 2, F.col("line"), F.col("size"), F.col("y"))
    rows = own.select("doc_id", "page_no", F.explode(F.when(F.col("slot") == 0, F.array(head, folio, body)).otherwise(F.array(body))).alias("l"))
    return rows.select("doc_id", "page_no", "l.*")


#: DuckDB's levenshtein counts bytes.  Keys are lower case, so the letters beyond ASCII that the tables hold change places
#: with capitals there, one for one, and bytes are characters.
_BEYOND, _CAPITALS = "éèçêäüößóñí", "ABCDEFGHIJK"


def _edge(depth: str, name: str) -> str:
    """Strength of lines that are `depth` lines from their edge, from scores of pages one and two apart."""
    return f"""
{name}0 AS (SELECT a.doc_id, a.{depth}, a.page_no AS p, b.page_no AS q, b.page_no - a.page_no AS gap, a.key AS k, b.key AS o,
  list_transform(list_zip(regexp_extract_all(a.key, '[0-9]+'), regexp_extract_all(b.key, '[0-9]+')), lambda x: try_cast(x[2] AS BIGINT) - try_cast(x[1] AS BIGINT)) AS st
  FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.{depth} = b.{depth} AND b.page_no - a.page_no IN (1, 2)),
{name}1 AS (SELECT doc_id, {depth}, p, q, gap, CASE WHEN regexp_replace(k, '[0-9]+', '#', 'g') = regexp_replace(o, '[0-9]+', '#', 'g') AND len(list_filter(st, lambda s: s = gap)) = 1 AND len(list_filter(st, lambda s: s = 0)) = len(st) - 1 THEN 1.0
  ELSE 1.0::DOUBLE - levenshtein(translate(k, '{_BEYOND}', '{_CAPITALS}'), translate(o, '{_BEYOND}', '{_CAPITALS}'))::DOUBLE / greatest(length(k), length(o)) END::DOUBLE AS score FROM {name}0),
{name}2 AS (SELECT doc_id, {depth}, page_no, sum(score) FILTER (gap = 1) AS s1, sum(score) FILTER (gap = 2) AS s2 FROM (SELECT doc_id, {depth}, p AS page_no, gap, score FROM {name}1 UNION ALL SELECT doc_id, {depth}, q, gap, score FROM {name}1) GROUP BY 1, 2, 3),
{name} AS (SELECT r.*, round(greatest(coalesce(s1, 0) / greatest(1, (r.page_no >= 1)::INT + (r.page_no + 1 < n_pages)::INT), coalesce(s2, 0) / greatest(1, (r.page_no >= 2)::INT + (r.page_no + 2 < n_pages)::INT)), 6)::DOUBLE AS strength
  FROM ranked r LEFT JOIN {name}2 USING (doc_id, {depth}, page_no))"""


_FURNITURE = f""",
heads AS (SELECT doc_id, page_no, 0 AS slot, 'From ' || coalesce(source, '?') AS line, 10.0 AS size, 798.0 AS y FROM lines WHERE slot = 0 UNION ALL SELECT doc_id, page_no, 1, 'Page ' || (page_no + 1), 10.0, 784.0 FROM lines WHERE slot = 0
  UNION ALL SELECT doc_id, page_no, slot + 2, line, size, y FROM lines),
keyed AS (SELECT *, lower(trim(regexp_replace(line, '{_WS}+', ' ', 'g'))) AS key FROM heads),
held AS (SELECT doc_id, max(page_no) + 1 AS n_pages, (list_sort(list(size) FILTER (key <> '')))[len(list(size) FILTER (key <> '')) // 2 + 1] AS body FROM keyed GROUP BY 1 HAVING max(page_no) + 1 >= 3),
ranked AS (SELECT k.*, n_pages, body, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY slot) AS top, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY slot DESC) AS foot FROM keyed k JOIN held USING (doc_id) WHERE key <> ''),
""" + _edge("top", "up") + "," + _edge("foot", "down") + """,
good AS (SELECT u.doc_id, u.page_no, u.slot, u.strength, d.strength AS foot_strength, (u.size <= 1.25 * u.body) AS fits,
  coalesce(abs(lag(u.y) OVER a - u.y) <= 2 * lag(u.size) OVER a, TRUE) AS near_up, coalesce(abs(lag(u.y) OVER z - u.y) <= 2 * lag(u.size) OVER z, TRUE) AS near_down
  FROM up u JOIN down d USING (doc_id, page_no, slot) WINDOW a AS (PARTITION BY u.doc_id, u.page_no ORDER BY u.slot), z AS (PARTITION BY u.doc_id, u.page_no ORDER BY u.slot DESC)),
marked AS (SELECT *, bool_and(strength >= 0.6 AND near_up AND fits) OVER (PARTITION BY doc_id, page_no ORDER BY slot) AS is_header, bool_and(foot_strength >= 0.6 AND near_down AND fits) OVER (PARTITION BY doc_id, page_no ORDER BY slot DESC) AS is_foot FROM good)
"""


@query(WITH_LINES + _FURNITURE + "SELECT doc_id, page_no, slot::BIGINT AS slot, strength, is_header FROM marked")
def furniture_header(spark, sf_dir):
    return layout.furniture(with_heads(spark, sf_dir)).select("doc_id", "page_no", "slot", "strength", "is_header")


@query(WITH_LINES + _FURNITURE + "SELECT doc_id, page_no, slot::BIGINT AS slot, foot_strength AS strength, is_foot AND NOT is_header AS is_footer FROM marked")
def furniture_footer(spark, sf_dir):
    return layout.furniture(with_heads(spark, sf_dir)).select("doc_id", "page_no", "slot", F.col("foot_strength").alias("strength"), "is_footer")


@query(WITH_LINES + "SELECT doc_id, (para_no + 1)::BIGINT AS island, min(line_no) AS first_line, count(*)::BIGINT AS n_lines, sum(n_words)::BIGINT AS n_words FROM lines GROUP BY 1, 2")
def paragraph_islands(spark, sf_dir):
    return layout.paragraphs(lines(spark, sf_dir))


@query(WITH_LINES + """, p AS (SELECT doc_id, max(page_no) + 1 AS pages FROM lines GROUP BY 1), h AS (SELECT doc_id, line, count(DISTINCT page_no)::BIGINT AS n_pages FROM lines WHERE line <> '' GROUP BY 1, 2)
SELECT doc_id, line, n_pages FROM h JOIN p USING (doc_id) WHERE n_pages >= greatest(3, ceil(pages / 2))""")
def repeated_elements(spark, sf_dir):
    return layout.repeated_elements(lines(spark, sf_dir))


@query(WITH_LINES + _GRID + """, box AS (SELECT doc_id, page_no, para_no, min(gx0) AS x0, max(gx1) AS x1, min(gy0) AS y0, max(gy1) AS y1 FROM grid GROUP BY 1, 2, 3)
SELECT a.doc_id, a.page_no, a.para_no, coalesce(max(a.y0) - max(b.y1) FILTER (b.y0 < a.y0 AND b.x0 < a.x1 AND a.x0 < b.x1), -1)::BIGINT AS gap
FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.page_no = b.page_no GROUP BY 1, 2, 3""")
def gap_above(spark, sf_dir):
    return layout.gap_above(lines(spark, sf_dir))


@query(WITH_LINES + """, n AS (SELECT doc_id, page_no, list_sort(list(length(line))) AS l FROM lines GROUP BY 1, 2)
SELECT doc_id, page_no, l[len(l) // 2 + 1]::BIGINT AS median_length FROM n""")
def page_upper_median(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.collect_list(F.length("line")).alias("l")).select("doc_id", "page_no", T.upper_median(F.col("l")).cast("long").alias("median_length"))


# ---------------------------------------------------------------- read-out


@query(WITH_LINES + "SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS page_text FROM lines GROUP BY 1, 2")
def reading_text_by_page(spark, sf_dir):
    return readout.page_text(lines(spark, sf_dir))


@query(WITH_LINES + f""", f AS (SELECT *, strpos(strip_accents(lower(line)), 'tion') AS hit FROM lines)
SELECT doc_id, page_no, line_no, hit::BIGINT AS hit, substring(line, greatest(1, hit - 30), hit - greatest(1, hit - 30) + 40) AS snippet FROM f WHERE hit > 0""")
def fold_search(spark, sf_dir):
    return readout.search(lines(spark, sf_dir), "tion")


@query(WITH_LINES + """, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(line), '[\\p{L}]+(?:-[\\p{L}]+)*')) AS word FROM lines)
SELECT doc_id, word, contains(word, '-') AS is_compound FROM w""")
def vocab_words(spark, sf_dir):
    return readout.vocabulary(lines(spark, sf_dir))


_RUNS = """, w AS (SELECT doc_id, page_no, line_no, y, size, string_split(line, ' ') AS ws FROM lines),
e AS (SELECT *, unnest(range(len(ws))) AS word_no, unnest(ws) AS word FROM w),
runs AS (SELECT doc_id, page_no, line_no, word_no, word, y, size, 72 + 5.0::DOUBLE * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, line_no * 100 + word_no AS z FROM e),
words2 AS (SELECT * FROM runs WHERE word <> ''),
boxes AS (SELECT doc_id, page_no, x AS bx0, x + 5.0::DOUBLE * length(word) AS bx1, y - 0.2::DOUBLE * size AS by0, y + 0.8::DOUBLE * size AS by1, z + 0.5 AS bz FROM words2 WHERE (doc_id * 31 + word_no + line_no) % 97 = 0),
hidden AS (SELECT DISTINCT r.doc_id, r.page_no, r.line_no, r.word_no::BIGINT AS word_no, r.word FROM words2 r JOIN boxes b ON r.doc_id = b.doc_id AND r.page_no = b.page_no
  AND r.x + 0.25::DOUBLE * r.size BETWEEN bx0 AND bx1 AND r.y + 0.35::DOUBLE * r.size BETWEEN by0 AND by1 AND r.z < bz)
"""


@query(WITH_LINES + _RUNS + "SELECT * FROM hidden")
def redact_text_under_box(spark, sf_dir):
    return readout.hidden_words(readout.page_runs(lines(spark, sf_dir)))


@query(WITH_LINES + _RUNS + "SELECT doc_id, count(*)::BIGINT AS n_left FROM words2 w WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.doc_id = w.doc_id AND h.page_no = w.page_no AND h.line_no = w.line_no AND h.word_no = w.word_no) GROUP BY 1")
def redact_apply(spark, sf_dir):
    left = readout.redacted(readout.page_runs(lines(spark, sf_dir)))
    return left.groupBy("doc_id").agg(F.sum(F.size("runs")).alias("n_left")).where("n_left > 0")


@query(WITH_LINES + "SELECT doc_id, p.i::BIGINT AS new_page, page_no, count(*)::BIGINT AS n_lines FROM lines JOIN (VALUES (0, 1), (1, 0), (2, 1)) AS p(i, src) ON page_no = src GROUP BY 1, 2, 3")
def page_set_reorder(spark, sf_dir):
    return readout.page_set(lines(spark, sf_dir), [1, 0, 1])


@query(WITH_LINES + f""", p AS (SELECT doc_id, para_no, trim(regexp_replace(string_agg(line, ' ' ORDER BY part), '{_WS}+', ' ', 'g')) AS whole, max(size) AS size FROM lines GROUP BY 1, 2),
m AS (SELECT *, '^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+' AS marker FROM p),
b AS (SELECT doc_id, para_no, CASE WHEN size > 10 THEN '# ' || whole WHEN regexp_matches(whole, '^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+.') THEN '- ' || trim(regexp_replace(whole, '^[ \\t\\x0B\\f\\r]*([{T.BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+', '')) ELSE whole END AS block FROM m)
SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY para_no) AS markdown FROM b WHERE block <> '' GROUP BY 1""")
def markdown_blocks(spark, sf_dir):
    return readout.markdown(lines(spark, sf_dir))


@query(WITH_LINES + "SELECT doc_id, line_no, CASE WHEN trim(line) = '' THEN 'Heading ' || (line_no + 1) WHEN length(trim(line)) <= 120 THEN trim(line) ELSE substring(trim(line), 1, 120) || '…' END AS label FROM lines WHERE size > 10")
def toc_entries(spark, sf_dir):
    t = F.trim("line")
    label = F.when(t == "", F.concat(F.lit("Heading "), (F.col("line_no") + 1).cast("string"))).when(F.length(t) <= 120, t).otherwise(F.concat(F.substring(t, 1, 120), F.lit("…")))
    return lines(spark, sf_dir).where("size > 10").select("doc_id", "line_no", label.alias("label"))


@query(WITH_LINES + "SELECT p.doc_id, p.page_no, coalesce(h.line, 'Page ' || (p.page_no + 1)) AS nav FROM (SELECT DISTINCT doc_id, page_no FROM lines) p LEFT JOIN (SELECT doc_id, page_no, line FROM lines WHERE size > 10 AND line <> '') h USING (doc_id, page_no)")
def per_page_nav(spark, sf_dir):
    own = lines(spark, sf_dir)
    return own.groupBy("doc_id", "page_no").agg(F.coalesce(F.max(F.when((F.col("size") > 10) & (F.col("line") != ""), F.col("line"))), F.concat(F.lit("Page "), (F.col("page_no") + 1).cast("string"))).alias("nav"))


@query(WITH_LINES + """, h AS (SELECT doc_id, n_words % 6 + 1 AS level, count(*) AS n FROM lines WHERE part = 0 GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY level) AS cum FROM h)
SELECT doc_id, min(level)::BIGINT AS cut_level FROM c WHERE cum >= 2 GROUP BY 1""")
def chapter_cut_level(spark, sf_dir):
    from pyspark.sql import Window as W

    counts = _headings(spark, sf_dir).groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("cum", F.sum("n").over(W.partitionBy("doc_id").orderBy("level"))).where("cum >= 2").groupBy("doc_id").agg(F.min("level").alias("cut_level"))


@query("""SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1""")
def conversation_text(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return own.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript"))


@query(WITH_LINES + "SELECT b.item_id, l.doc_id, l.line_no FROM lines l JOIN (SELECT item_id, string_split(text, chr(10))[1] AS head FROM benchmark) b ON l.para_no >= 0 AND l.line = array_to_string(string_split(b.head, ' ')[1:12], ' ')")
def outline_anchor_exact(spark, sf_dir):
    title = F.array_join(F.slice(F.split(F.element_at(F.split("text", "\n", -1), 1), " ", -1), 1, 12), " ")
    anchors = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", title.alias("line"))
    return lines(spark, sf_dir).join(anchors, "line").select("item_id", "doc_id", "line_no")


# ---------------------------------------------------------------- over the model tables

from quire.catalogue import readout as readout_queries  # noqa: E402, F401
from quire.catalogue import containers, grouped, paging, scalars, signals, sources, structure, surgery  # noqa: E402, F401
