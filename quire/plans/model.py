"""Model tables made of plain texts: blocks, runs, fills, pictures, outline, notes and structure nodes of documents.

A paragraph of a text is a block.  Six blocks make a page, in one column or two; sizes, weights, families, angles and
colours follow from whole numbers (h) of document and block, so that every rule of layout and structure meets cases on
both sides.  Boxes are on a grid of 0..1000 with the origin at the top left.  All tables are projections of a document's
row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

BLOCKS_A_PAGE = 6
SIZES = (10, 10, 10, 11, 14, 18)
FAMILIES = ("serif", "sans", "mono")
WORDS_A_RUN = 4

#: What becomes one blank; a blank by itself is one already, and most texts are left as they are.
SPACES = "[ \\t\\n\\x0B\\f\\r]{2,}|[\\t\\n\\x0B\\f\\r]"


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, page_no, slot, h, x0, y0, x1, y1, size, bold, angle, family, ink, n_chars, text of every block."""
    # the lists of this module are never empty; a plain explode would test that, and make the list twice
    rows = docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("o", "body"))
    rows = rows.select("doc_id", F.col("o").cast("long").alias("ord"), F.trim(F.regexp_replace("body", SPACES, " ")).alias("text"))
    rows = _laid(rows.withColumn("n_chars", F.length("text").cast("long")))
    rows = rows.withColumn("y1", F.col("y0") + 20 + F.least(F.col("pitch") - 40, F.expr("n_chars div 8")))
    angle = F.when(F.col("h") % 29 == 0, 90).when(F.col("h") % 13 == 0, 3).otherwise(0).cast("long")
    return rows.select("doc_id", "ord", "page_no", "slot", "h", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), "size", "bold", angle.alias("angle"), "family", ((F.col("h") % 7) * 1118481).alias("ink"), "n_chars", "text")


def _laid(rows: DataFrame) -> DataFrame:
    """The rows with what follows from doc_id and ord alone: place on the page, size and family of a block."""
    rows = rows.withColumns({"h": F.col("doc_id") * 31 + F.col("ord") * 17, "page_no": F.expr(f"ord div {BLOCKS_A_PAGE}"), "slot": F.col("ord") % BLOCKS_A_PAGE, "cols": F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("long")})
    rows = rows.withColumns({"base": F.when(F.col("cols") == 2, 60 + 480 * (F.col("slot") % 2)).otherwise(100), "width": F.when(F.col("cols") == 2, 400).otherwise(800), "pitch": F.expr(f"900 div ({BLOCKS_A_PAGE} div cols)")})
    rows = rows.withColumns({"x0": F.col("base") + 10 * (F.col("h") % 4), "x1": F.col("base") + F.col("width") - 7 * (F.col("h") % 3), "y0": F.expr("40 + pitch * (slot div cols)")})
    size = F.when(F.col("ord") == 0, 20).otherwise(_pick(SIZES, F.col("h"))).cast("long")
    return rows.withColumns({"size": size, "bold": F.col("h") % 5 == 0, "family": _pick(FAMILIES, F.col("h"))})


#: The same blocks for DuckDB.
BLOCKS_SQL = f"""
b0 AS (SELECT doc_id, unnest(range(len(ps)))::BIGINT AS ord, unnest(ps) AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents)),
b1 AS (SELECT doc_id, ord, trim(regexp_replace(body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, doc_id * 31 + ord * 17 AS h, ord // {BLOCKS_A_PAGE} AS page_no, ord % {BLOCKS_A_PAGE} AS slot, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS cols FROM b0),
b2 AS (SELECT *, length(text)::BIGINT AS n_chars, CASE WHEN cols = 2 THEN 60 + 480 * (slot % 2) ELSE 100 END AS base, CASE WHEN cols = 2 THEN 400 ELSE 800 END AS width, 900 // ({BLOCKS_A_PAGE} // cols) AS pitch FROM b1),
b3 AS (SELECT *, base + 10 * (h % 4) AS x0, base + width - 7 * (h % 3) AS x1, 40 + pitch * (slot // cols) AS y0 FROM b2),
blocks AS (SELECT doc_id, ord, page_no, slot, h, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, (y0 + 20 + least(pitch - 40, n_chars // 8))::BIGINT AS y1,
  (CASE WHEN ord = 0 THEN 20 ELSE {list(SIZES)}[(h % {len(SIZES)} + 1)::INT] END)::BIGINT AS size, h % 5 = 0 AS bold, (CASE WHEN h % 29 = 0 THEN 90 WHEN h % 13 = 0 THEN 3 ELSE 0 END)::BIGINT AS angle,
  {list(FAMILIES)}[(h % {len(FAMILIES)} + 1)::INT] AS family, (h % 7) * 1118481 AS ink, n_chars, text FROM b3)"""


def _runs(b: DataFrame, *others: Column) -> DataFrame:
    """The runs of blocks with other columns, which may ask for `last`, the number of their block's last run."""
    b = b.where("text <> ''")
    # words have one blank between them, so a run is a match; it is found by going over the text once
    pieces = F.regexp_extract_all("text", F.lit(f"[^ ]++(?: [^ ]++){{0,{WORDS_A_RUN - 1}}}"), F.lit(0))
    rows = b.withColumn("w", pieces).select("doc_id", "ord", "page_no", "h", "x0", "y0", "size", "bold", "family", (F.size("w") - 1).cast("long").alias("last"), F.posexplode_outer("w").alias("r", "piece")).withColumn("run", F.col("r").cast("long"))
    return _styled(rows, *others)


def _styled(rows: DataFrame, *others: Column | str) -> DataFrame:
    """Runs of pieces of text (doc_id, ord, run, piece) that have the columns of their block."""
    k = F.col("h") + F.col("run")
    size = F.when(k % 11 == 0, F.col("size") - 3).otherwise(F.col("size"))
    return rows.select("doc_id", "ord", "run", "page_no", (F.col("x0") + 40 * (F.col("run") % 4)).alias("x0"), (F.col("y0") + 12 * F.expr("run div 4")).alias("y0"), size.alias("size"), ((k % 3 == 0) | F.col("bold")).alias("bold"), F.when(k % 17 == 0, "symbol").otherwise(F.col("family")).alias("family"), F.col("piece").alias("text"), F.length("piece").cast("long").alias("n_chars"), *others)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, ord, run, page_no, x0, y0, size, bold, family, text: a block's words, WORDS_A_RUN to a run, four runs to a line."""
    return _runs(blocks(docs))


def n_runs() -> Column:
    """How many runs a block that is not empty has."""
    return F.expr(f"(size(split(text, ' ', -1)) - 1) div {WORDS_A_RUN} + 1")


def run_boxes() -> Column:
    """The list of a block's runs as boxes: six units a letter wide and one size high."""
    w = F.split("text", " ", -1)

    def box(n: Column, r: Column) -> Column:
        x, y = F.col("x0") + 40 * (r % 4), F.col("y0") + 12 * F.floor(r / 4)
        size = F.when((F.col("h") + r) % 11 == 0, F.col("size") - 3).otherwise(F.col("size"))
        return F.struct(x.alias("x0"), y.alias("y0"), (x + 6 * n).alias("x1"), (y + size).alias("y1"))

    parts = F.transform(F.sequence(F.lit(0), (n_runs() - 1).cast("int")), lambda i: F.length(F.array_join(F.slice(w, i * WORDS_A_RUN + 1, WORDS_A_RUN), " ")).cast("long"))
    return F.transform(parts, box)


def numbered_runs(docs: DataFrame) -> DataFrame:
    """The runs with `n`, their number in their document from 1 on: one list a document has them in order, so nothing is dealt or sorted."""
    paras = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda p: F.split(F.trim(F.regexp_replace(p, "[ \\t\\n\\x0B\\f\\r]+", " ")), " ", -1))
    piece = lambda w, ord_, i: F.struct(ord_.cast("long").alias("ord"), i.cast("long").alias("run"), F.array_join(F.slice(w, i * WORDS_A_RUN + 1, WORDS_A_RUN), " ").alias("piece"))
    parts = lambda w, ord_: F.transform(F.filter(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / WORDS_A_RUN).cast("int")), lambda i: (F.size(w) > 1) | (w[0] != "")), lambda i: piece(w, ord_, i))
    rows = docs.select("doc_id", F.posexplode_outer(F.flatten(F.transform(paras, parts))).alias("o", "l")).where("l is not null")
    return _styled(_laid(rows.select("doc_id", (F.col("o") + 1).alias("n"), "l.ord", "l.run", "l.piece")), "n")


def spaced_runs(docs: DataFrame) -> DataFrame:
    """The runs as read: line, and a blank after each run that does not end its line."""
    r = _runs(blocks(docs), ((F.col("run") % 4 < 3) & (F.col("run") < F.col("last"))).alias("goes_on")).withColumn("line", F.expr("run div 4"))
    return r.select("doc_id", "page_no", "ord", "run", "line", F.concat("text", F.when(F.col("goes_on"), " ").otherwise("")).alias("text"), "x0", "y0", "size")


def letter_places() -> Column:
    """The x of every letter of a run, six units apart."""
    xs = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda k: (F.col("x0") + 6 * k).cast("double"))
    return F.when(F.col("text") == "", F.array().cast("array<double>")).otherwise(xs)


def lettered(docs: DataFrame) -> DataFrame:
    """The runs as read, with the x of every letter."""
    return spaced_runs(docs).select("doc_id", "page_no", "ord", "run", "line", "text", letter_places().alias("xs"), "x0", "y0", "size")


LETTERED_SQL = """
l0 AS (SELECT *, run // 4 AS line, lead(run // 4) OVER (PARTITION BY doc_id, ord ORDER BY run) AS after FROM runs),
lettered AS (SELECT doc_id, page_no, ord, run, line, text || CASE WHEN after = line THEN ' ' ELSE '' END AS text, x0, y0, size FROM l0)"""

RUNS_SQL = f"""
r0 AS (SELECT *, string_split(text, ' ') AS w FROM blocks WHERE text <> ''),
r1 AS (SELECT doc_id, ord, page_no, h, x0, y0, size, bold, family, w, unnest(range((len(w) - 1) // {WORDS_A_RUN} + 1))::BIGINT AS run FROM r0),
runs AS (SELECT doc_id, ord, run, page_no, x0 + 40 * (run % 4) AS x0, y0 + 12 * (run // 4) AS y0, CASE WHEN (h + run) % 11 = 0 THEN size - 3 ELSE size END AS size, (h + run) % 3 = 0 OR bold AS bold,
  CASE WHEN (h + run) % 17 = 0 THEN 'symbol' ELSE family END AS family, array_to_string(w[run * {WORDS_A_RUN} + 1 : run * {WORDS_A_RUN} + {WORDS_A_RUN}], ' ') AS text, length(array_to_string(w[run * {WORDS_A_RUN} + 1 : run * {WORDS_A_RUN} + {WORDS_A_RUN}], ' '))::BIGINT AS n_chars FROM r1)"""


def fills(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, fill, z, x0, y0, x1, y1, colour: painted boxes; a block's z is 10 * ord, so some cover it and some lie below."""
    return fills_of(blocks(docs))


def fills_of(b: DataFrame) -> DataFrame:
    box = lambda fill, z, x0, y0, x1, y1, colour, when: F.when(when, F.struct(F.lit(fill).alias("fill"), z.cast("long").alias("z"), *(v.cast("long").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))), colour.cast("long").alias("colour")))
    z, h, n = F.col("ord") * 10, F.col("h"), F.lit
    kinds = F.array(
        box("tight", z - 5, F.col("x0") - 5, F.col("y0") - 5, F.col("x1") + 5, F.col("y1") + 5, F.when(h % 6 == 0, F.col("ink") + 5).otherwise(16777215 - (h % 5) * 1000), h % 3 == 0),
        box("wide", z - 6, n(50), n(30), n(950), n(530), n(15658734), (F.col("slot") == 0) & (h % 2 == 0)),
        box("page", z - 7, n(0), n(0), n(1000), n(1000), n(16777215), (F.col("slot") == 0) & (F.col("doc_id") % 4 == 0)),
        box("cover", z + 5, F.col("x0"), F.col("y0") - F.when(h % 16 == 11, 400).otherwise(0), F.col("x0") + 150, F.col("y0") + 30, F.when(h % 2 == 0, F.col("ink") + 5).otherwise(F.col("ink") + 2000000), h % 8 == 3),
    )
    return b.select("doc_id", "page_no", "ord", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f")).select("doc_id", "page_no", "ord", "f.*")


FILLS_SQL = """
fills AS (
  SELECT doc_id, page_no, ord, 'tight' AS fill, ord * 10 - 5 AS z, x0 - 5 AS x0, y0 - 5 AS y0, x1 + 5 AS x1, y1 + 5 AS y1, CASE WHEN h % 6 = 0 THEN ink + 5 ELSE 16777215 - (h % 5) * 1000 END AS colour FROM blocks WHERE h % 3 = 0
  UNION ALL SELECT doc_id, page_no, ord, 'wide', ord * 10 - 6, 50, 30, 950, 530, 15658734 FROM blocks WHERE slot = 0 AND h % 2 = 0
  UNION ALL SELECT doc_id, page_no, ord, 'page', ord * 10 - 7, 0, 0, 1000, 1000, 16777215 FROM blocks WHERE slot = 0 AND doc_id % 4 = 0
  UNION ALL SELECT doc_id, page_no, ord, 'cover', ord * 10 + 5, x0, y0 - CASE WHEN h % 16 = 11 THEN 400 ELSE 0 END, x0 + 150, y0 + 30, CASE WHEN h % 2 = 0 THEN ink + 5 ELSE ink + 2000000 END FROM blocks WHERE h % 8 = 3)"""


def pictures(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, ref, sha, z, x0, y0, x1, y1, running: every fourth block or so stands beside a picture."""
    return pictures_of(blocks(docs))


def pictures_of(b: DataFrame) -> DataFrame:
    b = b.where("h % 4 = 1")
    fixed = F.col("h") % 3 == 0
    at = lambda a, c: F.when(fixed, F.lit(a)).otherwise(F.col(c)).cast("long").alias(c)
    return b.select("doc_id", "page_no", "ord", F.when(fixed, 1).otherwise(F.col("h") % 9).cast("long").alias("ref"), F.md5(F.concat(F.lit("p"), (F.col("h") % 5).cast("string"))).alias("sha"), (F.col("ord") * 10 + 1).alias("z"), at(20, "x0"), at(20, "y0"), at(60, "x1"), at(60, "y1"), (F.col("h") % 10 == 9).alias("running"))


PICTURES_SQL = """
pictures AS (SELECT doc_id, page_no, ord, (CASE WHEN h % 3 = 0 THEN 1 ELSE h % 9 END)::BIGINT AS ref, md5('p' || (h % 5)::VARCHAR) AS sha, ord * 10 + 1 AS z,
  CASE WHEN h % 3 = 0 THEN 20 ELSE x0 END AS x0, CASE WHEN h % 3 = 0 THEN 20 ELSE y0 END AS y0, CASE WHEN h % 3 = 0 THEN 60 ELSE x1 END AS x1, CASE WHEN h % 3 = 0 THEN 60 ELSE y1 END AS y1, h % 10 = 9 AS running
  FROM blocks WHERE h % 4 = 1)"""


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, entry, page_no, y, title: bookmarks whose titles are a block's text, its start, a part of it, or something else."""
    b = blocks(docs).where("slot < 2 and text <> ''")
    title = F.when(F.col("h") % 4 == 0, F.col("text")).when(F.col("h") % 4 == 1, F.substring("text", 1, 24)).when(F.col("h") % 4 == 2, F.substring("text", 5, 20)).otherwise(F.concat(F.lit("§ "), F.col("ord").cast("string")))
    return b.select("doc_id", F.col("ord").alias("entry"), "page_no", (F.col("y0") + 15 * (F.col("h") % 3)).alias("y"), title.alias("title"))


OUTLINE_SQL = """
outline AS (SELECT doc_id, ord AS entry, page_no, y0 + 15 * (h % 3) AS y,
  CASE WHEN h % 4 = 0 THEN text WHEN h % 4 = 1 THEN substring(text, 1, 24) WHEN h % 4 = 2 THEN substring(text, 5, 20) ELSE '§ ' || ord::VARCHAR END AS title FROM blocks WHERE slot < 2 AND text <> '')"""


def notes(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, note, kind, x0, y0, x1, y1: links, form fields and marks for redaction."""
    b = blocks(docs).where("h % 7 in (3, 5)")
    kind = F.when(F.col("h") % 7 == 3, F.when(F.col("h") % 2 == 0, "REDACT").otherwise("LINK")).otherwise("FIELD")
    return b.select("doc_id", "page_no", F.col("ord").alias("note"), kind.alias("kind"), "x0", "y0", (F.col("x0") + 120).alias("x1"), (F.col("y0") + 25).alias("y1"))


NOTES_SQL = """
notes AS (SELECT doc_id, page_no, ord AS note, CASE WHEN h % 7 = 3 THEN CASE WHEN h % 2 = 0 THEN 'REDACT' ELSE 'LINK' END ELSE 'FIELD' END AS kind, x0, y0, x0 + 120 AS x1, y0 + 25 AS y1 FROM blocks WHERE h % 7 IN (3, 5))"""


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node, parent, type, ref_page, ref: a structure tree over the blocks; some refs point to blocks that are not there."""
    b = blocks(docs)
    parent = F.when(F.col("ord") == 0, F.lit(None).cast("long")).otherwise(F.expr("(ord - 1) div 3"))
    kind = F.when(F.col("ord") == 0, "DOCUMENT").when(F.col("size") >= 14, "HEADING").when(F.col("h") % 4 == 1, "FIGURE").otherwise("PARAGRAPH")
    ref = F.when(F.col("h") % 19 == 0, F.col("ord") + 100000).otherwise(F.col("ord"))
    return b.select("doc_id", F.col("ord").alias("node"), parent.alias("parent"), kind.alias("type"), F.col("page_no").alias("ref_page"), ref.alias("ref"), "text", "h")


NODES_SQL = """
nodes AS (SELECT doc_id, ord AS node, CASE WHEN ord = 0 THEN NULL ELSE (ord - 1) // 3 END AS parent, CASE WHEN ord = 0 THEN 'DOCUMENT' WHEN size >= 14 THEN 'HEADING' WHEN h % 4 = 1 THEN 'FIGURE' ELSE 'PARAGRAPH' END AS type,
  page_no AS ref_page, CASE WHEN h % 19 = 0 THEN ord + 100000 ELSE ord END AS ref, text, h FROM blocks)"""


def typed(docs: DataFrame) -> DataFrame:
    """Blocks with a type and a level for the sinks."""
    return with_types(blocks(docs))


def with_types(b: DataFrame) -> DataFrame:
    kind = F.when(F.col("size") >= 14, "HEADING").when(F.col("h") % 8 == 1, "FIGURE").when(F.col("h") % 12 == 7, "TABLE").when(T.is_list_item(F.col("text")) | (F.col("h") % 10 == 2), "ITEM").when(F.col("h") % 9 == 4, "QUOTE").when(F.col("h") % 14 == 5, "CODE").when(F.col("h") % 11 == 3, "CAPTION").otherwise("PARAGRAPH")
    return b.withColumns({"type": kind, "level": F.when(F.col("size") == 20, 1).when(F.col("size") == 18, 2).otherwise(3).cast("long")})


def cells(docs: DataFrame) -> DataFrame:
    """Cells of the tables: a table's runs, four to a row, some of them with spans, the first row and column as heads."""
    own = _runs(typed(docs).where("type = 'TABLE'"))
    k = F.col("ord") * 3 + F.col("run")
    head = F.when(F.col("run") == 0, "both").when(F.col("run") < 4, "column").when(F.col("run") % 4 == 0, "row").otherwise("")
    return own.select("doc_id", F.col("ord").alias("tbl"), F.expr("run div 4").alias("row"), F.col("run").alias("col"), F.when(k % 6 == 0, "").otherwise(F.col("text")).alias("text"), head.alias("head"), F.when(k % 7 == 5, 2).otherwise(1).alias("col_span"), F.when(k % 5 == 2, 2 + k % 2).otherwise(1).alias("row_span"))


def sql(*tables: str) -> str:
    """WITH clause of the named tables."""
    own = {"runs": RUNS_SQL, "lettered": RUNS_SQL + "," + LETTERED_SQL, "fills": FILLS_SQL, "pictures": PICTURES_SQL, "outline": OUTLINE_SQL, "notes": NOTES_SQL, "nodes": NODES_SQL}
    return "WITH " + ",".join(x.strip("\n") for x in [BLOCKS_SQL, *(own[t] for t in tables if t != "blocks")])
