"""Queries of redaction and page sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import pageset as S
from quire.operators import redaction as R
from quire.operators import spans as P
from quire.operators import structure
from quire.plans import model as M
from quire.registry import documents, query


def inked(docs):
    """Runs with the ink and z of their block."""
    return M.runs(docs).join(M.blocks(docs).select("doc_id", "ord", "ink"), ["doc_id", "ord"]).withColumn("z", F.col("ord") * 10)


def opaque_fills(docs):
    return M.fills(docs).where("fill = 'cover'")


_SAME = " AND ".join(f"abs(((r.ink >> {s}) & 255) - ((f.colour >> {s}) & 255)) <= {R.SAME_INK}" for s in (16, 8, 0))
_FOUND = f"""
inked AS (SELECT r.*, b.ink, r.ord * 10 AS z FROM runs r JOIN blocks b USING (doc_id, ord)),
found AS (SELECT r.doc_id, r.page_no, r.ord, r.run, f.ord AS box, f.fill, CASE WHEN r.z < f.z THEN 'under' WHEN {_SAME} THEN 'invisible' END AS kind FROM inked r JOIN fills f USING (doc_id, page_no)
  WHERE r.x0 + r.size * 0.25 >= f.x0 AND r.x0 + r.size * 0.25 <= f.x1 AND r.y0 + r.size * 0.35 >= f.y0 AND r.y0 + r.size * 0.35 <= f.y1)"""


@query(M.sql("runs", "fills") + "," + _FOUND + " SELECT * FROM found WHERE kind = 'invisible'")
def redact_invisible_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return R.text_findings(inked(docs), M.fills(docs)).where("kind = 'invisible'")


@query(M.sql("pictures", "fills") + """, p AS (SELECT p.doc_id, p.page_no, p.ord, f.ord AS box, f.fill, (p.x1 - p.x0) * (p.y1 - p.y0) AS whole, p.z AS pz, f.z AS fz,
  greatest(0, least(p.x1, f.x1) - greatest(p.x0, f.x0)) * greatest(0, least(p.y1, f.y1) - greatest(p.y0, f.y0)) AS shared FROM pictures p JOIN fills f USING (doc_id, page_no))
SELECT doc_id, page_no, ord, box, fill, floor(shared * 100.0 / whole + 0.5) / 100 AS covered FROM p WHERE pz < fz AND shared > 0""")
def redact_image_fraction(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return R.picture_findings(M.pictures(docs), M.fills(docs))


@query(M.sql("notes") + " SELECT doc_id, page_no, note, x0, y0, x1, y1 FROM notes WHERE kind = 'REDACT'")
def redact_pending(spark, sf_dir):
    return M.notes(documents(spark, sf_dir)).where("kind = 'REDACT'").drop("kind")


#: Letters of the runs with a flag, the zones of their page applied, and the pieces that are left.
_ZONES = f"""
zones AS (SELECT DISTINCT doc_id, page_no, x0, y0, x1, y1 FROM notes WHERE kind = 'REDACT'),
near AS (SELECT DISTINCT r.doc_id, r.ord, r.run, z.x0 AS zx0, z.x1 AS zx1 FROM lettered r JOIN zones z USING (doc_id, page_no) WHERE r.y0 + {P.BODY_Y} * r.size >= z.y0 AND r.y0 + {P.BODY_Y} * r.size < z.y1),
letters AS (SELECT doc_id, page_no, ord, run, x0, size, unnest(range(length(text))) AS k, unnest(string_split(text, '')) AS ch FROM lettered),
hits AS (SELECT DISTINCT l.doc_id, l.ord, l.run, l.k FROM letters l JOIN near n USING (doc_id, ord, run) WHERE l.x0 + 6 * k + {P.BODY_X} * size >= zx0 AND l.x0 + 6 * k + {P.BODY_X} * size < zx1),
drops AS (SELECT doc_id, ord, run, count(*) AS n_dropped FROM hits GROUP BY 1, 2, 3),
left_ AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, ord, run ORDER BY k) AS island FROM letters ANTI JOIN hits USING (doc_id, ord, run, k)),
parts AS (SELECT doc_id, ord, run, min(k) AS a, min(x0 + 6 * k) AS x0, string_agg(ch, '' ORDER BY k) AS text FROM left_ GROUP BY doc_id, ord, run, island),
alive AS (SELECT doc_id, ord, run FROM parts GROUP BY ALL HAVING bool_or(trim(text) <> '')),
pieces AS (SELECT p.doc_id, p.ord, p.run, row_number() OVER (PARTITION BY p.doc_id, p.ord, p.run ORDER BY a) - 1 AS piece, p.text, p.x0, coalesce(n_dropped, 0) AS n_dropped
  FROM parts p JOIN alive USING (doc_id, ord, run) LEFT JOIN drops USING (doc_id, ord, run))"""


def boxed(docs):
    """Runs with boxes: six units a letter wide and one size high."""
    return M.runs(docs).withColumns({"x1": F.col("x0") + 6 * F.col("n_chars"), "y1": F.col("y0") + F.col("size")})


def _zones(docs):
    return M.notes(docs).where("kind = 'REDACT'")


@query(M.sql("lettered", "notes") + "," + _ZONES + " SELECT doc_id, ord, run, piece, text, x0::DOUBLE AS x0, n_dropped FROM pieces")
def redact_cut_runs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return P.pieces(P.cut_runs(M.lettered(docs), _zones(docs))).select("doc_id", "ord", "run", "piece", "text", F.col("xs")[0].alias("x0"), "n_dropped")


@query(M.sql("lettered", "notes") + "," + _ZONES + f""",
again AS (SELECT p.doc_id, count(DISTINCT (ord, run, piece, k)) AS n FROM (SELECT *, unnest(range(length(text))) AS k FROM pieces) p JOIN near n USING (doc_id, ord, run) JOIN lettered r USING (doc_id, ord, run)
  WHERE p.x0 + 6 * k + {P.BODY_X} * r.size >= zx0 AND p.x0 + 6 * k + {P.BODY_X} * r.size < zx1 GROUP BY 1)
SELECT h.doc_id, count(*) AS n_before, coalesce(max(n), 0)::BIGINT AS n_after, coalesce(max(n), 0) = 0 AS clean FROM hits h LEFT JOIN again USING (doc_id) GROUP BY 1""")
def redact_apply_proof(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own, zones = M.lettered(docs), _zones(docs)
    return P.proof(own, P.pieces(P.cut_runs(own, zones)), zones)


@query(M.sql("fills", "notes") + """, zones AS (SELECT DISTINCT doc_id, page_no, x0, y0, x1, y1 FROM notes WHERE kind = 'REDACT'),
f AS (SELECT row_number() OVER () AS id, * FROM fills), xs AS (SELECT DISTINCT id, x FROM (SELECT id, unnest([f.x0, f.x1]) AS x FROM f UNION ALL SELECT id, unnest([z.x0, z.x1]) FROM f JOIN zones z USING (doc_id, page_no)) JOIN f USING (id) WHERE x BETWEEN f.x0 AND f.x1),
ys AS (SELECT DISTINCT id, y FROM (SELECT id, unnest([f.y0, f.y1]) AS y FROM f UNION ALL SELECT id, unnest([z.y0, z.y1]) FROM f JOIN zones z USING (doc_id, page_no)) JOIN f USING (id) WHERE y BETWEEN f.y0 AND f.y1),
gx AS (SELECT id, x AS a, lead(x) OVER (PARTITION BY id ORDER BY x) AS b FROM xs), gy AS (SELECT id, y AS c, lead(y) OVER (PARTITION BY id ORDER BY y) AS d FROM ys),
cells AS (SELECT f.*, (b - a) * (d - c) AS area, EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = f.doc_id AND z.page_no = f.page_no AND z.x0 < b AND a < z.x1 AND z.y0 < d AND c < z.y1) AS gone FROM f JOIN gx USING (id) JOIN gy USING (id) WHERE b IS NOT NULL AND d IS NOT NULL)
SELECT doc_id, page_no, ord, fill, sum(area)::DOUBLE AS area FROM cells WHERE NOT gone GROUP BY ALL""")
def redact_clip_fills(spark, sf_dir):
    """What is left of the painted boxes; the SQL counts the cells of the grid that all sides make."""
    docs = documents(spark, sf_dir)
    left = P.clipped(M.fills(docs), _zones(docs), "doc_id", "page_no", "ord", "fill")
    return left.groupBy("doc_id", "page_no", "ord", "fill").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query(M.sql("notes") + """, zones AS (SELECT DISTINCT doc_id, page_no, x0, y0, x1, y1 FROM notes WHERE kind = 'REDACT')
SELECT doc_id, page_no, note, kind FROM notes n WHERE kind <> 'REDACT' AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = n.doc_id AND z.page_no = n.page_no AND n.x0 < z.x1 AND z.x0 < n.x1 AND n.y0 < z.y1 AND z.y0 < n.y1)""")
def redact_drop_notes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return R.cut(M.notes(docs).where("kind <> 'REDACT'"), _zones(docs), "doc_id", "page_no", "note").select("doc_id", "page_no", "note", "kind")


@query(M.sql("lettered", "notes", "nodes") + "," + _ZONES + """,
there AS (SELECT DISTINCT doc_id, ord FROM pieces), touched AS (SELECT DISTINCT doc_id, ord FROM hits)
SELECT n.doc_id, n.node, CASE WHEN t.ord IS NOT NULL AND l.ord IS NULL THEN NULL ELSE n.ref END AS ref, CASE WHEN t.ord IS NOT NULL THEN '' ELSE n.text END AS text
FROM nodes n LEFT JOIN touched t ON t.doc_id = n.doc_id AND t.ord = n.ref LEFT JOIN there l ON l.doc_id = n.doc_id AND l.ord = n.ref""")
def redact_purge_refs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    blocks = P.cut_runs(M.lettered(docs), _zones(docs)).groupBy("doc_id", "ord").agg((F.sum("n_dropped") > 0).alias("altered"), (F.max(F.size("spans")) == 0).alias("removed"))
    return R.purged(M.nodes(docs), blocks).select("doc_id", "node", "ref", "text")


def _specs(docs):
    """A page set for each document, by its number; some are refused."""
    own = M.blocks(docs).groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"))
    kinds = ("1,+,1", "1-", "{n}-1", "1-,1-,+", "2", "x", "1, {n} ,+,{n}-1", "-3", "1--2", "0")
    spec = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    many = F.when(F.col("doc_id") % 50 == 7, F.repeat(F.lit("1,"), 1001)).otherwise(F.replace(spec, F.lit("{n}"), F.col("n_pages").cast("string")))
    return own.select("doc_id", "n_pages", many.alias("spec"))


_SPECS = """
np AS (SELECT doc_id, max(page_no) + 1 AS n FROM blocks GROUP BY 1),
specs AS (SELECT doc_id, n, CASE WHEN doc_id % 50 = 7 THEN repeat('1,', 1001) ELSE replace(['1,+,1', '1-', '{n}-1', '1-,1-,+', '2', 'x', '1, {n} ,+,{n}-1', '-3', '1--2', '0'][(doc_id % 10 + 1)::INT], '{n}', n::VARCHAR) END AS spec FROM np),
s0 AS (SELECT doc_id, n, unnest(range(len(ps))) AS i, trim(unnest(ps)) AS p FROM (SELECT *, string_split(spec, ',') AS ps FROM specs)),
s1 AS (SELECT doc_id, n, i, p, regexp_matches(p, '^[0-9]+$|^[0-9]+ *- *[0-9]*$|^\\+$') AS fine, TRY_CAST(regexp_extract(p, '^([0-9]+)', 1) AS BIGINT) AS low,
  CASE WHEN NOT contains(p, '-') THEN TRY_CAST(regexp_extract(p, '^([0-9]+)', 1) AS BIGINT) WHEN regexp_matches(p, '- *$') THEN n ELSE TRY_CAST(regexp_extract(p, '([0-9]+)$', 1) AS BIGINT) END AS high FROM s0 WHERE p <> ''),
verdict AS (SELECT doc_id, CASE WHEN NOT bool_and(fine) THEN 'not a page' WHEN bool_or(p <> '+' AND (low IS NULL OR high IS NULL OR low < 1 OR low > n OR high < 1 OR high > n)) THEN 'no such page' WHEN sum(CASE WHEN p = '+' THEN 1 ELSE abs(high - low) + 1 END) > greatest(1000, 2 * max(n)) THEN 'too many pages' END AS error FROM s1 GROUP BY 1),
s2 AS (SELECT doc_id, i, unnest(range(CASE WHEN p = '+' THEN 1 ELSE abs(high - low) + 1 END)) AS k, p, low, high FROM s1 JOIN verdict USING (doc_id) WHERE error IS NULL),
slots AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS slot, CASE WHEN p <> '+' THEN low - 1 + CASE WHEN low <= high THEN k ELSE -k END END AS page_no FROM s2),
places AS (SELECT doc_id, page_no, min(slot) AS new_page FROM slots WHERE page_no IS NOT NULL GROUP BY 1, 2)"""


@query(M.sql() + "," + _SPECS + " SELECT doc_id, slot, page_no, NULL::VARCHAR AS error FROM slots UNION ALL SELECT doc_id, -1, NULL, error FROM verdict WHERE error IS NOT NULL")
def page_set_grammar(spark, sf_dir):
    return S.slots(_specs(documents(spark, sf_dir)))


@query(M.sql("nodes") + "," + _SPECS + " SELECT n.doc_id, node, new_page, ref FROM nodes n JOIN places p ON p.doc_id = n.doc_id AND p.page_no = n.ref_page")
def page_set_drop_refs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.moved_refs(M.nodes(docs), S.first_places(S.slots(_specs(docs))))


@query(M.sql("outline") + "," + _SPECS + " SELECT o.doc_id, entry, title, new_page, CASE WHEN new_page IS NOT NULL THEN y END AS y FROM outline o LEFT JOIN places p ON p.doc_id = o.doc_id AND p.page_no = o.page_no")
def page_set_outline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return S.moved_outline(M.outline(docs), S.first_places(S.slots(_specs(docs))))


@query(M.sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _SPECS + """,
refs AS (SELECT n.doc_id, node, new_page FROM nodes n JOIN places p ON p.doc_id = n.doc_id AND p.page_no = n.ref_page),
up AS (SELECT doc_id, node, node AS top FROM nodes UNION ALL SELECT u.doc_id, u.node, n.parent FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node = u.top WHERE n.parent IS NOT NULL),
f AS (SELECT u.doc_id, u.top AS node, min(new_page) AS first FROM up u JOIN refs r ON r.doc_id = u.doc_id AND r.node = u.node GROUP BY 1, 2)
SELECT n.doc_id, n.parent, n.node, row_number() OVER (PARTITION BY n.doc_id, n.parent ORDER BY first NULLS LAST, n.node) AS place FROM nodes n LEFT JOIN f ON f.doc_id = n.doc_id AND f.node = n.node WHERE n.parent IS NOT NULL""")
def page_set_siblings(spark, sf_dir):
    docs = documents(spark, sf_dir)
    nodes = M.nodes(docs)
    paths = structure.tree_paths(spark, nodes).join(nodes.select("doc_id", "node", "parent"), ["doc_id", "node"])
    return S.sibling_order(paths, S.moved_refs(nodes, S.first_places(S.slots(_specs(docs)))))


@query(M.sql("notes") + """, z AS (SELECT doc_id, page_no, x0, y0, x1 - x0 AS w, y1 - y0 AS h FROM notes WHERE kind = 'REDACT' AND doc_id % 5 <> 4)
SELECT doc_id, page_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + w)::DOUBLE AS x1, (y0 + h)::DOUBLE AS y1 FROM z""")
def zone_grammar(spark, sf_dir):
    own = _zones(documents(spark, sf_dir)).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    one = F.concat_ws("", F.col("page_no").cast("string"), F.lit(":"), F.concat_ws(",", *(F.col(c).cast("string") for c in ("x0", "y0", "w", "h"))))
    listed = F.to_json(F.collect_list(F.struct(F.col("page_no").alias("page"), F.col("x0").alias("x"), F.col("y0").alias("y"), "w", "h")))
    specs = own.groupBy("doc_id").agg(F.when(F.col("doc_id") % 5 == 4, "audit").when(F.col("doc_id") % 2 == 0, listed).otherwise(F.array_join(F.collect_list(one), " ; ")).alias("spec"))
    return S.zones(specs)


@query("""
WITH s AS (SELECT event_id, event_id % 4 > 0 AS filled, event_id % 9 = 0 AS gradient, (event_id % 21) / 20.0 AS alpha, (event_id % 50)::DOUBLE AS w, (event_id % 37)::DOUBLE AS h, (event_id % 11) / 10.0 AS cutoff FROM events)
SELECT event_id, round(w * h - 0.5 * (w * cutoff) * (h * cutoff), 6)::DOUBLE AS area, filled AND NOT gradient AND alpha >= 0.9 AND w >= 2 AND h >= 2 AND round(w * h - 0.5 * (w * cutoff) * (h * cutoff), 6) >= 0.6 * (w * h) AS opaque FROM s""")
def opaque_boxes(spark, sf_dir):
    e = F.col("event_id")
    w, h, k = (e % 50).cast("double"), (e % 37).cast("double"), (e % 11) / 10.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    # a box with one corner cut off
    points = F.array(point(zero, zero), point(w, zero), point(w, h * (1 - k)), point(w * (1 - k), h), point(zero, h))
    shape = R.shoelace(points)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return rows.select("event_id", F.round(shape, 6).alias("area"), R.opaque(e % 4 > 0, e % 9 == 0, (e % 21) / 20.0, w * h, F.round(shape, 6), w, h).alias("opaque"))
