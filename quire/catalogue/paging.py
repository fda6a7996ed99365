"""Queries of pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import paging as P
from quire.plans import model as M
from quire.registry import documents, query
from quire.sources.shared import work_dir


@query(M.sql("runs") + """, n AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY run, ord) AS z, CASE WHEN (ord + run) % 5 > 0 THEN ord // 2 END AS block FROM runs),
b AS (SELECT *, last_value(block IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(block IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM n),
o AS (SELECT *, p AS own FROM b WHERE p = f), s AS (SELECT *, CASE WHEN lag(own) OVER w = own AND z = lag(z) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY z)),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no ORDER BY z) AS span FROM s), g AS (SELECT doc_id, page_no, own AS block, span, min(z) AS z0, max(z) AS z1, count(*) AS n FROM t GROUP BY 1, 2, 3, 4)
SELECT doc_id, page_no, block, z0, z1, n, CASE WHEN count(*) OVER (PARTITION BY doc_id, page_no, block) >= 2 THEN block END AS flow FROM g""")
def paragraph_flow(spark, sf_dir):
    from pyspark.sql import Window as W

    # narrow rows shrink so much on their way that partitions put together by their size are large in memory, in several sorts
    # at once; a number of partitions that is given is left as it is
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = M.runs(documents(spark, sf_dir)).select("doc_id", "page_no", "ord", "run").repartition(n, "doc_id", "page_no")
    z = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("run", "ord")).cast("long")
    own = r.select("doc_id", "page_no", z.alias("z"), F.when((F.col("ord") + F.col("run")) % 5 > 0, F.expr("ord div 2")).alias("block"), F.lit(1).alias("step"))
    return P.paint_spans(own)


@query(M.sql("nodes") + """, s AS (SELECT doc_id, parent, node, CASE WHEN h % 3 = 0 THEN h % 7 END AS given, node AS idx FROM nodes WHERE parent IS NOT NULL)
SELECT doc_id, parent, node, row_number() OVER (PARTITION BY doc_id, parent ORDER BY coalesce(given, idx), idx) - 1 AS place FROM s""")
def sibling_places(spark, sf_dir):
    own = M.nodes(documents(spark, sf_dir)).where("parent is not null")
    return P.sibling_places(own.select("doc_id", "parent", "node", F.when(F.col("h") % 3 == 0, F.col("h") % 7).alias("given"), F.col("node").alias("idx")))


@query(M.sql() + """, p AS (SELECT doc_id, page_no, 0 AS x0, 0 AS y0, 1000 AS x1, 1000 AS y1, (page_no % 4) * 90 AS rotation, doc_id % 6 - 2 AS turns, min(x0) - 30 AS c_x0, min(y0) - 50 AS c_y0, CASE WHEN doc_id % 9 = 0 THEN min(x0) - 40 ELSE max(x1) + 60 END AS c_x1, max(y1) + 90 AS c_y1 FROM blocks GROUP BY 1, 2),
c AS (SELECT *, greatest(x0, c_x0) AS a, greatest(y0, c_y0) AS b, least(x1, c_x1) AS c, least(y1, c_y1) AS d FROM p)
SELECT doc_id, page_no, (CASE WHEN c > a AND d > b THEN a ELSE x0 END)::BIGINT AS x0, (CASE WHEN c > a AND d > b THEN b ELSE y0 END)::BIGINT AS y0, (CASE WHEN c > a AND d > b THEN c ELSE x1 END)::BIGINT AS x1, (CASE WHEN c > a AND d > b THEN d ELSE y1 END)::BIGINT AS y1, (((rotation + 90 * turns) % 360 + 360) % 360)::BIGINT AS rotation FROM c""")
def page_crop_rotate(spark, sf_dir):
    own = M.blocks(documents(spark, sf_dir)).groupBy("doc_id", "page_no").agg(F.min("x0").alias("l"), F.min("y0").alias("t"), F.max("x1").alias("r"), F.max("y1").alias("b"))
    n = lambda v: F.lit(v).cast("long")
    pages = own.select("doc_id", "page_no", n(0).alias("x0"), n(0).alias("y0"), n(1000).alias("x1"), n(1000).alias("y1"), (F.col("page_no") % 4 * 90).alias("rotation"), (F.col("doc_id") % 6 - 2).alias("turns"), (F.col("l") - 30).alias("c_x0"), (F.col("t") - 50).alias("c_y0"), F.when(F.col("doc_id") % 9 == 0, F.col("l") - 40).otherwise(F.col("r") + 60).alias("c_x1"), (F.col("b") + 90).alias("c_y1"))
    return P.cropped(pages)


@query(M.sql("fills") + ", c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM fills) SELECT doc_id, page_no, ord, fill FROM c WHERE n <= 4")
def limit_with_guard(spark, sf_dir):
    return P.guarded(M.fills(documents(spark, sf_dir)), 4, "doc_id", "page_no").select("doc_id", "page_no", "ord", "fill")


@query(M.sql("notes") + " SELECT doc_id, page_no, ord, n_chars FROM blocks SEMI JOIN (SELECT DISTINCT doc_id, page_no FROM notes WHERE kind = 'REDACT') USING (doc_id, page_no)")
def patch_pages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return P.patched(M.blocks(docs), M.notes(docs).where("kind = 'REDACT'")).select("doc_id", "page_no", "ord", "n_chars")


@query(M.sql("notes") + """, t AS (SELECT DISTINCT doc_id, page_no, TRUE AS named FROM notes WHERE kind = 'REDACT')
SELECT doc_id, page_no, ord, CASE WHEN named THEN upper(translate(text, 'ß', 's')) ELSE translate(text, 'ß', 's') END AS text FROM blocks LEFT JOIN t USING (doc_id, page_no)""")
def patch_upsert(spark, sf_dir):
    """The written model after a patch of the pages that have marks: their texts in capitals."""
    own = M.blocks(documents(spark, sf_dir)).select("doc_id", "page_no", "ord", F.translate("text", "ß", "s").alias("text"))
    path = f"{work_dir(spark)}/model"
    P.write_model(own, path)
    P.write_patch(P.patched(own, M.notes(documents(spark, sf_dir)).where("kind = 'REDACT'")).withColumn("text", F.upper("text")), path)
    return P.read_model(spark, path)


@query(M.sql("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + """, up AS (SELECT doc_id, node, node AS top FROM nodes UNION ALL SELECT u.doc_id, u.node, n.parent FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node = u.top WHERE n.parent IS NOT NULL)
SELECT n.doc_id, n.node AS root, count(*) AS n_runs, min(r.ref) AS first_ref FROM nodes n JOIN up ON up.doc_id = n.doc_id AND up.top = n.node JOIN nodes r ON r.doc_id = up.doc_id AND r.node = up.node WHERE n.type = 'HEADING' GROUP BY 1, 2""")
def runs_under_root(spark, sf_dir):
    from quire.operators import structure

    own = M.nodes(documents(spark, sf_dir))
    above = structure.tree_paths(spark, own).select("doc_id", "node", F.explode(F.split("path", "/")).alias("up")).select("doc_id", "node", F.col("up").cast("long").alias("root"))
    roots = own.where("type = 'HEADING'").select("doc_id", F.col("node").alias("root"))
    return above.join(roots, ["doc_id", "root"]).join(own.select("doc_id", "node", "ref"), ["doc_id", "node"]).groupBy("doc_id", "root").agg(F.count("*").alias("n_runs"), F.min("ref").alias("first_ref"))
