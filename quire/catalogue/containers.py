"""Queries over containers: the documents are written as containers, one each, and read back through the data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import model as M
from quire.registry import documents, query
from quire.sources import container as C
from quire.sources.shared import work_dir


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _plain(c: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _page_id(c: str) -> Column:
    return F.concat(F.lit("p"), (F.col(c) + 1).cast("string"))


def members(docs: DataFrame) -> DataFrame:
    """path, place, name, content: what a document's container holds.

    Page members are numbered from the last page down, so only the spine tells their order.
    """
    b = M.blocks(docs)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("path")
    member = lambda rows, place, name, text: rows.select(path, F.lit(place).alias("place") if isinstance(place, int) else place.alias("place"), (F.lit(name) if isinstance(name, str) else name).alias("name"), F.encode(text, "UTF-8").alias("content"))
    n_pages = b.groupBy("doc_id").agg((F.max("page_no") + 1).cast("int").alias("n"))
    file = lambda no: F.concat(F.lit("page-"), F.lpad(no.cast("string"), 3, "0"), F.lit(".xhtml"))
    # to_json leaves nulls out, so the first layer says nothing of being visible
    layer = lambda i, name, visible, engine: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), visible.alias("visible"), F.struct(F.lit(engine).cast("string").alias("engine")).alias("ocr"))
    meta = F.to_json(F.struct(F.lit("4").alias("version"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.array("source", "lang").alias("authors"), F.col("lang").alias("language"), F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")).alias("custom"), F.struct((F.col("doc_id") % 2 == 0).alias("textSegmented")).alias("analysis"), F.array(layer("l0", "ink", F.lit(None).cast("boolean"), None), layer("l1", "scan", F.col("n_chars") > 1000, "ocr")).alias("layers")))
    items = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit('<item id="i'), i.cast("string"), F.lit('" href="pages/'), file(F.col("n") + 1 - i), F.lit('"/>')))
    refs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit('<itemref idref="i'), i.cast("string"), F.lit('"/>')))
    package = F.concat(F.lit("<package><manifest>"), F.array_join(items, ""), F.lit("</manifest><spine>"), F.array_join(refs, ""), F.lit("</spine></package>"))
    para = F.concat(F.lit('<p id="b'), F.col("ord").cast("string"), F.lit('">'), _escaped(F.col("text")), F.lit("</p>\n"))
    pages = b.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", para.alias("p")))), lambda x: x["p"]), "").alias("body"))
    pages = pages.join(n_pages, "doc_id").withColumn("no", F.col("n") - F.col("page_no").cast("int"))
    # bookmarks of a page: the first holds the second
    entry = F.struct(F.col("entry"), F.col("title"), F.when(F.col("entry") % 4 > 0, _page_id("page_no")).alias("page"), F.col("y"))
    marks = M.outline(docs).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    bare = lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page"), x["y"].alias("y"))
    first = F.element_at("e", 1)
    marks = marks.withColumn("top", F.struct(first["title"].alias("title"), first["page"].alias("page"), first["y"].alias("y"), F.transform(F.slice("e", 2, 1), bare).alias("children")))
    marks = marks.groupBy("doc_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "top"))), lambda x: x["top"]).alias("bookmarks"))).alias("json"))
    # sections of a page hold its nodes
    node = F.struct(F.col("node"), F.lower("type").alias("type"), F.array(F.struct(_page_id("ref_page").alias("page"), F.concat(F.lit("b"), F.col("ref").cast("string")).alias("node"))).alias("refs"))
    sections = M.nodes(docs).where("type <> 'DOCUMENT'").groupBy("doc_id", "ref_page").agg(F.array_sort(F.collect_list(node)).alias("k"))
    section = F.struct(F.lit("section").alias("type"), F.transform("k", lambda x: F.struct(x["type"].alias("type"), x["refs"].alias("refs"))).alias("children"))
    sections = sections.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_page", section.alias("s")))), lambda x: x["s"]).alias("s"))
    structures = F.to_json(F.struct(F.lit("s1").alias("default"), F.array(F.struct(F.lit("s1").alias("id"), F.struct(F.lit("document").alias("type"), F.col("s").alias("children")).alias("root"))).alias("structures")))
    rect = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    n = M.notes(docs)
    of = n.groupBy("doc_id", "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "FIELD", F.struct("note", F.lower("kind").alias("type"), rect.alias("rect"))))), lambda x: F.struct(x["type"].alias("type"), x["rect"].alias("rect"))).alias("annots"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "FIELD", F.struct("note", rect.alias("rect"))))), lambda x: F.struct(F.lit("text").alias("type"), x["rect"].alias("rect"), F.concat(F.lit("f"), x["note"].cast("string")).alias("name"), F.lit(True).alias("required"))).alias("fields"),
    )
    annots = of.groupBy("doc_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(_page_id("page_no"), F.struct("annots", "fields")))).alias("pages"))).alias("json"))
    parts = [
        member(docs, 0, "mimetype", F.lit("application/epub+zip")), member(docs, 1, "OEBPS/model/meta.json", meta), member(n_pages, 2, "OEBPS/content.opf", package), member(marks, 3, "OEBPS/model/outline.json", F.col("json")),
        member(sections, 4, "OEBPS/model/structures.json", structures), member(annots, 5, "OEBPS/model/annots.json", F.col("json")), member(pages, F.col("no") + 5, F.concat(F.lit("OEBPS/pages/"), file(F.col("no"))), F.concat(F.lit("<html><body>\n"), F.col("body"), F.lit("</body></html>\n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kept(spark, sf_dir, columns=C.SCHEMA):
    """The containers of the documents, written and opened again."""
    folder = f"{work_dir(spark)}/containers"
    C.write_containers(members(documents(spark, sf_dir)), folder)
    return C.read_containers(spark, folder, columns)


def doc_id() -> Column:
    return F.regexp_extract("path", "d(-?[0-9]+)[.]epub$", 1).cast("long").alias("doc_id")


@query(M.sql() + """, e AS (SELECT doc_id, page_no, sum(strlen('<p id="b' || ord || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || chr(10))) + strlen('<html><body></body></html>') + 2 AS n FROM blocks GROUP BY 1, 2)
SELECT doc_id, page_no, n::BIGINT AS n_bytes FROM e WHERE page_no > 0""")
def container_pages(spark, sf_dir):
    """Pages but the first, by their directory entries: no member is inflated."""
    return kept(spark, sf_dir, "path string, page_no int, n_bytes long").where("page_no > 0").select(doc_id(), F.col("page_no").cast("long").alias("page_no"), "n_bytes")


@query(M.sql() + " SELECT doc_id, page_no, count(*) AS n_blocks, sum(n_chars)::BIGINT AS n_chars FROM blocks WHERE page_no IN (0, 2) GROUP BY 1, 2")
def tiered_read(spark, sf_dir):
    pages = kept(spark, sf_dir, "path string, page_no int, content binary").where("page_no in (0, 2)")
    texts = F.transform(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit('<p id="b[0-9]+">([\\s\\S]*?)</p>\n'), 1), lambda t: F.length(_plain(t)))
    return pages.select(doc_id(), F.col("page_no").cast("long").alias("page_no"), F.size(texts).cast("long").alias("n_blocks"), F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"))


@query("""SELECT doc_id, source AS title, source || ';' || lang AS authors, lang AS language, n_chars::VARCHAR AS said_chars, doc_id % 2 = 0 AS text_segmented, false AS headings_detected FROM documents""")
def container_meta(spark, sf_dir):
    rows = C.meta_rows(kept(spark, sf_dir).where("kind = 'meta'"))
    return rows.select(doc_id(), "title", F.array_join("authors", ";").alias("authors"), "language", F.col("custom")["n_chars"].alias("said_chars"), "text_segmented", "headings_detected")


@query("SELECT doc_id, 'l0' AS layer_id, 'ink' AS name, true AS visible, NULL AS ocr_engine FROM documents UNION ALL SELECT doc_id, 'l1', 'scan', n_chars > 1000, 'ocr' FROM documents")
def container_layers(spark, sf_dir):
    return C.layer_rows(kept(spark, sf_dir).where("kind = 'meta'")).select(doc_id(), "layer_id", "name", "visible", "ocr_engine")


@query(M.sql("outline") + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, entry) - 1 AS pre, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY entry) AS k, count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM outline)
SELECT doc_id, pre::BIGINT AS entry, (CASE WHEN k = 1 THEN pre + n - 1 ELSE pre END)::BIGINT AS last, (CASE WHEN k = 1 THEN -1 ELSE pre - 1 END)::BIGINT AS parent, title, CASE WHEN entry % 4 > 0 THEN page_no END AS page_no, y::DOUBLE AS y FROM o""")
def json_members(spark, sf_dir):
    rows = C.outline_rows(kept(spark, sf_dir).where("kind = 'outline'"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(doc_id(), long("entry"), long("last"), long("parent"), "title", long("page_no"), "y")


@query(M.sql("nodes") + """, n AS (SELECT doc_id, node, ref_page, ref, type, row_number() OVER (PARTITION BY doc_id ORDER BY ref_page, node) AS i, dense_rank() OVER (PARTITION BY doc_id ORDER BY ref_page) AS s FROM nodes WHERE type <> 'DOCUMENT'),
a AS (SELECT doc_id, s, min(i) AS low, max(i) AS high FROM n GROUP BY 1, 2)
SELECT doc_id, i + s AS node, i + s AS last, s - 1 + (SELECT low FROM a WHERE a.doc_id = n.doc_id AND a.s = n.s) AS parent, type, ref_page AS page_no, 'b' || ref AS ref FROM n
UNION ALL SELECT doc_id, low + s - 1, high + s, 0, 'SECTION', NULL, NULL FROM a
UNION ALL SELECT doc_id, 0, max(high + s), -1, 'DOCUMENT', NULL, NULL FROM a GROUP BY 1""")
def container_structures(spark, sf_dir):
    rows = C.structure_rows(kept(spark, sf_dir).where("kind = 'structures'"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(doc_id(), long("node"), long("last"), long("parent"), "type", F.get("refs", F.lit(0))["page_no"].cast("long").alias("page_no"), F.get("refs", F.lit(0))["node"].alias("ref"))


@query(M.sql("notes") + """ SELECT doc_id, page_no, lower(kind) AS type, 'annotation' AS what, NULL AS name, x0::DOUBLE AS x0, y1::DOUBLE AS y1 FROM notes WHERE kind <> 'FIELD'
UNION ALL SELECT doc_id, page_no, 'text', 'field', 'f' || note, x0, y1 FROM notes WHERE kind = 'FIELD'""")
def container_annots(spark, sf_dir):
    own = C.noted_pages(kept(spark, sf_dir, "path string, kind string, content binary").where("kind = 'annots'"))
    # both lists of a page come from one reading of its container
    thing = lambda what, name: lambda x: F.struct(x["type"].alias("type"), F.lit(what).alias("what"), name(x).alias("name"), x["rect"][0].alias("x0"), x["rect"][3].alias("y1"))
    listed = lambda c, what, name: F.coalesce(F.transform(c, thing(what, name)), F.array())
    both = F.concat(listed("annots", "annotation", lambda x: F.lit(None).cast("string")), listed("fields", "field", lambda x: x["name"]))
    return own.select(doc_id(), F.col("page_no").cast("long").alias("page_no"), F.explode(both).alias("t")).select("doc_id", "page_no", "t.*")
