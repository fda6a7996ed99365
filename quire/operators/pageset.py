"""Page sets: their grammar, and what a new order of pages does to everything that names a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: pages that a set may hold however short the document is; else twice the document.
LEAST_CEILING = 1000


def slots(specs: DataFrame) -> DataFrame:
    """doc_id, slot, page_no (null: a blank page) of page sets such as "1,4-6,2,+"; error where a set is refused.

    specs: doc_id, spec, n_pages.  Pages are 1-based in a spec and 0-based in the result; "3-" is open, "6-1" descends.
    A refused set has one row, with slot -1 and the reason.
    """
    parts = F.filter(F.transform(F.split("spec", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = specs.withColumn("parts", parts)
    whole = r"^[0-9]+$|^[0-9]+ *- *[0-9]*$|^\+$"
    number = lambda x, n: F.regexp_extract(x, r"^([0-9]+)(?: *- *([0-9]*))?$", n)

    def span(x):
        low = number(x, 1).try_cast("long")
        high = F.when(~F.contains(x, F.lit("-")), low).when(number(x, 2) == "", F.col("n_pages")).otherwise(number(x, 2).try_cast("long"))
        return F.struct(x.alias("x"), low.alias("low"), high.alias("high"))

    rows = rows.withColumn("spans", F.transform("parts", span))
    bad = F.exists("spans", lambda s: ~s["x"].rlike(whole))
    off = F.exists("spans", lambda s: (s["x"] != "+") & ((s["low"] < 1) | (s["low"] > F.col("n_pages")) | (s["high"] < 1) | (s["high"] > F.col("n_pages")) | s["low"].isNull() | s["high"].isNull()))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + F.when(s["x"] == "+", 1).otherwise(F.abs(s["high"] - s["low"]) + 1))
    error = F.when(bad, "not a page").when(off, "no such page").when(total > F.greatest(F.lit(LEAST_CEILING), 2 * F.col("n_pages")), "too many pages")
    rows = rows.withColumn("error", error)
    listed = F.transform("spans", lambda s: F.when(s["x"] == "+", F.array(F.lit(None).cast("long"))).otherwise(F.sequence(s["low"] - 1, s["high"] - 1)))
    pages = F.when(F.col("error").isNull(), F.flatten(listed))
    good = rows.where("error is null").select("doc_id", F.posexplode(pages).alias("slot", "page_no")).select("doc_id", F.col("slot").cast("long").alias("slot"), "page_no", F.lit(None).cast("string").alias("error"))
    refused = rows.where("error is not null").select("doc_id", F.lit(-1).cast("long").alias("slot"), F.lit(None).cast("long").alias("page_no"), "error")
    return good.unionByName(refused)


def first_places(slots_: DataFrame) -> DataFrame:
    """doc_id, page_no, new_page: where a page stands first in the set."""
    return slots_.where("page_no is not null").groupBy("doc_id", "page_no").agg(F.min("slot").alias("new_page"))


def moved_refs(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, node, new_page, ref of refs that still have their page; refs to dropped pages go."""
    return nodes.join(places, (nodes["doc_id"] == places["doc_id"]) & (nodes["ref_page"] == places["page_no"])).select(nodes["doc_id"], "node", "new_page", "ref")


def moved_outline(outline: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, entry, title, new_page, y: an entry whose page is gone keeps its title and loses its destination."""
    rows = outline.join(places, ["doc_id", "page_no"], "left")
    return rows.select("doc_id", "entry", "title", "new_page", F.when(F.col("new_page").isNotNull(), F.col("y")).alias("y"))


def sibling_order(paths: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, parent, node, place: siblings by the first page of their subtrees, stable, those without a page last.

    paths: doc_id, node, parent, path (nodes from the root, parted by slashes); refs: doc_id, node, new_page.
    """
    above = paths.select("doc_id", "node", F.explode(F.split("path", "/")).alias("up")).select("doc_id", "node", F.col("up").cast("long").alias("up"))
    first = above.join(refs, ["doc_id", "node"]).groupBy("doc_id", F.col("up").alias("node")).agg(F.min("new_page").alias("first"))
    rows = paths.where("parent is not null").join(first, ["doc_id", "node"], "left")
    order = W.partitionBy("doc_id", "parent").orderBy(F.col("first").asc_nulls_last(), "node")
    return rows.select("doc_id", "parent", "node", F.row_number().over(order).cast("long").alias("place"))


def zones(specs: DataFrame) -> DataFrame:
    """doc_id, page_no, x0, y0, x1, y1 of zones "page:x,y,w,h;..." or of a JSON list of {page, x, y, w, h}; "audit" has none."""
    given = F.trim("spec")
    plain = F.filter(F.transform(F.split(given, ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9]+:[-0-9.]+,[-0-9.]+,[-0-9.]+,[-0-9.]+$"))
    cell = lambda x, n: F.split(F.split(x, ":")[1], ",")[n].cast("double")
    listed = F.transform(plain, lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("page"), cell(x, 0).alias("x"), cell(x, 1).alias("y"), cell(x, 2).alias("w"), cell(x, 3).alias("h")))
    json = F.from_json(given, "array<struct<page:bigint,x:double,y:double,w:double,h:double>>")
    both = F.when(given == "audit", F.array().cast("array<struct<page:bigint,x:double,y:double,w:double,h:double>>")).when(F.startswith(given, F.lit("[")), json).otherwise(listed)
    rows = specs.select("doc_id", F.explode(both).alias("z"))
    return rows.select("doc_id", F.col("z.page").alias("page_no"), F.col("z.x").alias("x0"), F.col("z.y").alias("y0"), (F.col("z.x") + F.col("z.w")).alias("x1"), (F.col("z.y") + F.col("z.h")).alias("y1"))
