"""Sinks: documents as DocTags, HTML, Markdown fragments, chapters, JSON.  One row a document, text in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.tables import tagless

#: Letters from which on a chapter stands by itself, and what a figure weighs.
MIN_CHAPTER = 400


def assembled(parts: DataFrame, order: str, part: str, name: str, between: str = "") -> DataFrame:
    """doc_id, name: the parts of a document end to end."""
    rows = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, part))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x[part]), between).alias(name))


def loc(box: tuple[str, ...], grid: int = 500, whole: int = 1000) -> Column:
    """<loc_> tags of a box."""
    cell = lambda c: F.least(F.lit(grid), F.greatest(F.lit(0), F.floor(F.col(c) * grid / whole + 0.5))).cast("string")
    return F.concat(*(F.concat(F.lit("<loc_"), cell(c), F.lit(">")) for c in box))


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """The blocks with otsl, table_markdown and table_html of those that are tables; a table without cells has none.

    tables: doc_id, tbl (the block's ord), otsl, markdown, html.
    """
    own = tables.select("doc_id", F.col("tbl").alias("ord"), "otsl", F.col("markdown").alias("table_markdown"), F.col("html").alias("table_html"))
    return blocks.join(own, ["doc_id", "ord"], "left")


def doctags(blocks: DataFrame, grid: int = 500) -> DataFrame:
    """doc_id, doctags.  blocks: doc_id, ord, page_no, x0, y0, x1, y1, type, level, text, otsl.

    A table is a block of its grid's tokens; the caption after it stands within.
    """
    order = W.partitionBy("doc_id").orderBy("ord")
    tag = F.when(F.col("type") == "HEADING", F.concat(F.lit("section_header_level_"), F.col("level").cast("string"))).when(F.col("type") == "ITEM", "list_item").when(F.col("type") == "FIGURE", "picture").otherwise("text")
    said = tagless(F.col("text"))
    said = F.when(F.col("type") == "ITEM", T.strip_marker(said)).otherwise(said)
    turn = F.when(F.lag("page_no").over(order) != F.col("page_no"), "<page_break>\n").otherwise("")
    table, caption = F.col("type") == "TABLE", F.col("type") == "CAPTION"
    ends = F.lit("</otsl>\n")
    inner = caption & F.coalesce(F.lag("type").over(order) == "TABLE", F.lit(False))
    held = F.coalesce(F.lead("type").over(order) == "CAPTION", F.lit(False))
    place = loc(("x0", "y0", "x1", "y1"), grid)
    part = (
        F.when(table, F.concat(turn, F.lit("<otsl>"), place, F.lit("\n"), F.coalesce("otsl", F.lit("")), F.when(held, "").otherwise(ends)))
        .when(inner, F.concat(F.lit("<caption>"), place, said, F.lit("</caption>\n"), ends))
        .otherwise(F.concat(turn, F.lit("<"), tag, F.lit(">"), place, F.when(F.col("type") == "FIGURE", "").otherwise(said), F.lit("</"), tag, F.lit(">\n")))
    )
    out = assembled(blocks.select("doc_id", "ord", part.alias("part")), "ord", "part", "doctags")
    return out.withColumn("doctags", F.concat(F.lit("<doctag>\n"), "doctags", F.lit("</doctag>\n")))


def html(blocks: DataFrame) -> DataFrame:
    """doc_id, html: headings, paragraphs, quotes, code, lists (neighbouring items are one list), tables and figures."""
    order = W.partitionBy("doc_id").orderBy("ord")
    said = T.escape_xml(F.col("text"))
    item = F.col("type") == "ITEM"
    opens = item & ~F.coalesce(F.lag("type").over(order) == "ITEM", F.lit(False))
    closes = item & ~F.coalesce(F.lead("type").over(order) == "ITEM", F.lit(False))
    level = F.col("level").cast("string")
    around = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>\n"))
    part = (
        F.when(F.col("type") == "HEADING", F.concat(F.lit("<h"), level, F.lit(">"), said, F.lit("</h"), level, F.lit(">\n")))
        .when(item, F.concat(F.when(opens, "<ul>\n").otherwise(""), around("li", T.escape_xml(T.strip_marker(F.col("text")))), F.when(closes, "</ul>\n").otherwise("")))
        .when(F.col("type") == "FIGURE", F.lit("<figure></figure>\n"))
        .when(F.col("type") == "TABLE", F.coalesce("table_html", F.lit("<table>\n</table>\n")))
        .when(F.col("type") == "QUOTE", around("blockquote", said))
        .when(F.col("type") == "CODE", F.concat(F.lit("<pre><code>"), said, F.lit("</code></pre>\n")))
        .otherwise(around("p", said))
    )
    return assembled(blocks.select("doc_id", "ord", part.alias("part")), "ord", "part", "html")


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown by type: headings by level, quotes and notes, captions, code, items, tables, figures, paragraphs."""
    said = F.col("text")
    quoted = F.concat(F.lit("> "), F.replace(said, F.lit("\n"), F.lit("\n> ")))
    part = (
        F.when(F.col("type") == "FIGURE", F.lit("<!-- image -->"))
        .when(F.col("type") == "TABLE", F.col("table_markdown"))
        .when(said == "", F.lit(None).cast("string"))
        .when(F.col("type") == "HEADING", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), said))
        .when(F.col("type").isin("QUOTE", "NOTE"), quoted)
        .when(F.col("type") == "CAPTION", F.concat(F.lit("*"), said, F.lit("*")))
        .when(F.col("type") == "CODE", F.concat(F.lit("```\n"), said, F.lit("\n```")))
        .when(F.col("type") == "ITEM", F.concat(F.lit("- "), T.strip_marker(said)))
        .otherwise(said)
    )
    rows = blocks.select("doc_id", "ord", part.alias("part")).where("part is not null")
    return assembled(rows, "ord", "part", "markdown", "\n\n")


def chapters(units: DataFrame, least: int = MIN_CHAPTER) -> DataFrame:
    """doc_id, chapter, first, last, weight: units cut at the highest heading level that gives two chapters or more.

    units: doc_id, ord, level (null: no heading), weight.  Chapters lighter than `least` join the next one, the last
    the one before.  The merge is a fold over a document's chapters.
    """
    levels = units.where("level is not null").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    seen = F.sum("n").over(W.partitionBy("doc_id").orderBy("level"))
    cut = levels.withColumn("seen", seen).where("seen >= 2").groupBy("doc_id").agg(F.min("level").alias("cut"))
    order = W.partitionBy("doc_id").orderBy("ord")
    rows = units.join(cut, "doc_id", "left").withColumn("starts", ((F.col("level") <= F.coalesce("cut", F.lit(6))) & (F.row_number().over(order) > 1)).cast("long"))
    rows = rows.withColumn("part", F.sum(F.coalesce("starts", F.lit(0))).over(order))
    parts = rows.groupBy("doc_id", "part").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum("weight").alias("weight"))
    own = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "first", "last", "weight"))).alias("p"))
    chapter = "struct<first:bigint,last:bigint,weight:bigint>"
    start = F.struct(F.array().cast(f"array<{chapter}>").alias("done"), F.lit(None).cast(chapter).alias("open"))

    def step(acc, x):
        joined = F.struct(F.coalesce(acc["open"]["first"], x["first"]).alias("first"), x["last"].alias("last"), (F.coalesce(acc["open"]["weight"], F.lit(0)) + x["weight"]).cast("long").alias("weight"))
        heavy = joined["weight"] >= least
        return F.struct(F.when(heavy, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(~heavy, joined).alias("open"))

    def finish(acc):
        last = F.element_at(acc["done"], -1)
        merged = F.struct(last["first"].alias("first"), acc["open"]["last"].alias("last"), (last["weight"] + acc["open"]["weight"]).alias("weight"))
        with_last = F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(merged))
        return F.when(acc["open"].isNull(), acc["done"]).when(F.size(acc["done"]) == 0, F.array(acc["open"])).otherwise(with_last)

    folded = own.select("doc_id", F.aggregate("p", start, step, finish).alias("c"))
    rows = folded.select("doc_id", F.posexplode("c").alias("i", "c"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("chapter"), "c.first", "c.last", "c.weight")


def page_json(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, json: the blocks of a page, boxes to one decimal."""
    one = lambda c: F.round(F.col(c).cast("double"), 1).alias(c)
    rows = blocks.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("ord", "type", *(one(c) for c in ("x0", "y0", "x1", "y1"))))).alias("blocks"))
    return rows.select("doc_id", "page_no", F.to_json(F.struct("blocks")).alias("json"))


def findings_json(findings: DataFrame) -> DataFrame:
    """doc_id, json: the findings of an audit."""
    rows = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "ord", "run", "box", "kind"))).alias("findings"))
    return rows.select("doc_id", F.to_json(F.struct("findings")).alias("json"))
