"""Structure recovery over blocks: style levels, headings, continued paragraphs, bookmarks, roles, pictures, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

#: How much larger than the body a display size is, and sizes that are one level.
LARGER, SAME_SIZE = 1.08, 0.6
#: Pages, or lines, on which a heading style recurs; paragraphs of copy that make a text style.
MIN_PAGES, MIN_LINES, COPY_BLOCKS = 2, 3, 2


def style_levels(lines: DataFrame) -> DataFrame:
    """doc_id, size, bold, ink, n_lines, n_pages, is_body, is_title, level (0: no heading) of every style.

    lines: doc_id, page_no, size, bold, n_chars, copy (whether the line is a paragraph of running text).  The styles of a
    document are one group; there are a few dozen.
    """
    top = F.max("size").over(W.partitionBy("doc_id", "page_no"))
    rows = lines.withColumn("tops", F.col("size") >= top - SAME_SIZE)
    styles = rows.groupBy("doc_id", "size", "bold").agg(F.sum("n_chars").alias("ink"), F.count("*").alias("n_lines"), F.collect_set("page_no").alias("pages"), F.min("tops").alias("tops"), F.sum(F.col("copy").cast("long")).alias("copies"))
    body = F.first(F.struct("size", "bold")).over(W.partitionBy("doc_id").orderBy(F.col("ink").desc(), F.col("size").desc(), F.col("bold").desc()))
    s = styles.withColumn("body", body).withColumn("is_body", (F.col("size") == F.col("body.size")) & (F.col("bold") == F.col("body.bold")))
    larger = F.col("size") >= F.col("body.size") * LARGER
    heavier = ~larger & F.col("bold") & ~F.col("body.bold") & (F.abs(F.col("size") - F.col("body.size")) <= SAME_SIZE)
    free = ~F.col("is_body") & (F.col("copies") < COPY_BLOCKS)
    recurs = (F.size("pages") >= MIN_PAGES) | (F.col("n_lines") >= MIN_LINES)
    s = s.withColumn("raised", free & (larger | heavier)).withColumn("head", F.col("raised") & recurs)
    s = s.withColumn("display", free & ~F.col("head") & larger & F.col("tops"))
    shown = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("display"), F.col("pages"))).over(W.partitionBy("doc_id")))))
    s = s.withColumn("magazine", (F.count(F.when(F.col("display"), 1)).over(W.partitionBy("doc_id")) > 1) & (shown >= MIN_LINES))
    heads = F.sort_array(F.collect_list(F.when(F.col("head"), F.struct("size", "bold", "tops"))).over(W.partitionBy("doc_id")), asc=False)
    s = s.withColumn("heads", heads)
    beside = F.coalesce(F.col("magazine") & F.get(F.col("heads"), F.lit(0))["tops"], F.lit(False))
    before = F.when(F.col("magazine") & ~beside, 1).otherwise(0)
    # a level is as wide as SAME_SIZE below its own first style, so the list is folded in order
    none = F.struct(F.lit(float("nan")).alias("size"), F.lit(False).alias("bold"), F.lit(0).alias("level"), F.lit(0).alias("own"))

    def fold(acc, x):
        fresh = F.isnan(acc["size"]) | (F.abs(x["size"] - acc["size"]) > SAME_SIZE) | (x["bold"] != acc["bold"])
        level = acc["level"] + F.when(fresh, 1).otherwise(0)
        own = F.when((x["size"] == F.col("size")) & (x["bold"] == F.col("bold")), level).otherwise(acc["own"])
        return F.struct(F.when(fresh, x["size"].cast("double")).otherwise(acc["size"]).alias("size"), F.when(fresh, x["bold"]).otherwise(acc["bold"]).alias("bold"), level.alias("level"), own.alias("own"))

    level = F.when(F.col("head"), F.aggregate("heads", none, fold)["own"] + before).when(F.col("magazine") & F.col("display"), 1).otherwise(0)
    largest = F.max(F.when(F.col("raised"), F.struct("size", "bold"))).over(W.partitionBy("doc_id"))
    first = F.get(F.col("heads"), F.lit(0))["size"]
    title = ~F.col("magazine") & ~F.col("head") & (F.struct("size", "bold") == largest) & (first.isNull() | (F.col("size") > first + SAME_SIZE))
    return s.select("doc_id", "size", "bold", "ink", "n_lines", F.size("pages").cast("long").alias("n_pages"), "is_body", F.coalesce(title, F.lit(False)).alias("is_title"), level.cast("long").alias("level"))


def headings(blocks: DataFrame, styles: DataFrame, most_lines: int = 2, most_chars: int = 160) -> DataFrame:
    """doc_id, ord, level, title: short blocks with a real word, no running head, in the title's or a heading's style."""
    ok = ~F.col("running") & T.has_word(F.col("text")) & (F.col("n_lines") <= most_lines) & (F.length("text") <= most_chars)
    own = styles.where("is_title or level > 0").select("doc_id", "size", "bold", F.when(F.col("is_title"), 1).otherwise(F.least("level", F.lit(6))).cast("long").alias("level"))
    return blocks.where(ok).join(own, ["doc_id", "size", "bold"]).select("doc_id", "ord", "level", F.col("text").alias("title"))


def measures(lines: DataFrame) -> DataFrame:
    """Of each block: n_lines, own (its widest line), wrapped (its narrowest but for the last), end (its last), lead (how far the first starts right of the second)."""
    own = W.partitionBy("doc_id", "ord")
    rows = lines.withColumn("last", F.max("line").over(own)).withColumn("width", F.col("x1") - F.col("x0"))
    at = lambda n, c: F.max(F.when(F.col("line") == n, F.col(c)))
    return rows.groupBy("doc_id", "ord").agg(F.count("*").alias("n_lines"), F.max("width").alias("own"), F.min(F.when(F.col("line") < F.col("last"), F.col("width"))).alias("wrapped"), F.max(F.when(F.col("line") == F.col("last"), F.col("width"))).alias("end"), (at(0, "x0") - at(1, "x0")).alias("lead"))


#: Percent of the column from which on a line is full, and ragged; of the column in which places agree; of the size that is an indent.
FULL, RAGGED, SLACK, INDENT = 90, 75, 10, 50
#: Lines and letters from which on a block is no label.
COLUMN_LINES, LABEL_LETTERS = 4, 100


def _runs_on(p, c) -> tuple[Column, Column, Column]:
    """Tests of two blocks, given by their columns: is the first cut short and the second its kind; over a page; beside."""
    column = F.greatest(p("own"), c("own"))
    measure = F.when(p("own") * 100 < column * RAGGED, column).otherwise(p("own"))
    full = F.least(measure * FULL / 100, p("wrapped"))
    runs_on = (p("n_lines") >= 2) & (p("end") >= F.greatest(full, measure * RAGGED / 100)) & ((c("n_lines") < 2) | (c("lead") * 100 <= INDENT * F.greatest(F.lit(1), c("size"))))
    alike = (F.abs(c("size") - p("size")) * 2 <= 1) & (column > 0) & runs_on
    over = (F.abs(c("x0") - p("x0")) * 100 <= SLACK * column) | (F.abs((c("x1") - c("x0")) - (p("x1") - p("x0"))) * 100 <= SLACK * column)
    beside = (c("x0") * 100 >= p("x1") * 100 - SLACK * column) & (c("x0") - p("x1") < column) & (c("y0") < p("y1"))
    return F.coalesce(alike & over, F.lit(False)), F.coalesce(alike & beside, F.lit(False)), column


def continued(blocks: DataFrame, measured: DataFrame) -> DataFrame:
    """doc_id, ord, para: blocks in reading order; a block that carries on an earlier one is in its paragraph.

    It does over a page break, in the same column or one as wide, or into the next column of a page: in the same size, if
    the last line before is full and its own first line is not indented.  Labels (a few short lines) that the new page
    has read first are held: the paragraph that the break cut stays open past them for the first block that carries it
    on.  What follows such a block begins anew, on the next page as well.  A block that `interrupts` (a heading) joins
    nothing and closes what is open.

    A paragraph that a page may carry on is open unless the page before ended on such a late block; that one counts only
    if its own page could carry on, so along pages that all end so every second one can.
    """
    rows = blocks.join(measured, ["doc_id", "ord"])
    order = W.partitionBy("doc_id").orderBy("ord")
    page = W.partitionBy("doc_id", "page_no").orderBy("ord")
    before = page.rowsBetween(W.unboundedPreceding, -1)
    names = ("page_no", "size", "x0", "x1", "y1", "n_lines", "own", "wrapped", "end", "interrupts")
    rows = rows.withColumn("p", F.lag(F.struct(*names)).over(order))
    rows = rows.withColumns({"carry": F.first("p").over(page), "k": F.row_number().over(page)})
    c = F.col
    over, _, _ = _runs_on(lambda n: F.col(f"carry.{n}"), c)
    _, beside, _ = _runs_on(lambda n: F.col(f"p.{n}"), c)
    plain = ~c("interrupts")
    rows = rows.withColumns({"sequel": plain & over, "beside": plain & (c("k") > 1) & ~F.coalesce("p.interrupts", F.lit(True)) & beside, "could": F.coalesce(~c("carry.interrupts") & (c("carry.page_no") == c("page_no") - 1), F.lit(False))})
    label = plain & (c("n_lines") < COLUMN_LINES) & (c("n_chars") < LABEL_LETTERS) & ~c("sequel") & ~c("beside")
    rows = rows.withColumn("label", label).withColumn("first_sequel", c("sequel") & F.coalesce(F.min("label").over(before), F.lit(True)))
    # of each page's first block: does the page before end on a late sequel?
    rows = rows.withColumn("late", F.coalesce(F.lag(c("first_sequel") & c("could") & (c("k") > 1)).over(order), F.lit(False)) & (c("k") == 1))
    rows = rows.withColumn("chain", F.sum(((c("k") == 1) & ~(c("late") & c("could"))).cast("long")).over(order))
    link = W.partitionBy("doc_id", "chain").orderBy("ord")
    rows = rows.withColumns({"at": F.sum((c("k") == 1).cast("long")).over(link) - 1, "anchor": F.first("could").over(link)})
    rows = rows.withColumn("open", c("could") & (c("anchor") == (c("at") % 2 == 0)))
    rows = rows.withColumn("open", F.first("open").over(page))
    rows = rows.withColumn("joins", c("open") & c("first_sequel"))
    rows = rows.withColumn("goes", c("joins") | c("beside") & ~F.coalesce(F.lag(c("joins") & (c("k") > 1)).over(order), F.lit(False)))
    rows = rows.withColumn("n", F.sum((~c("goes")).cast("long")).over(order))
    rows = rows.withColumn("before", F.lag("n").over(order)).withColumn("held", F.first("before").over(page))
    return rows.select("doc_id", "ord", F.when(c("joins"), c("held")).otherwise(c("n")).alias("para"))


def heading_text(runs: DataFrame) -> DataFrame:
    """doc_id, ord, title: a block's runs without the marks of notes, digits alone at most 0.8 times its dominant size."""
    size = F.max_by("size", F.struct("n_chars", -F.col("run"))).over(W.partitionBy("doc_id", "ord"))
    kept = runs.withColumn("main", size).where(~(F.col("text").rlike("^[0-9]+$") & (F.col("size") * 10 <= F.col("main") * 8)))
    rows = kept.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("run", "text"))).alias("r"))
    return rows.select("doc_id", "ord", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("title"))


def anchors(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, entry, ord, tier: the block of an entry's page that its title names: exact (1), in part (2), or nearest by y (3).

    Within a tier the nearest top wins, then the first block.  A document whose titles match no text has no anchors.
    """
    want = F.when(T.has_word(F.col("title")), T.line_key(F.col("title"))).otherwise("")
    key = T.line_key(F.col("text"))
    own = blocks.select("doc_id", "page_no", "ord", "y0", key.alias("key"))
    pairs = outline.select("doc_id", "entry", "page_no", "y", want.alias("want")).join(own, ["doc_id", "page_no"])
    named = F.col("want") != ""
    part = F.startswith("key", "want") | F.startswith("want", "key") | F.contains("key", "want")
    tier = F.when(named & (F.col("key") == F.col("want")), 1).when(named & part, 2).otherwise(3)
    best = pairs.groupBy("doc_id", "entry").agg(F.min(F.struct(tier.alias("tier"), F.abs(F.col("y0") - F.col("y")).alias("far"), "ord")).alias("b"))
    sure = F.min("b.tier").over(W.partitionBy("doc_id"))
    return best.withColumn("sure", sure).where("sure < 3").select("doc_id", "entry", F.col("b.ord").alias("ord"), F.col("b.tier").cast("long").alias("tier"))


def aligned_titles(outline: DataFrame, lines: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, entry, line_no, k: up to `most` consecutive lines that together spell a title, the first such place, fewest lines."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    key = T.line_key(F.col("line"))
    rows = lines.withColumn("key", key).withColumns({f"next{i}": F.lead("key", i).over(order) for i in range(1, most)})
    joins = [F.struct(F.lit(k).cast("long").alias("k"), F.concat_ws(" ", "key", *(f"next{i}" for i in range(1, k))).alias("said")) for k in range(1, most + 1)]
    # texts are dealt once, by the window; what they say meets the titles as 96 bits within a document
    keys = lambda s: (F.xxhash64(s).alias("said"), F.hash(s).alias("also"))
    said = rows.select("doc_id", "line_no", F.explode(F.array(*joins)).alias("j")).select("doc_id", "line_no", "j.k", *keys(T.collapse(F.col("j.said"))))
    want = outline.select("doc_id", "entry", T.line_key(F.col("title")).alias("t")).where("t <> ''").select("doc_id", "entry", *keys(F.col("t")))
    return want.join(said, ["doc_id", "said", "also"]).groupBy("doc_id", "entry").agg(F.min(F.struct("line_no", "k")).alias("m")).select("doc_id", "entry", "m.line_no", "m.k")


def outline_policy(has_tags: Column, has_bookmarks: Column, forced: Column) -> Column:
    """Whose headings a document goes by: its tags, its bookmarks, or the heuristic, which an option can force."""
    return F.when(forced, "heuristic").when(has_tags, "tags").when(has_bookmarks, "bookmarks").otherwise("heuristic")


def heading_roles(structures: DataFrame, blocks: DataFrame, priority: tuple[str, ...] = ("default", "pdf", "outline", "heuristic")) -> DataFrame:
    """doc_id, ord, role, level: headings of a document's best structure put on its blocks; a block's first heading wins.

    structures: doc_id, structure, seq, ord, level.
    """
    rank = F.array_position(F.array(*(F.lit(x) for x in priority)), F.col("structure"))
    best = structures.withColumn("rank", rank).where("rank > 0").withColumn("best", F.min("rank").over(W.partitionBy("doc_id"))).where("rank = best")
    first = best.groupBy("doc_id", "ord").agg(F.min(F.struct("seq", "level")).alias("f"))
    return blocks.join(first, ["doc_id", "ord"], "left").select("doc_id", "ord", F.when(F.col("f").isNull(), "P").otherwise(F.concat(F.lit("H"), F.col("f.level").cast("string"))).alias("role"))


def repeated_pictures(pictures: DataFrame, n_pages: DataFrame) -> DataFrame:
    """doc_id, ref, x0, y0, x1, y1, pages: one picture in one place (to 2 units) on max(3, half) of a document's pages is decoration."""
    two = lambda c: (F.floor(F.col(c) / 2 + 0.5) * 2).cast("long").alias(c)
    held = pictures.groupBy("doc_id", "ref", *(two(c) for c in ("x0", "y0", "x1", "y1"))).agg(F.countDistinct("page_no").alias("pages"))
    return held.join(n_pages, "doc_id").where(F.col("pages") >= F.greatest(F.lit(3), F.expr("(n_pages + 1) div 2"))).drop("n_pages")


def tiles(pictures: DataFrame, least: int = 3) -> DataFrame:
    """Pictures without the repeats of tiles: bytes that stand `least` times or more on a page are shown once."""
    own = W.partitionBy("doc_id", "page_no", "sha")
    return pictures.withColumns({"n": F.count("*").over(own), "r": F.row_number().over(own.orderBy("ord"))}).where(f"n < {least} or r = 1").drop("n", "r")


def shown_pictures(pictures: DataFrame, decoration: DataFrame, texts: DataFrame, side: int = 24, page_area: int = 1_000_000) -> DataFrame:
    """Pictures of some size that are neither running nor decoration nor a background (half the page with text over it)."""
    two = lambda c: (F.floor(F.col(c) / 2 + 0.5) * 2).cast("long").alias(f"_{c}")
    sides = ("x0", "y0", "x1", "y1")
    big = pictures.where((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side) & ~F.col("running"))
    held = decoration.select("doc_id", "ref", *(F.col(c).alias(f"_{c}") for c in sides))
    plain = big.select("*", *(two(c) for c in sides)).join(held, ["doc_id", "ref", *(f"_{c}" for c in sides)], "left_anti").drop(*(f"_{c}" for c in sides))
    over = texts.select("doc_id", "page_no", F.col("z").alias("tz"), *(F.col(c).alias(f"t{c}") for c in sides))
    meets = (F.col("tx0") < F.col("x1")) & (F.col("x0") < F.col("tx1")) & (F.col("ty0") < F.col("y1")) & (F.col("y0") < F.col("ty1")) & (F.col("tz") > F.col("z"))
    wide = plain.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 2 >= page_area)
    behind = wide.join(over, ["doc_id", "page_no"]).where(meets).select("doc_id", "page_no", "ord").distinct()
    return plain.join(behind, ["doc_id", "page_no", "ord"], "left_anti")


def placed_figures(figures: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, fig, after: the last entry that starts before a figure in reading order, null where the figure leads.

    figures: doc_id, fig, at; entries: doc_id, entry, at.  One pass over both in order, no pairs.
    """
    both = figures.select("doc_id", "at", F.col("fig"), F.lit(None).cast("long").alias("entry")).unionByName(entries.select("doc_id", "at", F.lit(None).cast("long").alias("fig"), "entry"))
    order = W.partitionBy("doc_id").orderBy("at", F.col("fig").isNull().cast("int")).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("after", F.last("entry", ignorenulls=True).over(order)).where("fig is not null").select("doc_id", "fig", "after")


def grounded(replies: DataFrame, blocks: DataFrame, least_percent: int = 50) -> DataFrame:
    """doc_id, ord, label: labels of a model's reply that name blocks which exist, of documents where they reach enough blocks.

    replies: doc_id, ord, label (the first of several for a block holds).
    """
    known = replies.join(blocks.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").groupBy("doc_id", "ord").agg(F.min("label").alias("label"))
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return known.withColumn("hit", F.count("*").over(W.partitionBy("doc_id"))).join(total, "doc_id").where(F.col("hit") * 100 >= F.col("n") * least_percent).select("doc_id", "ord", "label")


def refine_windows(blocks: DataFrame, most_pages: int = 4, most_blocks: int = 80) -> DataFrame:
    """doc_id, window, first_page, last_page, n_blocks: a document is asked about as a whole, or page by page from so many pages or blocks on."""
    pages = blocks.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    split = (F.count("*").over(W.partitionBy("doc_id")) >= most_pages) | (F.sum("n").over(W.partitionBy("doc_id")) >= most_blocks)
    return pages.withColumn("window", F.when(split, F.col("page_no")).otherwise(0)).groupBy("doc_id", "window").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.sum("n").alias("n_blocks"))


def inline_flow(siblings: DataFrame) -> DataFrame:
    """doc_id, parent, flow, first, n: runs of inline nodes between block nodes of one parent, each run a paragraph."""
    order = W.partitionBy("doc_id", "parent").orderBy("node")
    rows = siblings.withColumn("flow", F.sum((~F.col("inline")).cast("long")).over(order)).where("inline")
    return rows.groupBy("doc_id", "parent", "flow").agg(F.min("node").alias("first"), F.count("*").alias("n"))


def stamped(nodes: DataFrame) -> DataFrame:
    """Adds `id` to nodes without one: per page and kind, numbers after the largest in use, in order; ids are never changed.

    nodes: doc_id, page_no, kind (a letter), ord, id (or null).
    """
    own = W.partitionBy("doc_id", "page_no", "kind")
    used = F.coalesce(F.max(F.regexp_extract("id", "^[a-z]([0-9]+)$", 1).try_cast("long")).over(own), F.lit(0))
    rank = F.row_number().over(W.partitionBy("doc_id", "page_no", "kind", F.col("id").isNull()).orderBy("ord"))
    return nodes.withColumn("id", F.coalesce("id", F.concat("kind", (used + rank).cast("string"))))


def hard_breaks(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, line, block: lines in order; size (by 1.2), weight or axis that change begin a block, but a title's next line.

    lines: doc_id, page_no, line, size, bold, axis, y0, y1, x0, x1, body.
    """
    order = W.partitionBy("doc_id", "page_no").orderBy("line")
    names = ("size", "bold", "axis", "y1", "x0", "x1")
    rows = lines.withColumns({f"p_{c}": F.lag(c).over(order) for c in names})
    larger, smaller = F.greatest("size", "p_size"), F.least("size", "p_size")
    alike = (larger * 10 < smaller * 12) & (F.col("bold") == F.col("p_bold")) & (F.col("axis") == F.col("p_axis"))
    title = alike & (F.col("size") * 10 >= F.col("body") * 12) & ((F.col("y0") - F.col("p_y1")) * 2 <= F.col("size") * 3) & (F.col("x0") < F.col("p_x1")) & (F.col("p_x0") < F.col("x1"))
    near = F.col("y0") - F.col("p_y1") <= F.col("size")
    fresh = ~F.coalesce(title | alike & near, F.lit(False))
    return rows.withColumn("fresh", fresh.cast("long")).select("doc_id", "page_no", "line", F.sum("fresh").over(order).alias("block"))


def dust_hosts(blocks: DataFrame, grow: float = 0.5, larger: float = 1.05) -> DataFrame:
    """doc_id, ord, host: tiny blocks and the smallest block around them (grown by half their size) that is no smaller in type."""
    sides = ("x0", "y0", "x1", "y1", "size", "ord", "n_chars")
    tiny = blocks.where("n_chars <= 2 and n_chars > 0")
    hosts = blocks.where("n_chars > 2").select("doc_id", "page_no", *(F.col(c).alias(f"h_{c}") for c in sides))
    h, c, room = (lambda n: F.col(f"h_{n}")), F.col, F.col("size") * grow
    inside = (c("x0") >= h("x0") - room) & (c("x1") <= h("x1") + room) & (c("y0") >= h("y0") - room) & (c("y1") <= h("y1") + room) & (c("size") <= h("size") * larger)
    area = (h("x1") - h("x0")) * (h("y1") - h("y0"))
    return tiny.join(hosts, ["doc_id", "page_no"]).where(inside).groupBy("doc_id", "ord").agg(F.min_by("h_ord", F.struct(area, "h_ord")).alias("host"))


def tree_paths(spark, nodes: DataFrame, most: int = 256) -> DataFrame:
    """doc_id, node, depth, path of every node that hangs on a root; deeper than `most` is refused.

    One join of all open nodes a level.  Spark's own guard against endless recursion counts rows, so it is lifted: the
    levels are the bound here.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    nodes.select("doc_id", "node", "parent").createOrReplaceTempView("quire_tree_nodes")
    return spark.sql(f"""
        WITH RECURSIVE walk(doc_id, node, depth, path) MAX RECURSION LEVEL {most} AS (
          SELECT doc_id, node, 0L, CAST(node AS STRING) FROM quire_tree_nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.doc_id, n.node, w.depth + 1, concat(w.path, '/', CAST(n.node AS STRING)) FROM walk w JOIN quire_tree_nodes n ON n.doc_id = w.doc_id AND n.parent = w.node)
        SELECT doc_id, node, depth, path FROM walk""")
