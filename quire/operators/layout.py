"""Layout and structure over lines: styles, headings, furniture, paragraphs, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T


def line_bounds(lines: DataFrame) -> DataFrame:
    """Box of each line: runs reach from a fifth of the size under the baseline, one size high."""
    return lines.withColumns({"x0": F.lit(72.0), "x1": 72.0 + 5.0 * F.length("line") + 0.5 * F.col("size"), "y0": F.col("y") - 0.2 * F.col("size"), "y1": F.col("y") + 0.8 * F.col("size")})


def page_boxes(lines: DataFrame) -> DataFrame:
    """Union of the boxes of the lines that have text, for each page."""
    boxes = line_bounds(lines.where("line <> ''"))
    return boxes.groupBy("doc_id", "page_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def grid_boxes(lines: DataFrame, grid: int = 1000, width: float = 612.0, height: float = 842.0, others: tuple[str, ...] = ()) -> DataFrame:
    """Line boxes, with other columns, on a grid of 0..grid with the origin at the top left."""
    cell = lambda v, whole: F.least(F.lit(grid), F.greatest(F.lit(0), F.floor(v / whole * grid + 0.5))).cast("long")
    b = line_bounds(lines)
    return b.select("doc_id", "line_no", *others, cell(F.col("x0"), width).alias("gx0"), cell(height - F.col("y1"), height).alias("gy0"), cell(F.col("x1"), width).alias("gx1"), cell(height - F.col("y0"), height).alias("gy1"))


def font_profile(lines: DataFrame) -> DataFrame:
    """doc_id, style, ink, n_lines, n_pages, is_body: ink is letters set; the body style has the most, the larger on ties."""
    styles = lines.groupBy("doc_id", T.half_points(F.col("size")).alias("style")).agg(F.sum(F.length("line")).alias("ink"), F.count("*").alias("n_lines"), F.countDistinct("page_no").alias("n_pages"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("ink").desc(), F.col("style").desc()))
    return styles.withColumn("is_body", first == 1)


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines set at 1.08 times the body or more, with a real word and at most 160 characters."""
    body = font_profile(lines).where("is_body").select("doc_id", F.col("style").alias("body"))
    ok = (F.col("size") >= 1.08 * F.col("body")) & T.has_word(F.col("line")) & (F.length("line") <= 160)
    return lines.join(body, "doc_id").where(ok).select("doc_id", "line_no", F.col("line").alias("title"))


def heading_parents(headings: DataFrame, *others, levels: int = 6) -> DataFrame:
    """doc_id, ord, level, parent and others: the nearest earlier heading of a smaller level, null at the top.

    headings: doc_id, ord, level from 1 to `levels`; a deeper one counts as `levels`, and so is no parent of another.
    """
    before = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    last = [F.when(F.col("level") > lv, F.last(F.when(F.col("level") == lv, F.col("ord")), ignorenulls=True).over(before)) for lv in range(1, levels)]
    return headings.select("doc_id", "ord", "level", F.greatest(*last).alias("parent"), *others)


def level_reconcile(blocks: DataFrame) -> DataFrame:
    """doc_id, size_pct, level: sizes rounded to 5, ranked downwards without gaps, at most 6."""
    bucket = (F.floor(F.col("size_pct") / 5 + 0.5) * 5).alias("bucket")
    rank = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("bucket").desc()))
    return blocks.select("*", bucket).withColumn("level", F.least(rank, F.lit(6)).cast("long"))


def similar_lines(key, other, gap):
    """Score of two line keys `gap` pages apart: 1 if they count the pages (one number advances by gap, the others stay), else their similarity."""
    # most lines have no number, and none is looked for a second time
    same_shape = T.has_number(key) & (T.number_shape(key) == T.number_shape(other))
    steps = F.zip_with(T.numbers(key), T.numbers(other), lambda a, b: F.try_subtract(b.try_cast("long"), a.try_cast("long")))
    counting = same_shape & (F.size(F.filter(steps, lambda s: s == gap)) == 1) & (F.size(F.filter(steps, lambda s: s == 0)) == F.size(steps) - 1)
    return F.when(F.coalesce(counting, F.lit(False)), 1.0).otherwise(T.similarity(key, other))


def edge_strength(ranked: DataFrame, edges: dict[str, str]) -> DataFrame:
    """Adds, for each of the depths, the strength of each line as the one that is that many lines from its edge of the page: depth -> name.

    The larger of two means: over the pages two before and two after, and over the pages one before and one after.  A
    page without a line at this depth counts as 0, one that the document has not is left out.  Two lines that meet at
    more than one depth are compared once.
    """
    key, page = F.col("key"), F.col("page_no")
    rows, seen = ranked.withColumn("_line", F.struct("slot", "key")), []
    order = {depth: W.partitionBy("doc_id", depth).orderBy("page_no") for depth in edges}
    for depth, own in order.items():
        # the line `gap` pages on is among the next `gap` rows
        at = lambda gap, row: F.when(F.lead(page, row).over(own) == page + gap, F.lead("_line", row).over(own))  # noqa: E731, B023
        rows = rows.withColumns({f"_{depth}1": at(1, 1), f"_{depth}2": F.coalesce(at(2, 1), at(2, 2))})
    for depth in edges:

        def score(gap):
            other, known = F.col(f"_{depth}{gap}"), F.lit(None).cast("double")
            for d in seen:
                known = F.coalesce(known, F.when(other["slot"] == F.col(f"_{d}{gap}")["slot"], F.col(f"_on_{d}{gap}")))
            return F.coalesce(known, similar_lines(F.when(known.isNull(), key), other["key"], gap), F.lit(0.0))

        rows = rows.withColumns({f"_on_{depth}{gap}": score(gap) for gap in (1, 2)})
        seen.append(depth)
    # what comes from Python has lost its place by document; scores are dealt once for both depths, without the texts
    rows = rows.drop("_line", *(f"_{depth}{gap}" for depth in edges for gap in (1, 2))).repartition("doc_id")
    for depth, own in order.items():
        on = lambda gap: F.col(f"_on_{depth}{gap}")  # noqa: E731, B023
        back = lambda gap, row: F.when(F.lag(page, row).over(own) == page - gap, F.lag(on(gap), row).over(own))  # noqa: E731, B023
        rows = rows.withColumns({"_back1": F.coalesce(back(1, 1), F.lit(0.0)), "_back2": F.coalesce(back(2, 1), back(2, 2), F.lit(0.0))})

        def mean(gap):
            n = (page >= gap).cast("int") + (page + gap < F.col("n_pages")).cast("int")
            return F.when(n > 0, (on(gap) + F.col(f"_back{gap}")) / n).otherwise(0.0)

        rows = rows.withColumn(edges[depth], F.round(F.greatest(mean(1), mean(2)), 6)).drop("_back1", "_back2")
    return rows.drop(*(f"_on_{depth}{gap}" for depth in edges for gap in (1, 2)))


def furniture(lines: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, page_no, slot, strength, is_header, foot_strength, is_footer of every line with text, in documents of three pages or more.

    Lines are aligned by their place from the top of the page for heads, from its bottom for feet.  A run goes inward
    from its edge over all lines of the page, to the first one that is weak, that lies more than two line sizes from the
    line before it, or that is set at more than 1.25 times the document's median size.  Feet stop at the head.
    """
    text = lines.select("doc_id", "page_no", "slot", "size", "y", T.line_key(F.col("line")).alias("key"))
    pages = text.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"), T.upper_median(F.collect_list(F.when(F.col("key") != "", F.col("size")))).alias("body")).where("n_pages >= 3")
    down, up = (W.partitionBy("doc_id", "page_no").orderBy(o) for o in (F.col("slot"), F.col("slot").desc()))
    # a document's lines are dealt once: every window below is of one document
    ranked = text.where("key <> ''").repartition("doc_id").join(pages, "doc_id").withColumns({"top": F.row_number().over(down), "foot": F.row_number().over(up)})
    scored = edge_strength(ranked, {"top": "strength", "foot": "foot_strength"})

    def run(strength, order):
        near = F.coalesce(F.abs(F.lag("y").over(order) - F.col("y")) <= 2 * F.lag("size").over(order), F.lit(True))
        good = (F.col(strength) >= least) & near & (F.col("size") <= 1.25 * F.col("body"))
        return good.cast("int")

    good = scored.withColumns({"_head": run("strength", down), "_foot": run("foot_strength", up)})
    marked = good.withColumns({"is_header": F.min("_head").over(down) == 1, "is_footer": F.min("_foot").over(up) == 1})
    return marked.select("doc_id", "page_no", "slot", "strength", "is_header", "foot_strength", (F.col("is_footer") & ~F.col("is_header")).alias("is_footer"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Islands of lines of one paragraph: doc_id, island, first_line, n_lines, n_words."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("fresh", (F.col("para_no") != F.lag("para_no", 1, -1).over(order)).cast("long"))
    return marked.withColumn("island", F.sum("fresh").over(order)).groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"))


def repeated_elements(lines: DataFrame) -> DataFrame:
    """Lines that recur on max(3, half of the pages) pages of their document: doc_id, line, n_pages."""
    pages = lines.groupBy("doc_id").agg((F.max("page_no") + 1).alias("pages"))
    held = lines.where("line <> ''").groupBy("doc_id", "line").agg(F.countDistinct("page_no").alias("n_pages"))
    return held.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2))).select("doc_id", "line", "n_pages")


def gap_above(lines: DataFrame) -> DataFrame:
    """Grid distance from a paragraph's box to the nearest one above it on its page that overlaps it sideways, else -1.

    A page's boxes meet in one array; a page holds some dozens.
    """
    boxes = grid_boxes(lines, others=("page_no", "para_no")).groupBy("doc_id", "page_no", "para_no").agg(F.min("gx0").alias("x0"), F.max("gx1").alias("x1"), F.min("gy0").alias("y0"), F.max("gy1").alias("y1"))
    pages = boxes.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("para_no", "x0", "x1", "y0", "y1")).alias("b"))
    over = lambda o: F.array_max(F.transform(F.filter("b", lambda u: (u["y0"] < o["y0"]) & (u["x0"] < o["x1"]) & (o["x0"] < u["x1"])), lambda u: u["y1"]))
    gaps = pages.select("doc_id", "page_no", F.explode(F.transform("b", lambda o: F.struct(o["para_no"].alias("para_no"), (o["y0"] - over(o)).alias("gap")))).alias("g"))
    return gaps.select("doc_id", "page_no", "g.para_no", F.coalesce("g.gap", F.lit(-1)).cast("long").alias("gap"))
