"""Signals of blocks: dominant runs, column bands, places in a column, backgrounds, alignment, profiles.

Blocks carry boxes on the page grid.  Every operator groups by document or page; a page's blocks are the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

PAGE = ["doc_id", "page_no"]
BLOCK = ["doc_id", "ord"]
#: Blocks wider than this (of 1000) shape no column, and gaps from this on part columns.
BAND_WIDTH, BAND_GAP = 620, 28
#: Percent of a block that its background covers at least, and of the page at most.
COVERED, PAGE_SHARE = 70, 88
#: Fixed value: percent of a column's width within which edges are aligned.
EDGE = 6


def dominant_runs(runs: DataFrame) -> DataFrame:
    """doc_id, ord, size, family, n_chars, bold_chars: style of a block's longest run (the first of equals), letters by weight."""
    longest = F.max_by(F.struct("size", "family"), F.struct("n_chars", -F.col("run")))
    own = runs.groupBy(*BLOCK).agg(longest.alias("s"), F.sum("n_chars").alias("n_chars"), F.sum(F.when(F.col("bold"), F.col("n_chars")).otherwise(0)).alias("bold_chars"))
    return own.select(*BLOCK, "s.size", "s.family", "n_chars", "bold_chars")


def line_styles(runs: DataFrame) -> DataFrame:
    """doc_id, ord, style, bold: the size that most letters of a block have (the larger of equals); bold from 60 % on."""
    by_size = runs.groupBy(*BLOCK, T.half_points(F.col("size").cast("double")).alias("style")).agg(F.sum("n_chars").alias("ink"), F.sum(F.when(F.col("bold"), F.col("n_chars")).otherwise(0)).alias("heavy"))
    own = by_size.groupBy(*BLOCK).agg(F.max_by("style", F.struct("ink", "style")).alias("style"), (F.sum("heavy") * 100 >= F.sum("ink") * 60).alias("bold"))
    return own


def column_bands(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, band, bx0, bx1: what narrow blocks cover of the page's width, cut at wide gaps."""
    narrow = blocks.where((F.col("x1") - F.col("x0") <= BAND_WIDTH) & (F.col("x1") > F.col("x0")))
    order = W.partitionBy(*PAGE).orderBy("x0", "x1", "ord")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = narrow.withColumn("fresh", F.when(F.col("x0") - reach < BAND_GAP, 0).otherwise(1)).withColumn("band", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*PAGE, "band").agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"))


def column_places(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """doc_id, ord, band, indent, width: a block's band is that of its centre; indent and width in thousandths of the band.

    Blocks whose centre is in no band have band 0 and the page as their column.
    """
    centre = F.col("x0") + F.col("x1")
    inside = (centre >= 2 * F.col("bx0")) & (centre <= 2 * F.col("bx1"))
    in_band = blocks.join(bands, PAGE, "left").groupBy(*BLOCK, "x0", "x1").agg(F.min(F.when(inside, F.struct("band", "bx0", "bx1"))).alias("b"))
    left, wide = F.coalesce("b.bx0", F.lit(0)), F.coalesce(F.col("b.bx1") - F.col("b.bx0"), F.lit(1000))
    share = lambda v: F.floor(v * 1000 / wide + 0.5).cast("long")
    return in_band.select(*BLOCK, F.coalesce("b.band", F.lit(0)).cast("long").alias("band"), share(F.col("x0") - left).alias("indent"), share(F.col("x1") - F.col("x0")).alias("width"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share; columns are named with the prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def prefixed(boxes: DataFrame, prefix: str, *others: str) -> DataFrame:
    return boxes.select(*PAGE, *(F.col(n).alias(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")), *others)


def backgrounds(blocks: DataFrame, fills: DataFrame, page_area: int = 1_000_000) -> DataFrame:
    """doc_id, ord, colour: the smallest fill below a block that covers most of it and not nearly all of the page."""
    small = fills.withColumn("area", area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where(F.col("area") * 100 <= page_area * PAGE_SHARE)
    own = blocks.withColumn("size_", area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where("size_ > 0")
    pairs = own.join(prefixed(small, "f", "z", "area", "colour"), PAGE).where((F.col("z") < F.col("ord") * 10) & (overlap("", "f") * 100 >= F.col("size_") * COVERED))
    return pairs.groupBy(*BLOCK).agg(F.min_by("colour", F.struct("area", -F.col("z"))).alias("colour"))


def alignments(lines: DataFrame) -> DataFrame:
    """doc_id, ord, align of blocks of two lines or more: justify, left, right, center or empty.

    lines: doc_id, ord, line, x0, x1, and the column's left and right.  Edges agree within EDGE percent of the column;
    the last line does not count for the right edge.
    """
    last = F.max("line").over(W.partitionBy(*BLOCK))
    rows = lines.withColumn("last", last)
    full = F.when(F.col("line") < F.col("last"), F.col("x1"))
    middle = F.col("x0") + F.col("x1")
    own = rows.groupBy(*BLOCK).agg(
        F.count("*").alias("n"), F.first(F.col("right") - F.col("left")).alias("room"),
        (F.max("x0") - F.min("x0")).alias("left_"), (F.max(full) - F.min(full)).alias("right_"), (F.max("x1") - F.min("x1")).alias("ends"), (F.max(middle) - F.min(middle)).alias("middle"),
    ).where("n >= 2")
    within = lambda v, times=1: v * 100 <= F.col("room") * EDGE * times
    left, right = within(F.col("left_")), within(F.col("right_"))
    align = F.when(left & right & (F.col("n") >= 3), "justify").when(left, "left").when(within(F.col("ends")), "right").when(within(F.col("middle"), 2), "center").otherwise("")
    return own.select(*BLOCK, align.alias("align"))


def rotations(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, rotation: whole degrees, 0 below 5."""
    return blocks.select(*BLOCK, F.when(F.abs("angle") < 5, 0).otherwise(F.col("angle")).cast("long").alias("rotation"))


def top_by_ink(runs: DataFrame, what: str, k: int) -> DataFrame:
    """doc_id, rank, value, ink: the k values of a column that most letters of a document have."""
    own = runs.groupBy("doc_id", F.col(what).cast("string").alias("value")).agg(F.sum("n_chars").alias("ink"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("ink").desc(), F.col("value")))
    return own.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", "value", "ink")


def profiles(runs: DataFrame) -> DataFrame:
    """doc_id, kind, rank, value, ink: the five sizes and three families with the most letters, and the share set bold."""
    bold = runs.groupBy("doc_id").agg(F.sum("n_chars").alias("ink"), F.sum(F.when(F.col("bold"), F.col("n_chars")).otherwise(0)).alias("heavy"))
    percent = F.floor(100 * F.col("heavy") / F.col("ink") + 0.5).cast("long").cast("string")
    rows = [top_by_ink(runs, "size", 5).withColumn("kind", F.lit("size")), top_by_ink(runs, "family", 3).withColumn("kind", F.lit("family")), bold.where("ink > 0").select("doc_id", F.lit(1).cast("long").alias("rank"), percent.alias("value"), "ink", F.lit("bold").alias("kind"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def body_sizes(runs: DataFrame) -> DataFrame:
    """doc_id, body, family: upper median of the runs' sizes, and the family most letters near that size (0.85 to 1.2) have."""
    body = runs.groupBy("doc_id").agg(T.upper_median(F.collect_list("size")).alias("body"))
    near = runs.join(body, "doc_id").where((F.col("size") * 100 >= F.col("body") * 85) & (F.col("size") * 100 <= F.col("body") * 120))
    family = near.groupBy("doc_id", "body", "family").agg(F.sum("n_chars").alias("ink"))
    return family.groupBy("doc_id", "body").agg(F.max_by("family", F.struct("ink", "family")).alias("family"))


def gaps(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, gap: upper median of the distances between blocks that follow one another downwards on a page."""
    own = W.partitionBy(*PAGE).orderBy("y0", "ord")
    rows = blocks.withColumn("gap", F.col("y0") - F.lag("y1").over(own)).where("gap >= 0")
    return rows.groupBy(*PAGE).agg(T.upper_median(F.collect_list("gap")).alias("gap"))
