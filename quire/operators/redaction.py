"""Redaction: audit of what lies under boxes, applying zones, the proof, and what must go with it.

Boxes meet items of their own page only; a page's boxes are few, so each join is an equi-join by page with a test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.signals import PAGE, area, overlap, prefixed

#: Opacity, sides and filled share from which on a box hides what lies below.
ALPHA, SIDE, FILLED = 0.9, 2, 0.6
#: Fixed value: channels that differ by this much or less are one ink.
SAME_INK = 12


def channel(argb: Column, shift: int) -> Column:
    return F.shiftright(argb, shift).bitwiseAND(255)


def same_ink(a: Column, b: Column) -> Column:
    close = [F.abs(channel(a, s) - channel(b, s)) <= SAME_INK for s in (16, 8, 0)]
    return close[0] & close[1] & close[2]


def opaque(filled: Column, gradient: Column, alpha: Column, box: Column, shape: Column, width: Column, height: Column) -> Column:
    """A filled shape without gradient, nearly solid, with sides, that fills most of its box."""
    return filled & ~gradient & (alpha >= ALPHA) & (width >= SIDE) & (height >= SIDE) & (shape >= FILLED * box)


def shoelace(points: Column) -> Column:
    """Area of a polygon from its points (x, y)."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    twice = F.aggregate(F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)
    return F.abs(twice) / 2


def text_findings(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, run, fill, kind: runs whose anchor lies in a box painted after them (under), or in one of their own ink below them (invisible)."""
    ax, ay = F.col("x0") + F.col("size") * 0.25, F.col("y0") + F.col("size") * 0.35
    inside = (ax >= F.col("fx0")) & (ax <= F.col("fx1")) & (ay >= F.col("fy0")) & (ay <= F.col("fy1"))
    kind = F.when(F.col("z") < F.col("fz"), "under").when(same_ink(F.col("ink"), F.col("colour")), "invisible")
    own = boxes.select(*PAGE, F.col("ord").alias("box"), "fill", F.col("z").alias("fz"), "colour", *(F.col(n).alias(f"f{n}") for n in ("x0", "y0", "x1", "y1")))
    return runs.join(own, PAGE).where(inside).withColumn("kind", kind).where("kind is not null").select(*PAGE, "ord", "run", "box", "fill", "kind")


def picture_findings(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, box, fill, covered: pictures that a later box meets, and the share it covers, to two decimals."""
    own = pictures.select(*PAGE, "ord", "z", "x0", "y0", "x1", "y1")
    other = prefixed(boxes.withColumnRenamed("z", "fz").withColumnRenamed("ord", "box"), "f", "fz", "box", "fill")
    whole = area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shared = overlap("", "f")
    covered = F.floor(shared * 100 / whole + 0.5) / 100
    return own.join(other, PAGE).where((F.col("z") < F.col("fz")) & (shared > 0)).select(*PAGE, "ord", "box", "fill", covered.alias("covered"))


def touching(items: DataFrame, zones: DataFrame) -> Column:
    """Test of items joined with zones prefixed by z_: do the boxes share area?"""
    return (F.col("x0") < F.col("z_x1")) & (F.col("z_x0") < F.col("x1")) & (F.col("y0") < F.col("z_y1")) & (F.col("z_y0") < F.col("y1"))


def zoned(zones: DataFrame) -> DataFrame:
    return prefixed(zones, "z_").distinct()


def cut(items: DataFrame, zones: DataFrame, *key: str) -> DataFrame:
    """The items that touch no zone."""
    hit = items.join(zoned(zones), PAGE).where(touching(items, zones)).select(*key).distinct()
    return items.join(hit, list(key), "left_anti")


def purged(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes without refs to blocks that were removed, and with empty text where a block was altered.

    blocks: doc_id, ord, altered, removed.
    """
    rows = nodes.join(blocks.select("doc_id", F.col("ord").alias("ref"), "altered", "removed"), ["doc_id", "ref"], "left")
    altered = F.coalesce("altered", F.lit(False))
    return rows.withColumns({"ref": F.when(altered & F.col("removed"), None).otherwise(F.col("ref")), "text": F.when(altered, "").otherwise(F.col("text"))}).drop("altered", "removed")
