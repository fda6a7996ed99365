"""Boxes, affine maps, page grids and colours as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersects(a: Column, b: Column) -> Column:
    """Boxes that share more than an edge."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def intersection(a: Column, b: Column) -> Column:
    """The common box, null where there is none."""
    return F.when(intersects(a, b), rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])))


def inflate(a: Column, by: Column) -> Column:
    return rect(a["x0"] - by, a["y0"] - by, a["x1"] + by, a["y1"] + by)


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """x' = a x + c y + e, y' = b x + d y + f."""
    return F.struct(*(v.cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))))


def mapped(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def mapped_rect(m: Column, r: Column) -> Column:
    """The box around the four mapped corners."""
    corners = [mapped(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    pick = lambda f, c: f(*(p[c] for p in corners))
    return rect(pick(F.least, "x"), pick(F.least, "y"), pick(F.greatest, "x"), pick(F.greatest, "y"))


def concat(m: Column, n: Column) -> Column:
    """First n, then m."""
    return affine(m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"], m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"])


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null where the map has none."""
    det = determinant(m)
    return F.when(det != 0, affine(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det))


def quarter_turns(a: Column, b: Column) -> Column:
    """Turns of a map, to the nearest quarter: 0 to 3."""
    return F.pmod(F.floor(F.atan2(b, a) / (math.pi / 2) + 0.5), F.lit(4)).cast("long")


def on_grid(box: Column, page: Column, rotation: Column, grid: int) -> Column:
    """A box of a page with its origin at the bottom left, on 0..grid with the origin at the top left, turned as the page is shown."""
    wide, high = page["x1"] - page["x0"], page["y1"] - page["y0"]
    x, y, w, h = (box["x0"] - page["x0"]) / wide, (page["y1"] - box["y1"]) / high, (box["x1"] - box["x0"]) / wide, (box["y1"] - box["y0"]) / high
    turned = lambda r0, r90, r180, r270: F.when(rotation == 90, r90).when(rotation == 180, r180).when(rotation == 270, r270).otherwise(r0)
    left, top = turned(x, 1 - (y + h), 1 - (x + w), y), turned(y, x, 1 - (y + h), 1 - (x + w))
    across, down = turned(w, h, w, h), turned(h, w, h, w)
    # noise of the division must not decide about halves
    cell = lambda v: F.least(F.lit(grid), F.greatest(F.lit(0), F.floor(F.round(v * grid, 6) + 0.5))).cast("long")
    return F.when((wide > 0) & (high > 0), rect(cell(left), cell(top), cell(left + across), cell(top + down)))


def css(argb: Column) -> Column:
    """#rrggbb, or rgba() where a colour is not solid."""
    part = lambda s: F.shiftrightunsigned(argb, s).bitwiseAND(255)
    solid = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(argb.bitwiseAND(0xFFFFFF))), 6, "0"))
    return F.when(part(24) == 255, solid).otherwise(F.concat(F.lit("rgba("), F.concat_ws(",", *(part(s).cast("string") for s in (16, 8, 0))), F.lit(","), F.format_string("%.3f", part(24) / 255), F.lit(")")))


def from_hex(s: Column) -> Column:
    """argb of #rgb or #rrggbb, null for anything else."""
    d = F.lower(F.regexp_extract(s, "^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$", 1))
    full = F.when(F.length(d) == 3, F.concat(*(F.repeat(F.substring(d, i, 1), 2) for i in (1, 2, 3)))).otherwise(d)
    return F.when(full != "", F.conv(F.concat(F.lit("ff"), full), 16, 10).cast("long"))
