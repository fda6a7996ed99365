"""Figures: pictures, the loose pieces that bind them and their labels, grown into regions over whole tables.

All pages grow at once, in rounds.  In a round every part of a page names the neighbour with which it would make the smallest
box that no body text lies in, and pairs that name each other become one; only parts that changed or still had a neighbour are
looked at again, and pages in which nothing joined leave the rounds.  On crowded pages neighbours are found in cells of a grid,
not as pairs of all parts.  Among parts that could join in more than one way, the order of the rounds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.signals import PAGE
from quire.sources.shared import written

#: How near ink of one drawing lies; what a label overlaps by; letters and lines from which on text is body; a
#: crumb's share of the page, and how many crumbs are one drawing.
GAP, HUG, LABEL, COLUMN, CRUMB, SCATTER = 12, 3, 100, 4, 0.01, 5
SIDES = ("x0", "y0", "x1", "y1")
#: Side of a grid cell, and how many pieces a page may have before it needs one.
CELL, CROWD = 128, 64
SAMPLES = 8
#: What all tables of this module are joined by: a page, and whether it is crowded.
KEY = [*PAGE, "crowd"]


def _as(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """Page, kept columns, and the sides under a prefix."""
    return df.select(*KEY, *keep, *(F.col(c).alias(prefix + c) for c in SIDES))


def _cells(df: DataFrame, p: str = "", room: int = 0) -> DataFrame:
    """A row for each grid cell that a box, grown by some room, lies in; low_ is the first.  Pages that are not crowded are one cell."""
    at = lambda c, d: F.when(F.col("crowd"), F.floor((F.col(p + c) + d) / CELL)).otherwise(0)
    span = lambda a, b: F.explode(F.sequence(at(a, -room), at(b, room)))
    return df.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).withColumns({f"{p}low_x": at("x0", -room), f"{p}low_y": at("y0", -room)})


def _met(a: DataFrame, b: DataFrame, p: str, q: str, room: int = 0) -> DataFrame:
    """Pairs of boxes of one page that touch once the first are grown by some room."""
    both = _cells(a, p, room).join(_cells(b, q), [*KEY, "cx", "cy"])
    # the first cell that both are in names the pair once
    once = (F.col("cx") == F.greatest(f"{p}low_x", f"{q}low_x")) & (F.col("cy") == F.greatest(f"{p}low_y", f"{q}low_y"))
    touch = reduce(lambda x, y: x & y, [(F.col(f"{p}{v}0") - room <= F.col(f"{q}{v}1")) & (F.col(f"{q}{v}0") - room <= F.col(f"{p}{v}1")) for v in "xy"])
    return both.where(once & touch).drop("cx", "cy", *(f"{x}low_{v}" for x in (p, q) for v in "xy"))


def _within(p: str, q: str) -> Column:
    """Does box p hold box q, which has an area?"""
    c = F.col
    return (c(f"{q}x0") >= c(f"{p}x0")) & (c(f"{q}y0") >= c(f"{p}y0")) & (c(f"{q}x1") <= c(f"{p}x1")) & (c(f"{q}y1") <= c(f"{p}y1")) & (c(f"{q}x0") < c(f"{q}x1")) & (c(f"{q}y0") < c(f"{q}y1"))


def _shares(p: str, q: str) -> Column:
    """Do the boxes share area?"""
    c = F.col
    return (F.greatest(c(f"{p}x0"), c(f"{q}x0")) < F.least(c(f"{p}x1"), c(f"{q}x1"))) & (F.greatest(c(f"{p}y0"), c(f"{q}y0")) < F.least(c(f"{p}y1"), c(f"{q}y1")))


def _union(p: str, q: str, to: str = "u") -> dict[str, Column]:
    return {f"{to}{c}": (F.least if c.endswith("0") else F.greatest)(f"{p}{c}", f"{q}{c}") for c in SIDES}


def _clear(df: DataFrame, body: DataFrame) -> DataFrame:
    """Rows whose box u holds no part of body text."""
    texts = _as(body, "t").select(*(F.col(c).alias("t_" + c) for c in KEY), *(f"t{c}" for c in SIDES))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col("t_" + c) for c in KEY])
    return df.join(texts, same & _shares("u", "t"), "left_anti")


def asked() -> Column:
    """Is a text one whose lines decide whether it is body?"""
    return F.coalesce((F.col("n_chars") >= LABEL) & (F.col("n_lines") < COLUMN), F.lit(False))


def kinds(texts: DataFrame, lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """The texts with `role`: body, heading or label.

    A column of copy is body.  Other long text is, unless half of what its lines span lies over ink that does not hold it
    as a whole: then it is set on the drawing.  texts: doc_id, page_no, crowd, ord, n_lines, n_chars, heading and sides; lines:
    doc_id, page_no, ord and sides, or `boxes`, the list of a text's lines.  Only lines of texts with ink under them are dealt.
    """
    c, key = F.col, [*PAGE, "ord"]
    under = _met(_as(texts.where(asked()), "w", "ord"), _as(pieces, "d"), "w", "d").where(_shares("w", "d") & ~_within("d", "w")).select(*key, *(f"d{c}" for c in SIDES))
    if "boxes" not in lines.columns:
        lines = lines.join(texts.where(asked()).select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct(*SIDES)).alias("boxes"))
    at = lambda r, n, i: F.struct((n * SAMPLES + i).alias("k"), (r["x0"] + (i + 0.5) * (r["x1"] - r["x0"]) / SAMPLES).alias("x"), ((r["y0"] + r["y1"]) / 2).alias("y"))
    points = F.flatten(F.transform("boxes", lambda r, n: F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: at(r, n, i))))
    inside = F.filter(points, lambda p: (p["x"] >= c("dx0")) & (p["x"] <= c("dx1")) & (p["y"] >= c("dy0")) & (p["y"] <= c("dy1")))
    on = under.join(lines.select(*key, "boxes"), key).select(*key, (F.size("boxes") * SAMPLES).alias("all"), F.explode(inside).alias("p"))
    drawn = on.groupBy(*key, "all").agg(F.size(F.collect_set("p.k")).alias("on")).where(F.col("on") * 2 >= F.col("all")).select(*key, F.lit(True).alias("drawn"))
    told = lambda body: F.when(body, "body").when(F.col("heading"), "heading").otherwise("label").alias("role")
    kept = lambda df, body: df.select(*KEY, "ord", *SIDES, told(body))
    return kept(texts.where(~asked()), F.col("n_chars") >= LABEL).unionByName(kept(texts.where(asked()).join(drawn, key, "left"), F.col("drawn").isNull()))


def _seeds(pictures: DataFrame, texts: DataFrame) -> DataFrame:
    """Pictures that are no frame: of body text, or of a heading where they hold no label."""
    held = _met(_as(pictures, "p", "id"), _as(texts, "t", "role"), "p", "t").where(_within("p", "t")).groupBy(*KEY, "id").agg(F.max((F.col("role") == "body").cast("int")).alias("b"), F.max((F.col("role") == "heading").cast("int")).alias("h"), F.max((F.col("role") == "label").cast("int")).alias("l"))
    frames = held.where("b = 1 or h = 1 and l = 0").select(*KEY, "id")
    return pictures.join(frames, [*KEY, "id"], "left_anti")


_PART = [*KEY, "glue", "id", *SIDES, "active"]


def _pairs(parts: DataFrame, near: bool) -> DataFrame:
    """Two parts of a page, one of them active, the first a region: a*, b* and the box u that they would make."""
    a = parts.where("not glue").select(*KEY, F.col("id").alias("a"), F.col("active").alias("a_active"), *(F.col(c).alias(f"a{c}") for c in SIDES))
    b = parts.select(*KEY, F.col("id").alias("b"), F.col("glue").alias("b_glue"), F.col("active").alias("b_active"), *(F.col(c).alias(f"b{c}") for c in SIDES))
    both = _met(a, b, "a", "b", GAP) if near else a.join(b, KEY)
    return both.where((F.col("b_glue") | (F.col("a") < F.col("b"))) & (F.col("a_active") | F.col("b_active"))).withColumns(_union("a", "b"))


def _marked(parts: DataFrame, changed: DataFrame) -> DataFrame:
    """The parts with `live`: did something of their page change?"""
    pages = changed.select(*KEY, F.lit(True).alias("live")).distinct()
    return written(parts.join(pages, KEY, "left").withColumn("live", F.coalesce("live", F.lit(False))), "parts")


def _round(parts: DataFrame, body: DataFrame, near: bool) -> tuple[DataFrame, DataFrame] | None:
    """The parts after one round, and what became of whom (glue, id, into); null where nothing joins."""
    fine = written(_clear(_pairs(parts, near), body).select(*KEY, "a", "b", "b_glue", ((F.col("ux1") - F.col("ux0")) * (F.col("uy1") - F.col("uy0"))).alias("area")), "pairs")
    ends = lambda g, i, h, j: F.struct(g.alias("glue"), F.col(i).alias("id"), F.struct("area", h.alias("glue"), F.col(j).alias("id")).alias("o"))
    sides = F.explode(F.array(ends(F.lit(False), "a", F.col("b_glue"), "b"), ends(F.col("b_glue"), "b", F.lit(False), "a")))
    wish = written(fine.select(*KEY, sides.alias("e")).groupBy(*KEY, "e.glue", "e.id").agg(F.min("e.o").alias("o")), "wishes")
    back = wish.select(*KEY, F.col("o.glue").alias("glue"), F.col("o.id").alias("id"), F.col("glue").alias("g"), F.col("id").alias("i"))
    mutual = wish.join(back, [*KEY, "glue", "id"]).where((F.col("o.glue") == F.col("g")) & (F.col("o.id") == F.col("i")))
    # the region with the smaller number stays
    gone = written(mutual.where("glue or (not g and id > i)").select(*KEY, "glue", "id", F.col("i").alias("into")), "merges")
    if not gone.limit(1).collect():
        return None
    more = gone.join(parts.select(*KEY, "glue", "id", *SIDES), [*KEY, "glue", "id"]).select(*KEY, F.lit(False).alias("glue"), F.col("into").alias("id"), *(F.col(c).alias(f"m{c}") for c in SIDES))
    left = parts.drop("active").join(gone.select(*KEY, "glue", "id"), [*KEY, "glue", "id"], "left_anti").join(more, [*KEY, "glue", "id"], "left")
    left = left.join(wish.select(*KEY, "glue", "id", F.lit(True).alias("again")), [*KEY, "glue", "id"], "left")
    sides = [F.coalesce((F.least if c.endswith("0") else F.greatest)(c, f"m{c}"), F.col(c)).alias(c) for c in SIDES]
    return _marked(left.select(*KEY, "glue", "id", *sides, F.coalesce("again", F.lit(False)).alias("active")), gone), gone


def _of_pages(df: DataFrame, changed: DataFrame, name: str) -> DataFrame:
    """The rows of pages where something changed."""
    return written(df.join(changed.select(*KEY).distinct(), KEY, "left_semi"), name)


def _grown(parts: DataFrame, body: DataFrame, near: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The parts after as many rounds as their pages need, and the merges of each round."""
    done, log = [], []
    while (step := _round(parts, body, near)) is not None:
        done.append(step[0].where("not live").select(*_PART))
        log.append(step[1])
        parts, body = step[0].where("live").select(*_PART), _of_pages(body, step[1], "body")
    return reduce(DataFrame.unionByName, done, parts), log


def _bound(parts: DataFrame, labels: DataFrame, body: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Labels that touch two regions or more bind them, if no body text lies in the box of all: parts, merges, labels bound.

    Of labels that touch one region, the first in reading order goes first.
    """
    near = _met(parts.where("not glue").select(*KEY, F.col("id").alias("r"), *(F.col(c).alias(f"a{c}") for c in SIDES)), _as(labels, "l", "ord"), "a", "l", GAP)
    near = near.withColumns(_union("a", "l"))
    sets = near.groupBy(*KEY, "ord").agg(F.sort_array(F.collect_set("r")).alias("rs"), *((F.min if c.endswith("0") else F.max)(f"u{c}").alias(f"u{c}") for c in SIDES)).where(F.size("rs") >= 2)
    fine = written(_clear(sets, body), "bindings")
    first = fine.select(*KEY, "ord", F.explode("rs").alias("r")).groupBy(*KEY, "r").agg(F.min("ord").alias("ord"))
    won = first.groupBy(*KEY, "ord").agg(F.count("*").alias("n"))
    chosen = written(fine.join(won, [*KEY, "ord"]).where(F.col("n") == F.size("rs")).drop("n"), "chosen")
    if not chosen.limit(1).collect():
        return None
    gone = written(chosen.select(*KEY, F.lit(False).alias("glue"), F.explode(F.slice("rs", 2, F.size("rs"))).alias("id"), F.col("rs")[0].alias("into")), "merges")
    new = chosen.select(*KEY, F.lit(False).alias("glue"), F.col("rs")[0].alias("id"), *(F.col(f"u{c}").alias(f"m{c}") for c in SIDES))
    left = parts.join(gone.select(*KEY, "glue", "id"), [*KEY, "glue", "id"], "left_anti").join(new, [*KEY, "glue", "id"], "left")
    left = left.select(*KEY, "glue", "id", *(F.coalesce(f"m{c}", c).alias(c) for c in SIDES), (F.col("active") | F.col("mx0").isNotNull()).alias("active"))
    return _marked(left, chosen), gone, chosen.select(*KEY, "ord", F.col("rs")[0].alias("region"))


def _moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    """The members (kind, id, region) with the region (id) that theirs went into."""
    to = moves.select(*KEY, F.col("id").alias("region"), "into")
    return members.join(to, [*KEY, "region"], "left").select(*KEY, "kind", "id", F.coalesce("into", "region").alias("region"))


def _last(moves: DataFrame) -> DataFrame:
    """Regions that went into others (id, into), with the region that is left in the end.

    A region goes once and does not come back, so ways double in length until none goes on.
    """
    moves, goes_on = written(moves, "moves"), True
    while goes_on:
        then = moves.select(*KEY, F.col("id").alias("into"), F.col("into").alias("then"))
        moves = written(moves.join(then, [*KEY, "into"], "left").select(*KEY, "id", F.coalesce("then", "into").alias("into"), F.col("then").isNotNull().alias("on")), "moves")
        goes_on = bool(moves.where("on").limit(1).collect())
        moves = moves.drop("on")
    return moves


def regions(pieces: DataFrame, texts: DataFrame, lines: DataFrame, page_area: float = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(regions, members): doc_id, page_no, region (the first of its pictures), sides; and doc_id, page_no, kind, id, region.

    pieces: doc_id, page_no, id (unlike on a page), picture (else a loose piece) and sides; texts and lines: as kinds() has them,
    but for crowd.  A picture that frames body text, or a heading alone, is no figure.  Pieces within GAP grow together while
    no body text lies in their box; labels that touch two regions bind them; then regions with no body text between them are
    one; short text that overlaps a region by HUG is its label; SCATTER crumbs or more of a page without labels are one
    drawing.  Empty tables give none.
    """
    # pages without a picture have no region
    pages = pieces.groupBy(*PAGE).agg((F.count("*") > CROWD).alias("crowd"), F.max("picture").alias("any")).where("any").drop("any")
    pieces = written(pieces.join(pages, PAGE), "pieces")
    texts = written(kinds(texts.join(pages, PAGE), lines, pieces), "texts")
    body, labels = texts.where("role = 'body'").select(*KEY, *SIDES), texts.where("role = 'label'").select(*KEY, "ord", *SIDES)
    own = _seeds(pieces.where("picture"), texts).withColumns({"glue": F.lit(False), "active": F.lit(True)}).select(*_PART)
    loose = pieces.where("not picture").withColumns({"glue": F.lit(True), "active": F.lit(True)}).select(*_PART)
    start = written(own.unionByName(loose), "parts")
    done, log, bound = [], [], []
    parts, near_labels, near_body = start, labels, body
    while True:
        parts, merges = _grown(parts, near_body, True)
        log += merges
        bind = _bound(parts, near_labels, near_body)
        if bind is None:
            break
        done.append(bind[0].where("not live").select(*_PART))
        log.append(bind[1])
        bound.append(bind[2])
        parts = bind[0].where("live").select(*_PART)
        near_labels = _of_pages(near_labels.join(bind[2], [*KEY, "ord"], "left_anti"), bind[2], "labels")
        near_body = _of_pages(near_body, bind[2], "body")
    parts = written(reduce(DataFrame.unionByName, done, parts).where("not glue").withColumn("active", F.lit(True)), "parts")
    parts, merges = _grown(parts, body, False)
    parts = written(parts, "parts")
    none = start.where("false")
    log = reduce(DataFrame.unionByName, log + merges, none.select(*KEY, "glue", "id", F.col("id").alias("into")))
    bound = reduce(DataFrame.unionByName, bound, labels.where("false").select(*KEY, "ord", F.col("ord").alias("region")))
    members = start.where("not glue").select(*KEY, F.lit("picture").alias("kind"), "id", F.col("id").alias("region"))
    members = members.unionByName(log.where("glue").select(*KEY, F.lit("glue").alias("kind"), "id", F.col("into").alias("region")))
    members = members.unionByName(bound.select(*KEY, F.lit("label").alias("kind"), F.col("ord").alias("id"), "region"))
    members = _moved(members, _last(log.where("not glue").select(*KEY, "id", "into")))
    free = labels.join(bound, [*KEY, "ord"], "left_anti")
    hugged = free.select(*KEY, "ord", *((F.col(c) + (HUG if c.endswith("0") else -HUG)).alias(f"l{c}") for c in SIDES)).where("lx0 < lx1 and ly0 < ly1")
    over = _met(parts.select(*KEY, F.col("id").alias("region"), *(F.col(c).alias(f"a{c}") for c in SIDES)), hugged, "a", "l").where(_shares("a", "l"))
    members = written(members.unionByName(over.select(*KEY, F.lit("label").alias("kind"), F.col("ord").alias("id"), "region")), "members")
    small = parts.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < CRUMB * page_area)
    crumbs = small.join(members.where("kind = 'label'").select(*KEY, F.col("region").alias("id")), [*KEY, "id"], "left_anti")
    heaps = crumbs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("into")).where(F.col("n") >= SCATTER)
    gone = written(crumbs.join(heaps, KEY).select(*KEY, "id", "into"), "merges")
    boxes = parts.join(gone, [*KEY, "id"], "left").groupBy(*KEY, F.coalesce("into", "id").alias("region")).agg(*((F.min if c.endswith("0") else F.max)(c).alias(c) for c in SIDES))
    return boxes.drop("crowd"), _moved(members, gone).drop("crowd")


def summed(boxes: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, page_no, region, sides, and how many pictures, loose pieces and labels each region has."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    return boxes.join(members.groupBy(*PAGE, "region").agg(count("picture"), count("glue"), count("label")), [*PAGE, "region"])
