"""Spans of text over runs: matches mapped back to the letters of every run they touch, and runs cut by zones.

Runs here are lettered: doc_id, page_no, ord (their paragraph), run, line, text, xs (the x of each letter), y0, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.signals import PAGE

#: Letters of a unit's text that share a bucket of the interval join.
BUCKET = 256
#: Fixed values, in sizes: where a letter's body is sampled, the width of a last letter, the height of a match's box.
BODY_X, BODY_Y, LAST, HEIGHT = 0.25, 0.35, 0.6, 1.1


def units(runs: DataFrame) -> DataFrame:
    """The runs with `start`, their place in the text of their paragraph, and `piece`, their text with the line break before it."""
    order = W.partitionBy("doc_id", "ord").orderBy("run")
    broken = F.coalesce(F.col("line") != F.lag("line").over(order), F.lit(False))
    rows = runs.withColumn("piece", F.concat(F.when(broken, "\n").otherwise(""), "text"))
    return rows.withColumn("start", F.sum(F.length("piece")).over(order) - F.length("text"))


def match_spans(placed: DataFrame, pattern: str) -> DataFrame:
    """doc_id, ord, match, said, m_start, m_end: every match in a paragraph's text that is not empty.

    What stands between matches and the matches themselves come in turns, so their lengths give all places; splitting
    leaves out an empty match at the very start, where the other list has it.
    """
    whole = placed.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "piece"))), lambda x: x["piece"]), "").alias("t"))
    rows = whole.select("doc_id", "ord", F.split("t", pattern, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(pattern), 0).alias("said"))
    rows = rows.withColumn("said", F.when(F.size("said") == F.size("gaps"), F.slice("said", 2, F.size("said"))).otherwise(F.col("said")))
    rows = rows.where(F.size("said") > 0).select("doc_id", "ord", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("said")).alias("gap"), "said")).alias("match", "m"))
    order = W.partitionBy("doc_id", "ord").orderBy("match")
    rows = rows.select("doc_id", "ord", F.col("match").cast("long").alias("match"), F.col("m.said").alias("said"), F.length("m.gap").alias("gap"))
    rows = rows.withColumn("m_end", F.sum(F.col("gap") + F.length("said")).over(order))
    return rows.where("said <> ''").select("doc_id", "ord", "match", "said", (F.col("m_end") - F.length("said")).alias("m_start"), "m_end")


def pattern_zones(runs: DataFrame, pattern: str, xs: Column | str = "xs") -> DataFrame:
    """doc_id, page_no, ord, run, match, said, x0, y0, x1, y1: a box for every run that a match touches.

    It reaches from the first letter that is touched to the next letter with ink, at the end of the run a body's width
    beyond the last.  The pattern sees a paragraph as one text, lines parted by line breaks.  Runs meet matches in
    buckets of places, so a long paragraph is no pair of all with all.  xs may be an expression of the runs' columns, which is
    then made of runs that have matches only.
    """
    placed = units(runs)
    found = match_spans(placed.select("doc_id", "ord", "run", "piece"), pattern)
    low, high = F.expr(f"start div {BUCKET}"), F.expr(f"(start + greatest(length(text), 1) - 1) div {BUCKET}")
    rows = placed.withColumn("bucket", F.explode(F.sequence(low, high)))
    found = found.withColumn("bucket", F.explode(F.sequence(F.expr(f"m_start div {BUCKET}"), F.expr(f"(m_end - 1) div {BUCKET}"))))
    a, b = F.greatest("m_start", "start"), F.least(F.col("m_end"), F.col("start") + F.length("text"))
    # the first bucket that both are in names the pair once
    once = F.col("bucket") == F.greatest(F.expr(f"start div {BUCKET}"), F.expr(f"m_start div {BUCKET}"))
    rows = rows.join(found, ["doc_id", "ord", "bucket"]).withColumns({"a": (a - F.col("start")).cast("int"), "b": (b - F.col("start")).cast("int")}).where((F.col("a") < F.col("b")) & once)
    ink = F.col("b") + F.length(F.regexp_extract(F.expr("substr(text, b + 1)"), "^[ \\t\\n\\x0B\\f\\r]*", 0))
    rows = rows.withColumn("ink", ink).withColumn("xs", F.col(xs) if isinstance(xs, str) else xs).withColumns({"left": F.get("xs", F.col("a")), "right": F.coalesce(F.get("xs", F.col("ink")), F.get("xs", F.col("b") - 1) + LAST * F.col("size"))})
    return rows.select(*PAGE, "ord", "run", "match", "said", F.least("left", "right").alias("x0"), F.col("y0").cast("double").alias("y0"), F.greatest("left", "right").alias("x1"), (F.col("y0") + HEIGHT * F.col("size")).alias("y1"))


# ---------------------------------------------------------------- cutting


def _page_zones(zones: DataFrame) -> DataFrame:
    side = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return zones.groupBy(*PAGE).agg(F.collect_set(F.struct(*side)).alias("zones"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once; a column that a lambda asks for would be computed anew for each element."""
    return F.transform(F.array(value), f)[0]


def covered(runs: DataFrame, zones: DataFrame, how: str = "left") -> DataFrame:
    """The runs with `hidden`: for each letter, does its body lie in a zone of its page?  An inner join gives runs of pages with zones only."""
    rows = runs.join(_page_zones(zones), PAGE, how)
    y = F.col("y0") + BODY_Y * F.col("size")
    near = F.filter(F.coalesce("zones", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), lambda z: (y >= z["y0"]) & (y < z["y1"]) & (z["x0"] <= F.array_max("xs") + F.col("size")) & (F.array_min("xs") <= z["x1"]))
    shift = BODY_X * F.col("size")
    hidden = _let(near, lambda zs: F.when(F.size(zs) == 0, F.array_repeat(F.lit(False), F.size("xs"))).otherwise(F.transform("xs", lambda x: F.exists(zs, lambda z: (x + shift >= z["x0"]) & (x + shift < z["x1"])))))
    return rows.withColumn("hidden", hidden).drop("zones")


def cut_runs(runs: DataFrame, zones: DataFrame) -> DataFrame:
    """The runs with n_dropped, the letters that lie in a zone, and `spans`, the places (a, b) of the pieces that are left.

    A run of which only blanks are left has none; a run that no zone touches is one piece.
    """
    none = F.array().cast("array<struct<a:int,b:int>>")
    text = F.col("text")

    def parts(hidden: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hidden) - 1)
        flag = lambda i: F.get(hidden, i)
        starts = F.filter(at, lambda i: ~flag(i) & F.coalesce(flag(i - 1), F.lit(True)))
        ends = F.filter(at, lambda i: ~flag(i) & F.coalesce(flag(i + 1), F.lit(True)))
        whole = F.array(F.struct(F.lit(0).alias("a"), F.size(hidden).alias("b")))
        return F.when(F.size(hidden) == 0, none).when(~F.array_contains(hidden, True), whole).otherwise(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b"))))

    def result(hidden: Column) -> Column:
        n = F.size(F.filter(hidden, lambda h: h)).cast("long")
        left = lambda spans: F.when((n == 0) | F.exists(spans, lambda s: F.trim(F.substring(text, s["a"] + 1, s["b"] - s["a"])) != ""), spans).otherwise(none)
        return F.struct(n.alias("n_dropped"), _let(parts(hidden), left).alias("spans"))

    rows = covered(runs, zones).withColumn("cut", _let(F.col("hidden"), result))
    return rows.withColumns({"n_dropped": F.col("cut.n_dropped"), "spans": F.col("cut.spans")}).drop("hidden", "cut")


def pieces(cut: DataFrame) -> DataFrame:
    """What cut_runs leaves, one row a piece, as lettered runs with `piece` and the n_dropped of their run."""
    rows = cut.select("*", F.posexplode("spans").alias("p", "s"))
    part = F.expr("substr(text, s.a + 1, s.b - s.a)")
    return rows.select(*PAGE, "ord", "run", F.col("p").cast("long").alias("piece"), "line", part.alias("text"), F.slice("xs", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("xs"), "y0", "size", "n_dropped")


def proof(before: DataFrame, after: DataFrame, zones: DataFrame) -> DataFrame:
    """doc_id, n_before, n_after, clean: letters in the zones before and after, of documents that have any before."""
    # pages without zones count nothing
    count = lambda df, name: covered(df, zones, "inner").groupBy("doc_id").agg(F.sum(F.size(F.filter("hidden", lambda h: h))).cast("long").alias(name))
    rows = count(before, "n_before").where("n_before > 0").join(count(after, "n_after"), "doc_id", "left")
    return rows.select("doc_id", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"), (F.coalesce("n_after", F.lit(0)) == 0).alias("clean"))


def checked(proved: DataFrame) -> None:
    """Raises with the first document, by number, in whose zones anything is left."""
    found = proved.where("not clean").agg(F.min_by(F.struct("doc_id", "n_after"), "doc_id").alias("f")).first().f
    if found is not None:
        raise ValueError(f"redaction is not clean: {found.n_after} letters are left in document {found.doc_id}")


def apply(runs: DataFrame, zones: DataFrame) -> DataFrame:
    """The pieces of the runs, after the proof that no letter of theirs is in a zone."""
    left = pieces(cut_runs(runs, zones))
    checked(proof(runs, left, zones))
    return left


def box_difference(box: Column, zones: Column) -> Column:
    """The parts of a box (x0, y0, x1, y1) outside all zones, as boxes that do not overlap: above, below, left and right of each zone in turn."""

    def minus(b: Column, z: Column) -> Column:
        meets = (b["x0"] < z["x1"]) & (z["x0"] < b["x1"]) & (b["y0"] < z["y1"]) & (z["y0"] < b["y1"])
        top, foot = F.greatest(b["y0"], z["y0"]), F.least(b["y1"], z["y1"])
        part = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
        four = F.array(part(b["x0"], b["y0"], b["x1"], top), part(b["x0"], foot, b["x1"], b["y1"]), part(b["x0"], top, F.greatest(b["x0"], z["x0"]), foot), part(F.least(b["x1"], z["x1"]), top, b["x1"], foot))
        return F.when(meets, F.filter(four, lambda p: (p["x0"] < p["x1"]) & (p["y0"] < p["y1"]))).otherwise(F.array(part(b["x0"], b["y0"], b["x1"], b["y1"])))

    return F.aggregate(zones, F.array(box), lambda acc, z: F.flatten(F.transform(acc, lambda b: minus(b, z))))


def clipped(boxes: DataFrame, zones: DataFrame, *key: str) -> DataFrame:
    """Painted boxes without what lies in the zones of their page: the key, part, x0, y0, x1, y1; a box that is all in zones is gone."""
    side = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = boxes.select(*key, *(c for c in PAGE if c not in key), F.struct(*side).alias("box")).join(_page_zones(zones), PAGE, "left")
    zones_ = F.array_sort(F.coalesce("zones", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))
    return rows.select(*key, F.posexplode(box_difference(F.col("box"), zones_)).alias("part", "b")).select(*key, F.col("part").cast("long").alias("part"), "b.*")
