"""Operators on one page, line or table at a time that no expression states: greedy, recursive or fixpoint rules.

Each is a plain function over the rows of a group, and a wrapper that runs it by group in Arrow batches.  A page is the
largest group; its rows are put in a total order first, so that reruns agree.
"""

from __future__ import annotations

import statistics
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


#: Groups whose rows are Python's at one time.
AT_ONCE = 64


def by_group(df: DataFrame, keys: list[str], run: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """run() over the rows of each group; keys are put back in front of its rows.

    A group is one row with a list, and many groups are a batch, as most of them are small.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    fields = df.select(*keys).schema
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", " + schema
    target = df.sparkSession.createDataFrame([], full).schema
    held = [c for c in df.columns if c not in keys]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                lists = part.column(len(keys))
                values = lists.flatten().flatten()
                rows = [dict(zip(held, r)) for r in zip(*(v.to_pylist() for v in values))]
                at, group, out = 0, [], []
                for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
                    own = run(rows[at : at + n])
                    at += n
                    group += [i] * len(own)
                    out += own
                told = [part.column(k).take(pa.array(group, pa.int64())) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*told, *(pa.array([r[n] for r in out], arrow.field(n).type) for n in names)], schema=arrow)

    return df.groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("_rows")).mapInArrow(grouped, target)


# ---------------------------------------------------------------- lines and words


def shared(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def lines_of(runs: list[dict], overlap: float = 1 / 3, cover: float = 0.5, gap: float = 0.5) -> list[list[dict]]:
    """Runs (x0, y0, x1, y1, size, axis) as lines, top down and left to right.

    A run joins the first line on its axis whose tallest member it overlaps enough, unless it is stacked on a member
    (twice its size, over half its width covered).  A line is split where a gap is over half an em.
    """
    runs = sorted(runs, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["run"]))
    # the least top of the runs to come: a line whose tallest member ends above it is done
    tops = [0.0] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        tops[i] = runs[i]["y0"] if i + 1 == len(runs) else min(runs[i]["y0"], tops[i + 1])
    lines: list[list[dict]] = []
    open_: list[list] = []  # [line, tallest member]
    for r, top in zip(runs, tops):
        open_ = [o for o in open_ if o[1]["y1"] > top]
        height = r["y1"] - r["y0"]
        for o in open_:
            line, tall = o
            low = min(height, tall["y1"] - tall["y0"])
            if r["axis"] != line[0]["axis"] or low <= 0 or shared(r["y0"], r["y1"], tall["y0"], tall["y1"]) < overlap * low:
                continue
            if not any(max(r["size"], m["size"]) >= 2 * min(r["size"], m["size"]) and shared(r["x0"], r["x1"], m["x0"], m["x1"]) > cover * min(r["x1"] - r["x0"], m["x1"] - m["x0"]) for m in line):
                line.append(r)
                if height > tall["y1"] - tall["y0"]:
                    o[1] = r
                break
        else:
            lines.append([r])
            open_.append([lines[-1], r])
    out = []
    for line in lines:
        line.sort(key=lambda r: (r["x0"], r["run"]))
        part, end = [line[0]], line[0]["x1"]
        for a, b in zip(line, line[1:]):
            if b["x0"] - end > gap * max(a["size"], b["size"]):
                out.append(part)
                part, end = [], b["x1"]
            part.append(b)
            end = max(end, b["x1"])
        out.append(part)
    return out


def line_clusters(runs: DataFrame) -> DataFrame:
    """doc_id, page_no, run, line, place of every run of a page."""
    return by_group(runs, ["doc_id", "page_no"], lambda rows: [{"run": r["run"], "line": i, "place": j} for i, line in enumerate(lines_of(rows)) for j, r in enumerate(line)], "run long, line long, place long")


#: Share of a face's space width that is a word space in its style, the least that can be, seams that make a
#: distribution, how far apart its two parts must be, and what counts as tight.
STYLE, LEAST, SEAMS, APART, TIGHT = 0.28, 0.10, 6, 2.0, 0.05


def upper(xs: list[float]) -> float:
    return xs[len(xs) // 2]


def gate(ratios: list[float]) -> float:
    """From which ratio on (gap over space width) a seam of a line is a word space."""
    if len(ratios) < SEAMS:
        return STYLE
    s = sorted(ratios)
    floor = STYLE if s[-1] > STYLE else LEAST
    for i in range(1, len(s)):
        tight, wide = s[:i], s[i:]
        low = upper(tight)
        if wide[0] >= APART * max(low, TIGHT) and wide[0] - tight[-1] >= tight[-1] - low and upper(wide) > floor:
            return max((tight[-1] + wide[0]) / 2, floor)
    return float("inf")


def gates(ratios: Column, n: Column) -> Column:
    """gate() of n sorted ratios as an expression."""
    at = lambda i: F.get(ratios, i)
    half = lambda i: F.shiftright(i, 1)
    floor = F.when(at(n - 1) > STYLE, STYLE).otherwise(LEAST)

    def parts(i: Column) -> Column:
        low = at(half(i))
        return (at(i) >= APART * F.greatest(low, F.lit(TIGHT))) & (at(i) - at(i - 1) >= at(i - 1) - low) & (at(i + half(n - i)) > floor)

    cut = F.transform(F.slice(F.filter(F.sequence(F.lit(1), n - 1), parts), 1, 1), lambda i: F.greatest((at(i - 1) + at(i)) / 2, floor))
    return F.when(n < SEAMS, F.lit(STYLE)).otherwise(F.coalesce(F.get(cut, F.lit(0)), F.lit(float("inf"))))


def word_gaps(seams: DataFrame) -> DataFrame:
    """doc_id, line, seam, is_space: seams (doc_id, line, seam, ratio) past the gate of their line."""
    lines = seams.groupBy("doc_id", "line").agg(F.collect_list(F.struct("seam", F.col("ratio").cast("double").alias("ratio"))).alias("seams"))
    lines = lines.withColumn("s", F.array_sort(F.transform("seams", lambda x: x["ratio"]))).withColumn("gate", gates(F.col("s"), F.size("s")))
    return lines.select("doc_id", "line", "gate", F.explode("seams").alias("x")).select("doc_id", "line", F.col("x.seam").alias("seam"), (F.col("x.ratio") >= F.col("gate")).alias("is_space"))


# ---------------------------------------------------------------- reading order

#: Bins of a profile, share of its peak that is still a valley, and the least depth of one.
BINS, NOISE, DEPTH = 4096, 0.05, 0.10


def valley(spans: list[tuple[float, float]]) -> tuple[float, float] | None:
    """(depth, place) of the deepest valley of a projection, null where it has none."""
    lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
    if hi <= lo:
        return None
    n = min(BINS, max(1, int(hi - lo)))
    # the profile as steps: where it changes, and what it is from there on
    edge: dict[int, int] = {0: 0, n: 0}
    for a, b in spans:
        i = min(n - 1, int((a - lo) * n / (hi - lo)))
        j = min(n, max(int((a - lo) * n / (hi - lo)) + 1, int((b - lo) * n / (hi - lo))))
        edge[i] = edge.get(i, 0) + 1
        edge[j] = edge.get(j, 0) - 1
    at, profile, held = sorted(edge), [], 0
    for k in at[:-1]:
        held += edge[k]
        profile.append(held)
    peak, m = max(profile), len(profile)
    after = [0] * (m + 1)
    for k in range(m - 1, -1, -1):
        after[k] = max(after[k + 1], profile[k])
    best, before, i = None, 0, 0
    while i < m:
        if profile[i] > NOISE * peak:
            before = max(before, profile[i])
            i += 1
            continue
        j = i
        while j < m and profile[j] <= NOISE * peak:
            j += 1
        depth = min(before, after[j]) / peak
        if depth >= DEPTH and (best is None or depth > best[0]):
            best = (depth, lo + (at[i] + at[j]) / 2 * (hi - lo) / n)
        i = j
    return best


def reading_order(items: list[dict]) -> list[dict]:
    """Items (x0, y0, x1, y1, ord) in reading order: cut at the deepest valley, rows before columns on ties; leaves top down, then left to right."""
    solid = [r for r in items if r["x1"] > r["x0"] and r["y1"] > r["y0"]]
    rest = sorted((r for r in items if r not in solid), key=lambda r: r["ord"])
    out: list[dict] = []
    todo = [solid] if solid else []
    while todo:
        own = todo.pop()
        rows = valley([(r["y0"], r["y1"]) for r in own]) if len(own) > 1 else None
        columns = valley([(r["x0"], r["x1"]) for r in own]) if len(own) > 1 else None
        if rows is None and columns is None:
            out += sorted(own, key=lambda r: (r["y0"], r["x0"], r["ord"]))
            continue
        a, b, at = ("y0", "y1", rows[1]) if rows and (columns is None or rows[0] >= columns[0]) else ("x0", "x1", columns[1])
        first = [r for r in own if (r[a] + r[b]) / 2 <= at]
        second = [r for r in own if (r[a] + r[b]) / 2 > at]
        if not first or not second:
            out += sorted(own, key=lambda r: (r["y0"], r["x0"], r["ord"]))
            continue
        todo += [second, first]
    return out + rest


def wide_items(items: list[dict], wider: float = 1.3) -> list[dict]:
    """Items much wider than the median that lie over two or more others that stand side by side."""
    middle = upper(sorted(r["x1"] - r["x0"] for r in items)) if items else 0
    out = []
    for r in items:
        if r["x1"] - r["x0"] <= wider * middle:
            continue
        below = sorted((o for o in items if o is not r and shared(o["x0"], o["x1"], r["x0"], r["x1"]) > 0), key=lambda o: (o["x0"], o["ord"]))
        if any(a["x1"] <= b["x0"] and shared(a["y0"], a["y1"], b["y0"], b["y1"]) > 0 for i, a in enumerate(below) for b in below[i + 1 :]):
            out.append(r)
    return out


def page_order(items: list[dict]) -> list[dict]:
    """reading_order() of the items that cross no columns; those that do are put back by their centre."""
    wide = wide_items(items)
    order = reading_order([r for r in items if r not in wide])
    for w in sorted(wide, key=lambda r: (r["y0"] + r["y1"], r["ord"])):
        middle = (w["y0"] + w["y1"]) / 2
        at = next((i for i, r in enumerate(order) if (r["y0"] + r["y1"]) / 2 > middle and all((o["y0"] + o["y1"]) / 2 > middle for o in order[i : i + 1])), len(order))
        order.insert(at, w)
    return order


def read_order(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, place."""
    return by_group(blocks, ["doc_id", "page_no"], lambda rows: [{"ord": r["ord"], "place": i} for i, r in enumerate(page_order(sorted(rows, key=lambda r: r["ord"])))], "ord long, place long")


def split_lines(lines: list[dict], ratio: float = 0.35) -> list[list[dict]]:
    """Lines (y0, y1, size) cut where the widest distance is over the usual one by a share of the size, again and again."""
    todo, out = [sorted(lines, key=lambda r: (r["y0"], r["line"]))], []
    while todo:
        own = todo.pop()
        gaps = [b["y0"] - a["y1"] for a, b in zip(own, own[1:])]
        if gaps and max(gaps) - upper(sorted(gaps)) > ratio * statistics.median_low(r["size"] for r in own):
            i = gaps.index(max(gaps)) + 1
            todo += [own[i:], own[:i]]
        else:
            out.append(own)
    return out


def interline_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, line, block."""
    return by_group(lines, ["doc_id", "page_no"], lambda rows: [{"line": r["line"], "block": i} for i, b in enumerate(split_lines(rows)) for r in b], "line long, block long")


# ---------------------------------------------------------------- graphics and figures


def joined_box(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def distance(a: Box, b: Box) -> float:
    return max(a[0] - b[2], b[0] - a[2], a[1] - b[3], b[1] - a[3], 0.0)


def graphics(paths: list[dict], most: int = 4000) -> list[list[dict]]:
    """Paths (x0, y0, x1, y1, z) that follow one another in paint order and lie near, as graphics of two or more."""
    if len(paths) > most:
        return []
    out, open_, box = [], [], None
    for p in sorted(paths, key=lambda p: p["z"]):
        own = (p["x0"], p["y0"], p["x1"], p["y1"])
        scale = lambda b: max(b[2] - b[0], b[3] - b[1])
        if box is not None and distance(box, own) <= max(4.0, 0.5 * min(scale(box), scale(own))):
            open_.append(p)
            box = joined_box(box, own)
        else:
            out.append(open_)
            open_, box = [p], own
    out.append(open_)
    return [g for g in out if len(g) >= 2]


def graphic_clusters(paths: DataFrame) -> DataFrame:
    """doc_id, page_no, z, graphic."""
    return by_group(paths, ["doc_id", "page_no"], lambda rows: [{"z": p["z"], "graphic": i} for i, g in enumerate(graphics(rows)) for p in g], "z long, graphic long")


# ---------------------------------------------------------------- texts


def nfkc(s: Column) -> Column:
    """Compatibility composition of a text, as all read-out has it."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return composed(s)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a reply; braces within strings do not count."""
    start = (text or "").find("{")
    while start >= 0:
        depth, inside, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if inside:
                inside, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def reply_objects(s: Column) -> Column:
    @F.pandas_udf("string")
    def found(x: pd.Series) -> pd.Series:
        return x.map(first_object)

    return found(s)
