"""Runs from glyph events, and what fonts are repaired by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T


#: How many pieces of runs are joined at one time, but for a page that has more.
PIECES = 1 << 16

#: What is told of a piece: that it is shown, that it has an x0, that it has an x1.
SHOWN, LEFT, RIGHT = 1, 2, 4


def _alike(p: pa.Array, q: pa.Array) -> np.ndarray:
    """Which of two arrays' values are equal; nulls are.  Arrays with a dictionary share it."""
    if pa.types.is_dictionary(p.type):
        p, q = p.indices, q.indices
    equal = pc.equal(p, q)
    if equal.null_count:
        equal = pc.or_(pc.fill_null(equal, False), pc.and_(pc.is_null(p), pc.is_null(q)))
    return equal.to_numpy(zero_copy_only=False)


def _numbers(a: pa.Array) -> np.ndarray:
    """An array's numbers, NaN where it has none."""
    return pc.cast(a, pa.float64()).to_numpy(zero_copy_only=False)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts or of bytes without nulls, and where each begins; the last place is the end."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(body: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Texts or bytes from each place of bounds to the next."""
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers as bytes, from each place of bounds to the next."""
    return _cut(values.view(np.uint8), bounds * values.itemsize, pa.binary())


def _joined(lo: np.ndarray, hi: np.ndarray, told: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces joined from each place of `at` to the next: their least x0, largest x1, and what is told of any."""
    return np.fmin.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(told, at)


def split_letters(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The letters of texts, which text each is of, and its place there; a text without letters or a null has none."""
    body, offsets = _bytes(pc.fill_null(pc.cast(text, pa.string()), ""))
    starts = np.flatnonzero((body & 0xC0) != 0x80)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    return _cut(body, np.append(starts, len(body)), pa.string()), np.repeat(np.arange(len(n)), n), np.arange(len(starts)) - np.repeat(first[:-1], n)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        goes_on = np.zeros(batch.num_rows, bool)
        goes_on[1:] = _same_page(batch)
        if held:
            goes_on[0] = _same_page(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))[0]
        at = np.flatnonzero(~goes_on)
        if held and len(at):
            yield pa.concat_batches([*held, batch.slice(0, at[-1])])
            held = []
        elif len(at) and at[-1]:
            yield batch.slice(0, at[-1])
        held.append(batch.slice(at[-1]) if len(at) else batch)
    if held:
        yield pa.concat_batches(held)


def _same_page(rows: pa.RecordBatch) -> np.ndarray:
    """Which rows but the first are on the page of the row before."""
    n = rows.num_rows
    after = lambda c: _alike(rows.column(c).slice(0, n - 1), rows.column(c).slice(1))
    return after("doc_id") & after("page_no")


def _in_order(glyphs: pa.RecordBatch, same: np.ndarray) -> pa.RecordBatch:
    """Whole pages with the glyphs of each in order; same: _same_page() of them."""
    seq = pc.fill_null(glyphs.column("seq"), 0).to_numpy(zero_copy_only=False)
    if not (same & (np.diff(seq) < 0)).any():
        return glyphs
    return glyphs.take(pa.array(np.lexsort((seq, np.cumsum(np.append(True, ~same))))))


def strips(glyphs: DataFrame, keys: tuple[str, ...], drift: float, made: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """doc_id, page_no, strip: glyphs whose numbers follow one another and that come together, as pieces of runs.

    No glyph can stand between them, so their runs are known before anything is dealt, but for the first and the last.
    Where glyphs do not come in order, strips are shorter; with made(), see form_runs(), a strip is a page.  The sizes of
    pieces in bytes, their x0 and x1 and what is told of them are packed numbers.
    """
    kind = {f.name: f.dataType.simpleString() for f in glyphs.schema}
    fields = [("seq", kind.get("seq", "bigint")), ("text", "string"), ("size", "binary"), ("x0", "binary"), ("x1", "binary"), ("told", "binary")]
    if made is None:
        fields += [("first", "double"), ("last", "double"), *((f"{k}{end}", kind[k]) for k in keys for end in ("", "_last"))]
    schema = ", ".join(f"`{n}` {t}" for n, t in [("doc_id", kind["doc_id"]), ("page_no", kind["page_no"]), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if made is None else map(made, _whole_pages(batches)):
            n = batch.num_rows
            if not n:
                continue
            near = _same_page(batch)
            if made is not None:
                batch = _in_order(batch, near)
            col = dict(zip(batch.schema.names, batch.columns))
            if made is None:
                near &= np.diff(pc.fill_null(col["seq"], 0).to_numpy(zero_copy_only=False)) == 1
            same = near & (np.abs(np.diff(_numbers(col["baseline"]))) <= drift)
            for k in keys:
                same &= _alike(col[k].slice(0, n - 1), col[k].slice(1))
            at, of = (np.flatnonzero(np.concatenate(([True], ~x))) for x in (same, near))
            left, right = col["x"], pc.add(pc.cast(col["x"], pa.float64()), pc.cast(col["width"], pa.float64()))
            told = SHOWN * pc.fill_null(col["shown"], False).to_numpy(zero_copy_only=False).astype(np.uint8)
            told += sum((bit * a.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8) if a.null_count else np.uint8(bit)) for bit, a in ((LEFT, left), (RIGHT, right)))
            lo, hi, told = _joined(_numbers(pc.fill_null(left, float("inf"))), _numbers(pc.fill_null(right, float("-inf"))), told, at)
            body, bounds = _bytes(pc.fill_null(col["ch"], ""))
            bounds = bounds[np.append(at, n)]
            cuts = np.append(np.searchsorted(at, of), len(at))
            own = pa.array(of)
            out = {c: col[c].take(own) for c in ("doc_id", "page_no", "seq")} | {"text": _cut(body, bounds[cuts], pa.string())}
            out |= {c: _packed(v, cuts) for c, v in (("size", np.diff(bounds)), ("x0", lo), ("x1", hi), ("told", told))}
            if made is None:
                last = pa.array(np.append(of[1:], n) - 1)
                out |= {"first": pc.cast(col["baseline"], pa.float64()).take(own), "last": pc.cast(col["baseline"], pa.float64()).take(last)}
                for k in keys:
                    out |= {k: col[k].take(own), f"{k}_last": col[k].take(last)}
            yield pa.RecordBatch.from_pydict(out)

    own = glyphs if made is not None else glyphs.select("doc_id", "page_no", "seq", "ch", "x", "width", "baseline", "shown", *keys)
    return own.mapInArrow(run, schema).select("doc_id", "page_no", F.struct(*(f"`{n}`" for n, _ in fields)).alias("strip"))


def form_runs(glyphs: DataFrame, keys: tuple[str, ...] = ("font", "fill"), drift: float = 0.01, made: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """doc_id, page_no, run, text, x0, x1: glyphs in order share a run while their keys are equal and the baseline stays.

    glyphs: doc_id, page_no, seq (whole numbers), ch, x, baseline, width, shown (not clipped away) and the keys.  A run with
    nothing shown is dropped.  What is dealt is strips, not glyphs; a page's strips then meet in order.

    With made(), glyphs are rows that stand for glyphs: made() gives those of a batch of rows, page after page.  All rows of a
    page must follow one another in one partition; nothing is dealt then.
    """
    kind = {f.name: f.dataType.simpleString() for f in glyphs.schema}

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        every = lists.flatten()
        strip = dict(zip((f.name for f in every.type), every.flatten()))
        n = len(every)
        page = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        goes_on = np.diff(page) == 0
        if made is None:
            goes_on &= np.abs(_numbers(strip["first"])[1:] - _numbers(strip["last"])[:-1]) <= drift
            for k in keys:
                goes_on &= _alike(strip[f"{k}_last"].slice(0, n - 1), strip[k].slice(1))
        body, _ = _bytes(strip["text"])
        size, lo, hi = (_bytes(strip[c])[0].view(kind) for c, kind in (("size", np.int32), ("x0", np.float64), ("x1", np.float64)))
        told, start = _bytes(strip["told"])
        fresh = np.ones(len(told), bool)
        fresh[start[1:-1]] = ~goes_on
        at = np.flatnonzero(fresh)
        lo, hi, told = _joined(lo, hi, told, at)
        own = np.repeat(page, np.diff(start))[at]
        number = np.arange(len(at)) - np.searchsorted(own, own) + 1
        keep = np.flatnonzero(told & SHOWN)
        text = _cut(body, np.append(0, np.cumsum(size, dtype=np.int64))[np.append(at, len(size))], pa.string())
        out = {c: batch.column(i).take(pa.array(own[keep])) for i, c in enumerate(("doc_id", "page_no"))}
        out |= {"run": pa.array(number[keep], pa.int64()), "text": text.take(pa.array(keep))}
        out |= {c: pa.array(v[keep], mask=(told[keep] & bit) == 0) for c, v, bit in (("x0", lo, LEFT), ("x1", hi, RIGHT))}
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            ends = _bytes(lists.flatten().field("told"))[1][ends]
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PIECES, "right")) - 1)
                yield joined(batch.slice(begin, stop - begin))
                begin = stop

    own = strips(glyphs, keys, drift, made)
    pages = own.select("doc_id", "page_no", F.array("strip").alias("strips")) if made is not None else own.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("strip")).alias("strips"))
    return pages.mapInArrow(run, f"doc_id {kind['doc_id']}, page_no {kind['page_no']}, run long, text string, x0 double, x1 double")


def space_widths(fonts: DataFrame, advances: DataFrame) -> DataFrame:
    """font, space: a width outside (0.05, 0.45) gives way to half the upper median advance, between 0.12 and 0.30."""
    median = advances.where("advance > 0.05").groupBy("font").agg(T.upper_median(F.collect_list("advance")).alias("median"))
    rows = fonts.join(median, "font", "left")
    derived = F.greatest(F.lit(0.12), F.least(F.lit(0.30), 0.5 * F.col("median")))
    fine = (F.col("space") > 0.05) & (F.col("space") < 0.45)
    return rows.select("font", F.when(fine | F.col("median").isNull(), F.col("space")).otherwise(derived).alias("space"))


def font_ids(fonts: DataFrame) -> DataFrame:
    """doc_id, seq, id: family and style as a name; the second of one name gets -2, and so on.

    The style is left out where the family says it.
    """
    family = F.when(F.trim(F.coalesce("family", F.lit(""))) == "", "font").otherwise(F.col("family"))
    bold = (F.col("weight") == "bold") & ~F.contains(F.lower(family), F.lit("bold"))
    slanted = F.col("style").isin("italic", "oblique") & ~F.lower(family).rlike("italic|oblique")
    style = F.when(bold & slanted, "-BoldItalic").when(bold, "-Bold").when(slanted, "-Italic").otherwise("")
    slug = F.regexp_replace(F.concat(family, style), "[^A-Za-z0-9._-]+", "_")
    rows = fonts.withColumn("slug", slug)
    n = F.row_number().over(W.partitionBy("doc_id", "slug").orderBy("seq"))
    return rows.select("doc_id", "seq", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))).alias("id"))


def cmaps(glyphs: DataFrame) -> DataFrame:
    """doc_id, font, ch, code: the first glyph that is one character is that character's."""
    one = glyphs.where(F.length("uni") == 1)
    return one.groupBy("doc_id", "font", F.col("uni").alias("ch")).agg(F.min_by("code", "seq").alias("code"))


def cleaned(glyphs: DataFrame) -> DataFrame:
    """Glyphs without breaks and without blanks that draw nothing; runs left empty vanish with them."""
    return glyphs.where((F.col("kind") != "break") & ~((F.trim(F.col("ch")) == "") & ~F.col("outlined")))


def tag_coverage(refs: DataFrame, runs: DataFrame, least_percent: int = 50) -> DataFrame:
    """doc_id, tagged, total, accepted: a tree of tags counts if it names half the letters of its document or more."""
    named = refs.select("doc_id", F.col("ref").alias("ord")).distinct().withColumn("named", F.lit(True))
    rows = runs.join(named, ["doc_id", "ord"], "left").groupBy("doc_id").agg(F.sum(F.when(F.col("named"), F.col("n_chars")).otherwise(0)).alias("tagged"), F.sum("n_chars").alias("total"))
    return rows.withColumn("accepted", F.col("tagged") * 100 >= F.col("total") * least_percent)
