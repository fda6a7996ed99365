"""Mixing sources to target weights with the cube method.

Each source has a target of words.  A document is taken floor(r) times, r its source's target over its size, and once
more with probability r - floor(r).  The extra copies are drawn by the cube method: inclusion probabilities move along
the null space of two constraints, the number of documents and the number of words, until they are 0 or 1.  That flight
runs in bounded buckets of a source; what is left of them (two documents a bucket at most) flies on together, and the
last two of a source are landed with one constraint given up at a time, words last.  A few changes of the landed choice
(settle) then bring the words nearest to the target.

Both ways to move in a flight keep both constraints: small groups move along the projection of one row's axis (lead),
larger ones do so for their largest rows and take the others three at a time (fly), as the projection costs a pass a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BUCKET = 5000
MOST = 3
_EPS = 1e-9


def targets(sizes: dict[str | None, int], most: int = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Target of each source: weights repeat over the sources by code point, null last; none over `most` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def lead(sizes: np.ndarray, probability: np.ndarray, draws: np.ndarray, most: int = 200, all_below: int = 600) -> np.ndarray:
    """Settles the first rows (the largest) while all later ones can still take up their words.

    A row moves along the projection of its own axis on the null space, so that every open row gives way a little.
    """
    p, s = probability.copy(), sizes.astype(np.float64)
    for i in range(len(p) if len(p) <= all_below else most):
        while _EPS < p[i] < 1 - _EPS:
            at = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
            if len(at) < 4:
                return p
            x = s[at] - s[at].mean()
            spread = (x * x).sum()
            own = int(np.searchsorted(at, i))
            d = -(1 / len(at) + (x[own] * x / spread if spread > 0 else 0))
            d[own] += 1
            d[np.abs(d) < 1e-12] = 0
            if not d[own] > 0:
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.nanmin(np.where(d > 0, (1 - p[at]) / d, np.where(d < 0, p[at] / -d, np.inf)))
                down = np.nanmin(np.where(d > 0, p[at] / d, np.where(d < 0, (1 - p[at]) / -d, np.inf)))
            p[at] += (up if draws[i] * (up + down) < down else -down) * d
            p[p < _EPS] = 0
            p[p > 1 - _EPS] = 1
    return p


def fly(sizes: np.ndarray, probability: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase with the constraints sum(p) and sum(p * size): at most two p are left between 0 and 1.

    draws: a number in [0, 1) for each row, that decides the direction of the step in which the row comes in.  Rows come
    in order, so the last ones are left over.
    """
    p = lead(sizes, probability, draws).tolist()
    s = sizes.tolist()
    u = draws.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            held.append(i)
            if len(held) == 3:
                a, b, c = held
                d = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
                if d == (0, 0, 0):
                    d = (1, -1, 0)
                up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, d) if v)
                down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, d) if v)
                step = up if u[i] * (up + down) < down else -down
                for k, v in zip(held, d):
                    p[k] += step * v
                    if p[k] < _EPS:
                        p[k] = 0.0
                    elif p[k] > 1 - _EPS:
                        p[k] = 1.0
                held = [k for k in held if 0 < p[k] < 1]
    return np.array(p)


def land(sizes: np.ndarray, probability: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Landing of the last two: the number of documents is given up first, then words by a draw."""
    p = probability.copy()
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    if len(left) == 2:
        a, b = left
        d = (float(sizes[b]), -float(sizes[a]))
        if sizes[a] == sizes[b] == 0:
            d = (1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(left, d) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(left, d) if v)
        step = up if draws[b] * (up + down) < down else -down
        for k, v in zip(left, d):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        p[np.abs(p) < _EPS], p[np.abs(p - 1) < _EPS] = 0, 1
        left = [k for k in left if 0 < p[k] < 1]
    for k in left:
        p[k] = float(draws[k] < p[k])
    return p


#: Changes that the landing tries at most, each of one unit or of two for one another.
CHANGES = 8


def settle(sizes: np.ndarray, whole: float, chosen: np.ndarray) -> np.ndarray:
    """The rest of the landing: a few changes of the choice that bring its sum of sizes nearest to `whole`.

    Each change swaps a chosen unit for one that is not, adds one or drops one, whichever leaves the least; the first in
    order of size, then of place, on ties.
    """
    chosen = chosen.copy()
    for _ in range(CHANGES):
        over = float(sizes[chosen].sum() - whole)
        best, change = abs(over), None
        inside, outside = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        for own, drop in ((inside, True), (outside, False)):
            if len(own):
                left = np.abs(over - sizes[own] if drop else over + sizes[own])
                i = int(left.argmin())
                if left[i] < best - 0.5:
                    best, change = float(left[i]), [own[i]]
        if len(inside) and len(outside):
            want = sizes[inside] - over
            at = np.searchsorted(sizes[outside], want)
            for near in (np.minimum(at, len(outside) - 1), np.maximum(at - 1, 0)):
                left = np.abs(over - sizes[inside] + sizes[outside[near]])
                i = int(left.argmin())
                if left[i] < best - 0.5:
                    best, change = float(left[i]), [inside[i], outside[near[i]]]
        if change is None:
            break
        chosen[change] = ~chosen[change]
    return chosen


UNIT = "source string, unit long, size long, p double, draw double"


def flights(units: DataFrame, buckets: int, final: bool) -> DataFrame:
    """One flight over units (source, unit, size, p, draw), in buckets of a source; the final one lands."""

    def run(table: pa.Table) -> pa.Table:
        size, unit, p, draw = (table.column(c).to_numpy() for c in ("size", "unit", "p", "draw"))
        # large documents first, so that small ones are left; ties by unit, so that reruns agree
        order = np.lexsort((unit, -size))
        out = fly(size[order], p[order], draw[order])
        if final:
            out = land(size[order], out, draw[order])
            out = settle(size[order], float((p * size).sum()), out > 0.5).astype(np.float64)
        return pa.table({"source": table.column("source"), "unit": pa.array(unit[order]), "size": pa.array(size[order]), "p": pa.array(out), "draw": pa.array(draw[order])})

    return units.withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(buckets)), F.lit(buckets)) if buckets > 1 else F.lit(0)).groupBy("source", "bucket").applyInArrow(lambda t: run(t.drop_columns(["bucket"])), UNIT)


def count_words(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, unit): size in words; unit tells rows apart, repeated rows share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches):
            size = B.Words(data, offsets).counts.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("unit"), pa.array(size)], ["doc_id", "source", "unit", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "source", "text").alias("unit"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(B.tidy(run), "doc_id long, source string, unit long, size long")


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, unit of every row.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own.  Repeated rows (equal in
    doc_id, source and text) are drawn as one unit, in its first place, and then share its outcome: their common extra
    copy weighs the sum of their sizes.  An empty table gives no rows; other columns are not looked at.
    """
    return drawn(count_words(docs), seed).select("doc_id", "size", "source_size", "target", "taken", "copies", "source", "unit")


def drawn(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of (source, size, unit) and others, with source_size, target, taken and copies."""
    spark = rows.sparkSession
    rows = B.written(rows, "sizes")
    sizes = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes)
    plan = [(s, n, float(goal[s]), min(float(MOST), goal[s] / n) if n else 0.0) for s, n in sizes.items()]
    known = spark.createDataFrame(plan, "source string, source_size long, target double, rate double")
    rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    # a rate of 3 within rounding is 3
    whole = F.floor(F.col("rate") + F.lit(1e-12))
    rows = rows.withColumn("whole", whole)
    share = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    units = rows.where("size > 0").groupBy("source", "unit").agg(F.sum("size").alias("size"), F.max(share).alias("p"))
    units = units.withColumn("draw", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    left = B.written(units, "units")
    done = None
    while True:
        most = left.groupBy("source").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        buckets = max(1, math.ceil(most / BUCKET))
        left = B.written(flights(left, buckets, buckets == 1), "flight")
        landed = left.where("p = 0 or p = 1").select("unit", "source", "p")
        done = landed if done is None else done.union(landed)
        if buckets == 1:
            break
        left = left.where("p > 0 and p < 1")
    done = done.where("p = 1").select("unit", F.lit(1).alias("extra"))
    out = rows.join(done, "unit", "left").withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def row_table(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """All rows of docs, with source and unit after their own columns, as compressed blocks bucketed by block_id."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for b in held:
                    stream.write_batch(b)
            body = B.zip_bytes(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_pydict({"block_id": pa.array([(part << 24) + seq], pa.int64()), "n_docs": pa.array([sum(map(len, held))], pa.int32()), "body": pa.array([body], pa.binary())})

        size = 0
        for batch, _, _ in B.pieces(batches, 1 << 20):
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield packed()
                seq, size, held = seq + 1, 0, []
        if held:
            yield packed()

    # longer than any column's name, so that none clashes
    mark = "_" * (1 + max(map(len, docs.columns)))
    source = F.col("source").cast("string")
    own = docs.select("*", source.alias(f"{mark}source"), F.xxhash64(F.col("doc_id").cast("long"), source, "text").alias(f"{mark}unit"))
    return B.bucketed(own.mapInArrow(B.tidy(run), "block_id long, n_docs int, body binary"), "rows")


def unpacked(body: bytes) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of a block, each with the number of its first row."""
    at = 0
    for batch in pa.ipc.open_stream(B.unzip_bytes(body)):
        yield at, batch
        at += batch.num_rows


def repeated(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns.

    Texts are written once in blocks and never shuffled; only a row's number and its copies travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, body in zip(rows.column("block_id").to_pylist(), rows.column("body")):
                for at, b in unpacked(body.as_py()):
                    n = b.num_rows
                    size = B.Words(*B.texts_of(b)).counts.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(at, at + n)), b.column(b.num_columns - 2), b.column(b.num_columns - 1), pa.array(size)], ["block_id", "at", "source", "unit", "size"])

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                copies = np.zeros(row["n_docs"], np.int64)
                copies[[x["at"] for x in row["taken"]]] = [x["copies"] for x in row["taken"]]
                for at, b in unpacked(row["body"]):
                    own = copies[at : at + b.num_rows]
                    b = pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2])
                    for c in range(1, int(own.max(initial=0)) + 1):
                        yield b.filter(pa.array(own >= c))

    table = row_table(docs)
    sizes = table.select("block_id", "body").mapInArrow(B.tidy(count), "block_id long, at long, source string, unit long, size long")
    taken = drawn(sizes, seed).where("copies > 0").groupBy("block_id").agg(F.collect_list(F.struct("at", "copies")).alias("taken"))
    return table.join(taken, "block_id").select("n_docs", "body", "taken").mapInArrow(B.tidy(repeat), docs.schema)
