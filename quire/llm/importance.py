"""Importance resampling towards a target: documents as rows of a sparse count matrix over hashed features.

A feature is a run of consecutive words, its bucket the crc32 of its bytes.  The documents' counts are written once as blocks
of compressed sparse rows (CSR) in the shared folder.  Column sums of the blocks are the corpus's distribution over buckets,
those of the target's matrix the target's; the logarithm of their smoothed ratio is a bucket's gain.  The product of a block
with the vector of gains gives its documents' weights; a Gumbel draw from the doc_id is added, and the highest scores are
drawn.  The same matrix serves any number of targets.

What goes to the driver and to every task is one number a bucket; `buckets` is a parameter, so the size is fixed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BUCKETS = 10000
MOST_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text whose rows make one block.
ROWS_BYTES = 4 << 20
#: Words of more bytes go to the library one by one.
LONG_BYTES = 64

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksums' states after the bytes of every span."""
    out, n = state.copy(), ends - starts
    at = np.flatnonzero(n <= LONG_BYTES)
    for j in range(LONG_BYTES):
        at = at[n[at] > j]
        if not len(at):
            break
        now = out[at]
        out[at] = now >> 8 ^ _CRC[(now ^ data[starts[at] + j]) & 255]
    for i in np.flatnonzero(n > LONG_BYTES).tolist():
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~state[i])))
    return out


class Rows(NamedTuple):
    """Compressed sparse rows: row i has counts[ends[i-1]:ends[i]] in the columns indices[ends[i-1]:ends[i]]."""

    ends: np.ndarray
    indices: np.ndarray
    counts: np.ndarray
    words: np.ndarray


def sparse_rows(data: np.ndarray, offsets: np.ndarray, buckets: int, most_words: int) -> Rows:
    """Counts of the texts' features by bucket."""
    low = B.LOWER[data]
    w = B.Words(low, offsets, _GAP)
    keys = []
    state = np.full(len(w.starts), 0xFFFFFFFF, np.uint32)
    for k in range(1, most_words + 1):
        at = B.window_starts(w.first, w.counts, k)
        state = state[at] if k == 1 else state[np.searchsorted(last, at)]
        if k > 1:
            state = state >> 8 ^ _CRC[(state ^ 32) & 255]
        state, last = fed(state, low, w.starts[at + k - 1], w.ends[at + k - 1]), at
        keys.append(w.doc[at] * buckets + (~state).astype(np.int64) % buckets)
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    return Rows(np.searchsorted(key, (np.arange(len(offsets) - 1) + 1) * buckets), key % buckets, counts, w.counts)


MATRIX = "block_id long, ids binary, words binary, ends binary, indices binary, counts binary"


def matrix(docs: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, id_column: str = "doc_id") -> DataFrame:
    """Writes the rows' count matrix as CSR blocks and returns the table; a null text is a row of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch, data, offsets in B.pieces(batches, ROWS_BYTES):
            m = sparse_rows(data, offsets, buckets, most_words)
            packed = [B.ids_of(batch, id_column).tobytes(), *(B.zip_bytes(x.astype("<u4")) for x in (m.words, m.ends, m.indices, m.counts))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.binary()) for x in packed)], [x.split()[0] for x in MATRIX.split(", ")])
            block += 1

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col("text").cast("string").alias("text"))
    return B.written(rows.mapInArrow(B.tidy(run), MATRIX), "matrix")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Rows]]:
    """(block_id, ids, rows) of the blocks of a batch."""
    for row in batch.to_pylist():
        words, ends, indices, counts = (np.frombuffer(B.unzip_bytes(row[c]), "<u4").astype(np.int64) for c in ("words", "ends", "indices", "counts"))
        yield row["block_id"], np.frombuffer(row["ids"], np.int64), Rows(ends, indices, counts, words)


SCORED = "block_id long, idx long, doc_id long, n_features long, n_words long, weight long, score long"


def column_sums(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole matrix; a task sends one number a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, rows in unpacked(batch):
                total += np.bincount(rows.indices, rows.counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.mapInArrow(B.tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    n, S, T = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n)))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A document's draw; a null doc_id draws as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(table: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(block_id, idx, doc_id, n_features, n_words, weight, score) of every row of a matrix."""
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, rows in unpacked(batch):
                totals = np.concatenate([[0], np.cumsum(shared.value[rows.indices] * rows.counts)])
                seen = np.concatenate([[0], np.cumsum(rows.counts)])
                ends = np.concatenate([[0], rows.ends])
                weight = totals[ends[1:]] - totals[ends[:-1]]
                draw = np.array([gumbel(x, seed) for x in B.id_array(ids).to_pylist()], np.int64)
                cols = [pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), B.id_array(ids), pa.array(seen[ends[1:]] - seen[ends[:-1]]), pa.array(rows.words), pa.array(weight), pa.array(weight + draw)]
                yield pa.RecordBatch.from_arrays(cols, ["block_id", "idx", "doc_id", "n_features", "n_words", "weight", "score"])

    return table.mapInArrow(B.tidy(run), SCORED)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield batch.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("pos", pa.array(np.arange(at, at + n)))
        at += n


def ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """The rows with a rank for those of the highest scores that are drawn: percent of the rows of at least min_words words.

    Rows are dealt by range of their place in the order and numbered where they lie.
    """
    spark = scored.sparkSession
    rows = B.written(scored, "scored")
    # block and row tell equal rows apart, so that any number of them can be dealt to several tasks
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block_id"), F.col("idx")]
    dealt = rows.where(F.col("n_words") >= min_words).repartitionByRange(B.partitions(spark), *order).sortWithinPartitions(*order)
    placed = B.written(dealt.mapInArrow(_numbered, SCORED + ", part int, pos long"), "placed")
    base, total = [], 0
    # one sum a partition
    for r in placed.groupBy("part").count().orderBy("part").collect():
        base.append((r.part, total))
        total += r["count"]
    numbers = spark.createDataFrame(base, "part int, base long")
    rank = F.col("base") + F.col("pos") + 1
    placed = placed.join(F.broadcast(numbers), "part").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    return placed.drop("part", "pos", "base").unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs, by its likeness to the rows of target.

    Null and empty texts have no features and weigh 0; they have a score but are not drawn.  A null doc_id comes after
    others of its score.  Rows of one doc_id share its draw, each has a rank of its own.  An empty target leaves the
    smoothed corpus's own shares, an empty corpus gives no rows; columns beyond doc_id and text make no difference.
    """
    rows = matrix(docs, buckets, most_words)
    texts = matrix(target.select(F.lit(0).alias("doc_id"), "text"), buckets, most_words)
    gain = gains(column_sums(rows, buckets), column_sums(texts, buckets))
    return ranked(weights(rows, gain, seed), min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
