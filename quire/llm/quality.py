"""Quality rules: base counts and gradient-boosted trees over document statistics.

The trees are trained on at most SAMPLE labelled documents (those whose doc_id hashes lowest); all counts and scores
cover every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .gbt import Forest, fit

SAMPLE = 4000
KEEP_FROM = 0.5
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share", "echo_share")
#: More symbols, repeated lines, repeated words or echoes never raise a score.
MONOTONE = {2: -1, 3: -1, 4: -1, 9: -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LINE_SPACE = b" \t\r\x0b\x0c"


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (as named in COUNTS) and features of each text."""
    n_docs = len(offsets) - 1
    w = B.Words(data, offsets)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = per_doc(~B.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[data])
    lines = per_doc(data == 10) + 1
    dup = np.zeros(n_docs, np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(lines > 1):
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(_LINE_SPACE)]
        dup[i] = len(own) - len(set(own))
    wh = w.hashes()
    at = B.window_starts(w.first, w.counts, REPEAT_WINDOW)
    key = B.span_hashes(wh, at, at + REPEAT_WINDOW, 0xA0761D6478BD642F) ^ B.mix(w.doc[at].astype(np.uint64) + U(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    inside = np.concatenate([[0], np.cumsum(B.covered(at[twice], REPEAT_WINDOW, len(wh)))])
    repeat = inside[w.first[1:]] - inside[w.first[:-1]]
    order = np.lexsort((wh, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n_docs)
    echo = np.bincount(w.doc[1:][(wh[1:] == wh[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n_docs)
    n = np.maximum(w.counts, 1)
    c = np.maximum(chars, 1)
    features = np.stack([np.log1p(w.counts), chars / n, symbols / c, dup / lines, repeat / n, per_doc(_UPPER[data]) / c, per_doc(_DIGIT[data]) / c, per_doc(_PUNCT[data]) / c, distinct / n / (1 + 1 / np.log1p(n)), echo / n], 1)
    return np.stack([w.counts, chars, symbols, dup, repeat], 1).astype(np.int64), features


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Trees from labelled documents; None where there are fewer than 20 or one class only.

    Labels without a doc_id or a quality are left out; of several labels for one doc_id the lowest holds, and of several
    rows with it the one whose features come first.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = {r.doc_id: int(r.quality > 0) for r in chosen.collect()}
    spark = docs.sparkSession
    if not rows:
        return None
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(spark.createDataFrame([(i,) for i in rows], "doc_id long")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(B.ids_of(batch)), pa.array(list(statistics(data, offsets)[1]), pa.list_(pa.float64()))], ["doc_id", "features"])

    found = picked.mapInArrow(B.tidy(run), "doc_id long, features array<double>").groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    found.sort(key=lambda r: r.doc_id)
    y = np.array([rows[r.doc_id] for r in found], np.float64)
    if len(y) < 20 or y.min() == y.max():
        return None
    return fit(np.array([r.features for r in found]), y, MONOTONE)


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def verdicts(data: np.ndarray, offsets: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept and score of each text."""
    counts, features = statistics(data, offsets)
    failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
    score = np.ones(len(counts)) if forest is None else forest.score(features)
    return counts, failed, ~failed & (score >= KEEP_FROM), score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and score of every row.

    Null and empty texts have no words and fail the base rule.  Repeated rows are judged alike; an empty table gives no
    rows; without usable labels the base rule decides alone.  Other columns are not looked at.
    """
    forest = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches):
            counts, failed, kept, score = verdicts(data, offsets, forest)
            yield pa.RecordBatch.from_arrays([B.id_array(B.ids_of(batch)), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], [x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(B.tidy(run), SCORED)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    forest = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches):
            yield batch.filter(pa.array(verdicts(data, offsets, forest)[2]))

    return docs.mapInArrow(B.tidy(run), docs.schema)
