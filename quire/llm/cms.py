"""Substring dedup of 13-word windows with a count-min prefilter.

Pass 1: each block sketches its window counts in two rows of cells; the sketches are merged by cell range, and a block
gets one bit back for each cell that it touched: whether the merged count is over one.  Collisions only add, so a window
that is in two places is never lost.  Pass 2: windows whose cells are both repeated are grouped exactly, on 96-bit hashes
of their word sequence, for the smallest doc_id that has them.  The sketch's width follows the number of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U, Block

DEPTH = 2
#: Cells a window in each row of the sketch.
LOAD = 8
_SEEDS = (U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B))


class Windows:
    """Windows of a block: 64-bit hash, document and first word of each, and what is needed to cut the texts."""

    def __init__(self, block: Block, k: int):
        hashes, docs, starts, self.words = [], [], [], []
        base = 0
        for a, b, data, offsets in block.pieces():
            w = B.Words(data, offsets)
            wh = w.hashes()
            at = B.window_starts(w.first, w.counts, k)
            hashes.append(B.span_hashes(wh, at, at + k, 0xA0761D6478BD642F))
            docs.append(w.doc[at] + a)
            starts.append(at + base)
            self.words.append((a, b, data, w.starts, w.ends, w.first))
            base += len(wh)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.n_words = base


def check_hashes(block: Block, k: int) -> np.ndarray:
    """A second hash of each window, independent of the first."""
    out = []
    for _, _, data, offsets in block.pieces():
        w = B.Words(data, offsets)
        wh = w.hashes(0xE7037ED1A0B428DB)
        at = B.window_starts(w.first, w.counts, k)
        out.append(B.span_hashes(wh, at, at + k, 0x8EBC6AF09C88C6E3))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cells(hashes: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """Cells of the sketch's row, as the highest bits of a 64-bit key so that shards can cut them by range."""
    return B.mix(hashes ^ _SEEDS[row]) >> U(64 - width_bits) << U(64 - width_bits)


def sketch(row: dict, k: int, width_bits: int, n_shards: int) -> Iterator[tuple[int, int, bytes]]:
    found = Windows(Block(row), k).hash
    for r in range(DEPTH):
        at, counts = np.unique(cells(found, r, width_bits), return_counts=True)
        for shard, s in B.by_shard(at, n_shards):
            many = counts[s] > 1
            blob = B.pack_sorted(at[s] >> U(64 - width_bits))
            yield r, shard, len(blob).to_bytes(4, "little") + blob + B.pack_bits(many)


def merged(kind: int, shard: int, blobs: list[bytes]) -> list[bytes]:
    """Sums the sketches of a range of cells; a bit for each cell of each block: is its count over one?"""
    keys, many = [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        keys.append(B.unpack_sorted(b[4 : 4 + n]))
        many.append(B.unpack_bits(b[4 + n :], len(keys[-1])))
    cell, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(many).astype(np.float64) + 1, minlength=len(cell)) > 1
    ends = np.cumsum([len(x) for x in keys])[:-1]
    return [B.pack_bits(x) for x in np.split(total[at], ends)]


def estimated(found: np.ndarray, replies: dict, width_bits: int, n_shards: int) -> np.ndarray:
    """Which windows the merged sketch takes for repeated."""
    out = np.ones(len(found), bool)
    for r in range(DEPTH):
        at, inverse = np.unique(cells(found, r, width_bits), return_inverse=True)
        bits = np.zeros(len(at), bool)
        for shard, s in B.by_shard(at, n_shards):
            bits[s] = B.unpack_bits(replies[r, shard], s.stop - s.start)
        out &= bits[inverse]
    return out


def candidates(block: Block, row: dict, k: int, width_bits: int, n_shards: int) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows estimated repeated (places), and their distinct hashes in order: hash, check, smallest doc_id, place of each."""
    w = Windows(block, k)
    at = np.flatnonzero(estimated(w.hash, B.reply_map(row, "repeated"), width_bits, n_shards))
    h, c, ids = w.hash[at], check_hashes(block, k)[at], block.ids[w.doc[at]]
    order = np.lexsort((ids, c, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    heads = order[new]
    return w, at, group, h[heads], c[heads], ids[heads]


def ask_exact(row: dict, k: int, width_bits: int, n_shards: int) -> Iterator[tuple[int, int, bytes]]:
    _, _, _, h, c, ids = candidates(Block(row), row, k, width_bits, n_shards)
    for shard, s in B.by_shard(h, n_shards):
        parts = [B.pack_sorted(h[s]), B.zip_bytes((c[s] >> U(32)).astype(np.uint32)), B.pack_ints(ids[s])]
        yield 0, shard, b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def exact(kind: int, shard: int, blobs: list[bytes]) -> list[bytes]:
    """Groups windows exactly; a bit for each: does a smaller doc_id of another block have it?"""
    parts = [split_parts(b) for b in blobs]
    h = [B.unpack_sorted(p[0]) for p in parts]
    c = np.concatenate([np.frombuffer(B.unzip_bytes(p[1]), np.uint32) for p in parts])
    ids = np.concatenate([B.unpack_ints(p[2]).astype(np.int64) for p in parts])
    ends = np.cumsum([len(x) for x in h])[:-1]
    h = np.concatenate(h)
    order = np.lexsort((ids, c, h))
    hs, cs = h[order], c[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    least = ids[order][new][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = ids[order] > least
    return [B.pack_bits(x) for x in np.split(later, ends)]


def cut(row: dict, k: int, width_bits: int, n_shards: int) -> pa.RecordBatch:
    block = Block(row)
    w, at, group, h, _, least = candidates(block, row, k, width_bits, n_shards)
    replies = B.reply_map(row, "later")
    later = np.zeros(len(h), bool)
    for shard, s in B.by_shard(h, n_shards):
        later[s] = B.unpack_bits(replies[0, shard], s.stop - s.start)
    gone_at = w.start[at[later[group] | (block.ids[w.doc[at]] > least[group])]]
    gone = B.covered(gone_at, k, w.n_words)
    n_words = np.zeros(len(block.ids), np.int64)
    n_removed = np.zeros(len(block.ids), np.int64)
    digests: list[str] = []
    base = 0
    for a, _, data, starts, ends, first in w.words:
        raw = data.tobytes()
        kept = ~gone[base : base + len(starts)]
        total = np.concatenate([[0], np.cumsum(kept)])
        n_words[a : a + len(first) - 1] = np.diff(first)
        n_removed[a : a + len(first) - 1] = np.diff(first) - (total[first[1:]] - total[first[:-1]])
        s, e = starts[kept].tolist(), ends[kept].tolist()
        for i in range(len(first) - 1):
            x, y = total[first[i]], total[first[i + 1]]
            digests.append(hashlib.sha256(b" ".join([raw[p:q] for p, q in zip(s[x:y], e[x:y])])).hexdigest())
        base += len(starts)
    return pa.RecordBatch.from_arrays([B.id_array(block.ids), pa.array(n_words), pa.array(n_removed), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_windows(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words outside windows of k words that a smaller doc_id has as well.

    Null and empty texts have no words and the digest of nothing.  Rows of one doc_id never remove each other's words; a
    null doc_id counts as the largest.  An empty table gives no rows, and other columns are not looked at.
    """
    spark = docs.sparkSession
    table = B.block_table(docs)
    n_shards = B.shard_count(spark)
    #: A window has k words of a byte or more, each with a space: there are at most this many.
    most = B.total_bytes(table) // 2 + 1
    width_bits = min(56, max(16, int(np.ceil(np.log2(LOAD * most / 2)))))
    repeated = B.written(B.answer(B.send(table, lambda r: sketch(r, k, width_bits, n_shards)), merged), "sketch")
    asked = B.with_replies(table, repeated, "repeated")
    later = B.answer(B.send(asked, lambda r: ask_exact(r, k, width_bits, n_shards)), exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cut(batch.slice(i, 1).to_pylist()[0], k, width_bits, n_shards)

    return B.with_replies(asked, later, "later").mapInArrow(B.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
