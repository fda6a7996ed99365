"""Suffix-array dedup: longest previous factors over the suffixes of all texts.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller doc_id, that is,
if the longest previous factor of that place, taken over earlier documents, is `length` or more.

Suffixes that share `length` bytes share the smallest hash among the g-byte strings inside them (their minimizer).  So
suffixes are dealt to shards by minimizer, as strings: runs of neighbouring suffixes with one minimizer.  Four passes over
the blocks find the factors:

1. minimizers that stand in a single document are dropped: nothing can match there;
2. of equal strings, only the first (smallest doc_id) takes part further: a later one is removed as a whole.  A first
   string whose minimizer has no other string has no previous factor that is long enough;
3. each shard sorts the suffixes of the strings that are left, takes the common prefixes of neighbours (up to `length`
   bytes), and from them the longest previous factor of each suffix by previous and next smaller documents;
4. blocks cut out what is covered.

A minimizer with very many neighbourhoods has its suffixes dealt by their whole first `length` bytes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from . import blocks as B
from .blocks import U, Block
from .cms import split_parts

GRAM = 24
#: Bytes of text in a block, and for each shard: what a shard holds grows with the text, not with the cluster.
BLOCK_BYTES, SHARD_BYTES = 3 << 20, 8 << 20
#: Documents with a minimizer from which on its suffixes are dealt one by one.
HOT = 512
#: Suffixes that are sorted in full at once.
RANGE = 1 << 17
#: Bytes of a block whose minimizers are sought at once (more where a document is longer).
SCAN_BYTES = 1 << 19


# ---------------------------------------------------------------- arrays of one text or shard


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of whole suffixes by prefix doubling; shorter suffixes come first."""
    n = len(text)
    rank = text.astype(np.int64) + 1
    k = 1
    while n:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        k *= 2
    return np.zeros(0, np.int64)


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before, and after, with a smaller value; -1 and n where there is none.

    Pointers jump over places that are known to be no smaller, for all places at once.
    """
    n = len(values)

    def back(v: np.ndarray) -> np.ndarray:
        at = np.arange(-1, n - 1)
        todo = np.flatnonzero((at >= 0) & (v[at] >= v))
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[(at[todo] >= 0) & (v[at[todo]] >= v[todo])]
        return at

    return back(values), n - 1 - back(values[::-1])[::-1]


def longest_previous(order: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix (by rank): the longest prefix shared with a suffix of a smaller place.

    order: suffixes by rank; common[i]: common prefix of ranks i-1 and i; place: each suffix's place, ties allowed.
    Memory: the width of `common` for each suffix and power of two below their number.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before, after = smaller_neighbours(place[order])
    # least common prefix over a range of ranks, from a table of powers of two
    table = [common]
    while (1 << len(table)) <= n:
        half = 1 << (len(table) - 1)
        last = table[-1]
        table.append(np.minimum(last[: len(last) - half], last[half:]))
    stack = np.stack([np.pad(t, (0, n - len(t))) for t in table])

    def least(lo: np.ndarray, hi: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = np.zeros(n, common.dtype)
        lo, hi = lo[ok], hi[ok]
        level = np.frexp(hi - lo)[1] - 1
        out[ok] = np.minimum(stack[level, lo], stack[level, hi - (1 << level)])
        return out

    ranks = np.arange(n)
    return np.maximum(least(before + 1, ranks + 1, before >= 0), least(ranks + 1, after + 1, after < n))


# ---------------------------------------------------------------- minimizers


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the `gram` bytes (a multiple of 8) from each place on."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        eight |= data[j : j + len(eight)].astype(np.uint64) << U(8 * j)
    out = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        out = (out ^ eight[j : j + n]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(32)
    return B.mix(out)


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of a[i : i + width] for each i."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Runs:
    """Runs of suffixes of one piece that have one minimizer: minimizer, start, number of suffixes, document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.key = self.start = self.count = self.doc = np.zeros(0, np.int64)
        if len(data) < length:
            self.key = self.key.astype(np.uint64)
            return
        least = sliding_least(gram_hashes(data), length - GRAM + 1)
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        n = np.diff(offsets)
        change[offsets[:-1][(offsets[:-1] < len(least)) & (n > 0)]] = True
        #: A suffix shorter than `length` inside its document takes no part.
        bad = np.zeros(len(least) + 1, bool)
        ends = offsets[1:][n >= length]
        bad[np.minimum(ends - length + 1, len(least))] = True
        change |= bad[: len(least)]
        start = np.flatnonzero(change)
        stop = np.append(start[1:], len(least))
        doc = np.searchsorted(offsets, start, "right") - 1
        ok = offsets[doc + 1] - start >= length
        self.start, self.count, self.doc = start[ok], (stop - start)[ok], doc[ok]
        self.key = least[self.start]


def keys_of(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimizers of a block and in how many of its documents each stands (up to 255)."""
    keys, docs = [], []
    for a, _, data, offsets in block.pieces(SCAN_BYTES):
        r = Runs(data, offsets, length)
        keys.append(r.key)
        docs.append(r.doc + a)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    found, n = np.unique(key[once], return_counts=True)
    return found, np.minimum(n, 255).astype(np.uint8)


def ask_shared(row: dict, length: int, n_shards: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    key, n = shortened(*keys_of(Block(row), length), bits)
    for shard, s in B.by_shard(key, n_shards):
        parts = [B.pack_sorted(key[s] >> U(64 - bits)), B.zip_bytes(n[s])]
        yield 0, shard, b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def shortened(key: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys cut to their first bits, their counts summed: keys that fall together count as shared."""
    cut = key >> U(64 - bits) << U(64 - bits)
    new = np.ones(len(cut), bool)
    new[1:] = cut[1:] != cut[:-1]
    at = np.flatnonzero(new)
    return cut[at], np.minimum(np.add.reduceat(n.astype(np.int64), at), 255).astype(np.uint8) if len(at) else n


def shared(kind: int, shard: int, blobs: list[bytes]) -> list[bytes]:
    """A byte for each key: 0 in one document only, 1 in several, 2 in HOT or more."""
    parts = [split_parts(b) for b in blobs]
    keys = [B.unpack_sorted(p[0]) for p in parts]
    n = np.concatenate([np.frombuffer(B.unzip_bytes(p[1]), np.uint8) for p in parts])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key))
    level = ((total > 1).astype(np.uint8) + (total >= HOT))[at]
    return [B.zip_bytes(x.astype(np.uint8)) for x in np.split(level, np.cumsum([len(x) for x in keys])[:-1])]


# ---------------------------------------------------------------- suffixes


class Parcels:
    """What a block deals out: distinct strings, each with the suffixes that start in its first bytes.

    key: shard key; size: bytes; digest: a hash of all of it; least: smallest doc_id that has it; `of`: the parcel of each occurrence, with the
    place in the block and the document of each occurrence.
    """

    def __init__(self, block: Block, row: dict, length: int, n_shards: int, bits: int):
        key, n = shortened(*keys_of(block, length), bits)
        levels = np.zeros(len(key), np.uint8)
        replies = B.reply_map(row, "shared")
        for shard, s in B.by_shard(key, n_shards):
            levels[s] = np.frombuffer(B.unzip_bytes(replies[0, shard]), np.uint8)
        dealt, place, size, doc, digest = [], [], [], [], []
        for a, _, data, offsets in block.pieces(SCAN_BYTES):
            r = Runs(data, offsets, length)
            level = levels[np.searchsorted(key, r.key >> U(64 - bits) << U(64 - bits))]
            warm, hot = level == 1, level == 2
            starts = np.repeat(r.start[hot] - np.concatenate([[0], np.cumsum(r.count[hot])[:-1]]), r.count[hot]) + np.arange(r.count[hot].sum())
            st = np.concatenate([r.start[warm], starts])
            ln = np.concatenate([r.count[warm] + length - 1, np.full(len(starts), length)])
            h = B.byte_hashes(data, st, st + ln)
            dealt.append(np.concatenate([r.key[warm], h[warm.sum() :]]))
            digest.append(B.byte_hashes(data, st, st + ln, 0xE7037ED1A0B428DB))
            place.append(st + block.offsets[a])
            size.append(ln)
            doc.append(np.concatenate([r.doc[warm], np.repeat(r.doc[hot], r.count[hot])]) + a)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        dealt, digest = join(dealt, np.uint64), join(digest, np.uint64)
        self.place, size, self.doc = join(place, np.int64), join(size, np.int64), join(doc, np.int64)
        ids = block.ids[self.doc]
        order = np.lexsort((ids, size, digest, dealt))
        new = np.ones(len(order), bool)
        d, g, z = dealt[order], digest[order], size[order]
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (z[1:] != z[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        heads = order[new]
        self.key, self.size, self.least, self.at, self.digest = dealt[heads], size[heads], ids[heads], self.place[heads], digest[heads]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def ask_strings(row: dict, length: int, n_shards: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    p = Parcels(Block(row), row, length, n_shards, bits)
    for shard, s in B.by_shard(p.key, n_shards):
        yield 0, shard, framed([B.pack_sorted(p.key[s] >> U(64 - bits)), B.zip_bytes(p.digest[s]), B.pack_ints(p.size[s]), B.pack_ints(p.least[s])])


#: What pass 2 says of a string: no other string has its minimizer and no smaller doc_id has it; a smaller one has it; or
#: its suffixes must be sorted among those of other strings.
ALONE, LATER, SORTED = 0, 1, 2


def strings(kind: int, shard: int, blobs: list[bytes]) -> list[bytes]:
    parts = [split_parts(b) for b in blobs]
    key = np.concatenate(keys := [B.unpack_sorted(p[0]) for p in parts])
    digest = np.concatenate([np.frombuffer(B.unzip_bytes(p[1]), np.uint64) for p in parts])
    size = np.concatenate([B.unpack_ints(p[2]).astype(np.int64) for p in parts])
    ids = np.concatenate([B.unpack_ints(p[3]).astype(np.int64) for p in parts])
    order = np.lexsort((ids, size, digest, key))
    k, d, z, i = key[order], digest[order], size[order], ids[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, (d[1:] != d[:-1]) | (z[1:] != z[:-1]))
    string, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    n_strings = np.bincount(group[new])
    state = np.where(i > i[new][string], LATER, np.where(n_strings[group] > 1, SORTED, ALONE)).astype(np.uint8)
    out = np.empty(len(state), np.uint8)
    out[order] = state
    return [B.zip_bytes(x) for x in np.split(out, np.cumsum([len(x) for x in keys])[:-1])]


def states(p: Parcels, row: dict, n_shards: int) -> np.ndarray:
    out = np.zeros(len(p.key), np.uint8)
    replies = B.reply_map(row, "strings")
    for shard, s in B.by_shard(p.key, n_shards):
        out[s] = np.frombuffer(B.unzip_bytes(replies[0, shard]), np.uint8)
    return out


def ask_factors(row: dict, length: int, n_shards: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    block = Block(row)
    p = Parcels(block, row, length, n_shards, bits)
    at = np.flatnonzero(states(p, row, n_shards) == SORTED)
    for shard, s in B.by_shard(p.key[at], n_shards):
        own = at[s]
        yield 0, shard, framed([B.pack_ints(p.size[own]), B.pack_ints(p.least[own]), B.zip_bytes(block.data[spread(p.at[own], p.size[own])], 3)])


def distinct_strings(text: bytes, size: np.ndarray) -> np.ndarray:
    """Number of the distinct string that each of the strings laid end to end is."""
    seen: dict[bytes, int] = {}
    ends = np.cumsum(size)
    return np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(size))


def ranges(text: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Suffixes at `at`, in ascending order range by range, up to RANGE of them each; within a range in any order.

    Suffixes are split by their next eight bytes until a range is small enough.  A range is true, and may be larger, if
    its suffixes are equal in `length` bytes.
    """
    todo = [(np.arange(len(at)), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= RANGE or depth >= length:
            yield own, depth >= length
            continue
        width = min(8, length - depth)
        part = np.zeros((len(own), 8), np.uint8)
        for j in range(width):
            part[:, j] = text[at[own] + depth + j]
        prefix = part.view(">u8").reshape(-1).astype(np.uint64)
        order = np.argsort(prefix, kind="stable")
        prefix = prefix[order]
        edges = np.append(np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])), len(own))
        del part, prefix
        own, lo, cuts = own[order], 0, []
        while lo < len(own):
            i = int(np.searchsorted(edges, lo + RANGE, "right")) - 1
            hi = int(edges[i]) if edges[i] > lo else int(edges[i + 1])
            # a run that is too long by itself is equal in the bytes looked at
            cuts.append((own[lo:hi], depth + width if hi - lo > RANGE else depth))
            lo = hi
        todo += reversed(cuts)


def reaching(text: np.ndarray, at: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes at `at`: does the longest previous factor over smaller places reach `length`?

    Each range of the suffix order is sorted by its first `length` bytes; suffixes of different ranges share fewer.
    """
    out = np.zeros(len(at), bool)
    for own, equal in ranges(text, at, length):
        if equal:
            out[own] = place[own] > place[own].min()
            continue
        windows = np.ascontiguousarray(sliding_window_view(text, length)[at[own]])
        order = np.argsort(windows.view(f"S{length}").reshape(-1), kind="stable")
        windows = windows[order]
        differ = windows[1:] != windows[:-1]
        common = np.zeros(len(own), np.uint8 if length < 256 else np.int32)
        common[1:] = np.where(differ.any(1), differ.argmax(1), length)
        del windows, differ
        out[own[order]] = longest_previous(order, common, place[own]) >= length
    return out


def factors(kind: int, shard: int, blobs: list[bytes], length: int) -> list[bytes]:
    """Sorts the suffixes of a shard; a bit for each: does its longest previous factor reach `length`?

    A string that several rows with one doc_id have comes several times and is sorted once.
    """
    parts = [split_parts(b) for b in blobs]
    sizes = [B.unpack_ints(p[0]).astype(np.int64) for p in parts]
    size = np.concatenate(sizes)
    ids = np.concatenate([B.unpack_ints(p[1]).astype(np.int64) for p in parts])
    text = b"".join(B.unzip_bytes(p[2]) for p in parts)
    of = distinct_strings(text, size)
    order = np.lexsort((ids, of))
    heads = order[np.append(True, of[order][1:] != of[order][:-1])]
    count = size - length + 1
    own = count[heads]
    reach = reaching(np.frombuffer(text, np.uint8), spread((np.cumsum(size) - size)[heads], own), np.repeat(ids[heads], own), length)
    edge = np.cumsum(own) - own
    later = ids > ids[heads][of]
    out, lo = [], 0
    for x in sizes:
        s = slice(lo, lo + len(x))
        out.append(B.pack_bits(reach[spread(edge[of[s]], count[s])] | np.repeat(later[s], count[s])))
        lo += len(x)
    return out


def cut(row: dict, length: int, n_shards: int, bits: int) -> pa.RecordBatch:
    block = Block(row)
    p = Parcels(block, row, length, n_shards, bits)
    state = states(p, row, n_shards)
    replies = B.reply_map(row, "factors")
    count = p.size - length + 1
    edge = np.concatenate([[0], np.cumsum(count)])
    reach = np.repeat(state == LATER, count)
    at = np.flatnonzero(state == SORTED)
    for shard, s in B.by_shard(p.key[at], n_shards):
        own = at[s]
        reach[spread(edge[own], count[own])] = B.unpack_bits(replies[0, shard], int(count[own].sum()))
    # an occurrence in a later document than the string's first is covered as a whole
    later = block.ids[p.doc] > p.least[p.of]
    flat = reach[spread(edge[p.of], count[p.of])] | np.repeat(later, count[p.of])
    starts = spread(p.place, count[p.of])[flat]
    n_bytes = np.diff(block.offsets)
    gone = B.covered(starts, length, len(block.data))
    total = np.concatenate([[0], np.cumsum(gone)])
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    at = block.offsets[:-1][n_bytes > 0]
    head[at] = gone[at]
    spans = np.concatenate([[0], np.cumsum(head)])
    digests = []
    raw = block.data
    removed = total[block.offsets[1:]] - total[block.offsets[:-1]]
    for i in range(len(block.ids)):
        a, b = block.offsets[i], block.offsets[i + 1]
        digests.append(hashlib.sha256(raw[a:b].tobytes() if not removed[i] else raw[a:b][~gone[a:b]].tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [B.id_array(block.ids), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans[block.offsets[1:]] - spans[block.offsets[:-1]], pa.int64()), pa.array(digests, pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes outside strings of `length` bytes of smaller doc_ids.

    `length` is at least GRAM.  Null and empty texts have no bytes and the digest of nothing.  Rows with one doc_id never
    remove each other's bytes; a null doc_id counts as the largest.  An empty table gives no rows; other columns are
    not looked at.
    """
    spark = docs.sparkSession
    table = B.block_table(docs, BLOCK_BYTES)
    total = B.total_bytes(table)
    n_shards = max(B.partitions(spark), -(-total // SHARD_BYTES))
    bits = min(64, int(np.ceil(np.log2(total // 8 + 2))) + 8)
    known = B.written(B.answer(B.send(table, lambda r: ask_shared(r, length, n_shards, bits)), shared), "shared")
    asked = B.with_replies(table, known, "shared")
    told = B.written(B.answer(B.send(asked, lambda r: ask_strings(r, length, n_shards, bits)), strings), "strings")
    asked = B.with_replies(asked, told, "strings")
    found = B.answer(B.send(asked, lambda r: ask_factors(r, length, n_shards, bits)), lambda k, s, b: factors(k, s, b, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cut(batch.slice(i, 1).to_pylist()[0], length, n_shards, bits)

    return B.with_replies(asked, found, "factors").mapInArrow(B.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
