"""N-gram Jaccard join: a size-aware, heavy-light join of shingle sets, and the classes of its links.

Two sets link if 100 * |intersection| >= 80 * |union|.  Equal sets are one node.  Shingles are ordered from rare to
frequent (document frequencies come from one exchange of block keys); linked sets share an element among the first
n - ceil(0.8 n) + 1, and two among the first n - ceil(0.8 n) + 2.  So a light (small) set enumerates the 2-subsets of its
longer prefix, and a heavy (large) set scans the inverted lists of its shorter prefix.  The boundary is the size at which
the summed costs of both are least, from the costs of all sets by size.

Within a list, sets are told apart by sketches first: the parities of a set's hashes in SKETCH cells.  Cells in which two
sketches differ are at most the elements in which the sets differ, so a pair that differs in too many cells has no link,
and no link is lost.  Of the other pairs, those between classes are verified on the sets themselves, nearest first: each
class proposes a few pairs in each part of a list, then eight times as many, until no part holds back a pair.  Sets that
have come into one class are not compared any more, so a list of n near copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U, Block
from .cms import split_parts
from .graph import joined
from .lpf import shortened

#: Bytes of text in a block; its sets' arrays take about ten times as much.
BLOCK_BYTES = 4 << 20
#: Rows of one list that its elements are charged for when the boundary is chosen.
SCAN = 8
#: Cells of a sketch; members of a list that one task compares with each other.
SKETCH = 1024
PART = 512
#: Pairs that a class proposes in each part of a list: at first, and how many times more in each further round.
PROPOSED, MORE = 1, 8
#: Rounds in which long lists are compared within their parts only.
INNER = 2


class Sets:
    """Shingle sets of a block: values (sorted within a document), first value of each document, fingerprints."""

    def __init__(self, block: Block, k: int):
        values, docs = [], []
        for a, b, data, offsets in block.pieces():
            data = B.LOWER[data]
            w = B.Words(data, offsets)
            wh = w.hashes()
            at = B.window_starts(w.first, w.counts, k)
            short = np.flatnonzero((w.counts > 0) & (w.counts < k))
            starts = np.concatenate([at, w.first[short]])
            ends = np.concatenate([at + k, w.first[short] + w.counts[short]])
            doc = np.concatenate([w.doc[at], short]) + a
            h = B.span_hashes(wh, starts, ends, 0xA0761D6478BD642F)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            values.append(h[new])
            docs.append(doc[new])
        self.values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(block.ids) + 1))
        self.size = np.diff(self.first)
        sums = [np.concatenate([[U(0)], np.cumsum(B.mix(self.values ^ U(s)), dtype=np.uint64)]) for s in (0x1234567, 0x89ABCDEF0)]
        a, b = (B.mix(s[self.first[1:]] - s[self.first[:-1]] + self.size.astype(np.uint64)) for s in sums)
        self.print = np.ascontiguousarray(np.stack([a, b], 1))
        _, at = np.unique(self.print.view("V16").reshape(-1), return_index=True) if len(self.print) else (None, [])
        #: The first of the documents with one set.
        self.heads = np.zeros(len(block.ids), bool)
        self.heads[at] = True
        self.heads &= self.size > 0


def ask_counts(row: dict, k: int, n_shards: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    sets = Sets(Block(row), k)
    key, n = np.unique(sets.values[sets.heads[sets.doc]], return_counts=True)
    key, n = shortened(key, np.minimum(n, 255).astype(np.uint8), bits)
    for shard, s in B.by_shard(key, n_shards):
        parts = [B.pack_sorted(key[s] >> U(64 - bits)), B.zip_bytes(n[s])]
        yield 0, shard, b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def counts(kind: int, shard: int, blobs: list[bytes]) -> list[bytes]:
    """Sets that have each key, up to 65535."""
    parts = [split_parts(b) for b in blobs]
    keys = [B.unpack_sorted(p[0]) for p in parts]
    n = np.concatenate([np.frombuffer(B.unzip_bytes(p[1]), np.uint8) for p in parts])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(at, weights=n, minlength=len(key)), 65535).astype(np.uint16)[at]
    return [B.zip_bytes(x) for x in np.split(total, np.cumsum([len(x) for x in keys])[:-1])]


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def describe(row: dict, k: int, n_shards: int, bits: int, percent: int) -> pa.RecordBatch:
    """A row for each document; sets that can have a link also get their prefix, from rare to frequent."""
    block = Block(row)
    sets = Sets(block, k)
    own = np.unique(sets.values[sets.heads[sets.doc]])
    key, _ = shortened(own, np.ones(len(own), np.uint8), bits)
    df = np.zeros(len(key), np.uint16)
    replies = B.reply_map(row, "counts")
    for shard, s in B.by_shard(key, n_shards):
        df[s] = np.frombuffer(B.unzip_bytes(replies[0, shard]), np.uint16)
    n_docs = len(block.ids)
    out: dict[str, list] = {x: [None] * n_docs for x in ("prefix", "sketch", "hashes")} | {x: [0] * n_docs for x in ("single", "light_cost", "heavy_cost")}
    freq = df[np.searchsorted(key, sets.values >> U(64 - bits) << U(64 - bits))]
    total = np.concatenate([[0], np.cumsum(freq < 2)])
    alone = total[sets.first[1:]] - total[sets.first[:-1]]
    need = least_overlap(sets.size, percent)
    # a set with fewer shared elements than it needs has no link
    for i in np.flatnonzero(sets.heads & (sets.size > 1) & (sets.size - alone >= need)).tolist():
        v, f = sets.values[sets.first[i] : sets.first[i + 1]], freq[sets.first[i] : sets.first[i + 1]]
        n = len(v)
        order = np.lexsort((v, f))[: n - need[i] + 2]
        at = order[f[order] > 1]
        out["prefix"][i] = v[at].view(np.int64)
        out["sketch"][i] = np.packbits(np.bincount((v >> U(64 - int(SKETCH).bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()
        out["hashes"][i] = v.tobytes()
        out["single"][i] = single = max(0, int(n - need[i] + 1 - alone[i]))
        out["light_cost"][i] = len(at) * (len(at) - 1) // 2
        out["heavy_cost"][i] = int(np.minimum(f[at[:single]], SCAN).astype(np.int64).sum())
    raw = sets.print.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            B.id_array(block.ids),
            pa.array([block.id] * len(block.ids), pa.int64()),
            pa.array(np.arange(len(block.ids)), pa.int32()),
            pa.array(sets.size, pa.int64()),
            pa.array([raw[16 * i : 16 * i + 16] for i in range(len(block.ids))], pa.binary()),
            pa.array(out["prefix"], pa.list_(pa.int64())),
            pa.array(out["single"], pa.int32()),
            pa.array(out["light_cost"], pa.int64()),
            pa.array(out["heavy_cost"], pa.int64()),
            pa.array(out["sketch"], pa.binary()),
            pa.array(out["hashes"], pa.binary()),
        ],
        ["doc_id", "block_id", "idx", "n_shingles", "node", "prefix", "single", "light_cost", "heavy_cost", "sketch", "hashes"],
    )


DESCRIBED = "doc_id long, block_id long, idx int, n_shingles long, node binary, prefix array<long>, single int, light_cost long, heavy_cost long, sketch binary, hashes binary"


def boundary(nodes: DataFrame) -> int:
    """The largest light size: where light costs up to it and heavy costs beyond it sum up to the least.

    Sizes are classed by powers of 1.25, so the driver gets a few dozen sums.
    """
    rows = nodes.groupBy(F.floor(F.log(1.25, F.col("n"))).alias("size")).agg(F.sum("light_cost").alias("light"), F.sum("heavy_cost").alias("heavy")).orderBy("size").collect()
    best, most, cost = sum(r.heavy for r in rows), 1, sum(r.heavy for r in rows)
    for r in rows:
        cost += r.light - r.heavy
        if cost < best:
            best, most = cost, int(1.25 ** (r["size"] + 1))
    return most


def lists(nodes: DataFrame, most_light: int, percent: int) -> DataFrame:
    """(sig, node, n): 2-subsets of light sets; single elements of heavy sets and of light sets that reach up to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sigs, counts = [], []
                part = batch.slice(at, 256)
                for n, single, prefix in zip(part.column("n").to_pylist(), part.column("single").to_pylist(), part.column("prefix").to_pylist()):
                    p = np.array(prefix, np.int64).view(np.uint64)
                    own = []
                    if n <= most_light:
                        i, j = np.triu_indices(len(p), 1)
                        own.append(B.mix(B.mix(np.minimum(p[i], p[j])) + np.maximum(p[i], p[j])))
                    if n > most_light or n * 100 >= most_light * percent:
                        own.append(p[:single])
                    own = np.concatenate(own) if own else p[:0]
                    sigs.append(own.view(np.int64))
                    counts.append(len(own))
                take = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), part.column("node").take(take), part.column("n").take(take)], ["sig", "node", "n"])

    return nodes.select("node", "n", "single", "prefix").mapInArrow(B.tidy(run), "sig long, node binary, n long")


def verified(pairs: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets link, from the sets (node, hashes)."""
    both = pairs.join(values.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(values.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(B.tidy(run), "a binary, b binary")


def distinct_lists(live: DataFrame) -> DataFrame:
    """One of the lists with the same members; near copies share many elements, and so many equal lists."""
    own = live.groupBy("sig").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node") % (1 << 40)).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q")).where("size > 1")
    first = own.groupBy("size", "p", "q").agg(F.min("sig").alias("sig")).select("sig")
    return live.join(first, "sig", "left_semi")


def apart(sketch: np.ndarray, a: slice | np.ndarray, b: slice | np.ndarray) -> np.ndarray:
    """Cells in which the sketches (rows of 64-bit words) of a and of b differ."""
    out = np.zeros((len(sketch[a]), len(sketch[b])), np.uint16)
    for c in range(sketch.shape[1]):
        out += np.bitwise_count(sketch[a, c][:, None] ^ sketch[b, c][None, :])
    return out


def proposals(node: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, side: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of one part of a list: places of the pairs to verify, and whether more are held back.

    side: 1 for the members that are compared with all others, 2 for those that are compared with the former only.
    """
    _, root = np.unique(root, return_inverse=True)
    first = np.flatnonzero(side == 1)
    far = apart(sketch, first, slice(None)).astype(np.int64)
    sizes = n[first][:, None] + n[None, :]
    ok = (100 + percent) * far <= (100 - percent) * sizes
    ok &= 100 * np.minimum(n[first][:, None], n[None, :]) >= percent * np.maximum(n[first][:, None], n[None, :])
    ok &= root[first][:, None] != root[None, :]
    i, j = np.nonzero(ok)
    far = far[i, j]
    i = first[i]
    once = (side[j] == 2) | (i < j)
    i, j, far = i[once], j[once], far[once]
    if not len(i):
        return i, j, False
    low = np.minimum(node[i], node[j])
    chosen = np.zeros(len(i), bool)
    for own in (root[i], root[j]):
        order = np.lexsort((low, far, own))
        heads = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        chosen[order[rank < most]] = True
    return i[chosen], j[chosen], not chosen.all()


def parts(live: DataFrame, inner: bool) -> DataFrame:
    """(sig, part, side, node, root, n, sketch): lists dealt into parts of bounded size that cover all pairs of classes.

    A list of up to PART members is one part.  A longer one is dealt into chunks; if `inner`, each chunk is a part.  Else
    members of the list's largest class meet the others only: every chunk of others is a part with each other chunk.
    """
    per_root = live.groupBy("sig", "root").agg(F.count("*").alias("held"))
    lists_ = per_root.groupBy("sig").agg(F.sum("held").alias("size"), F.max(F.struct("held", "root")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    rows = live.join(lists_.select("sig", "size", F.col("top.root").alias("top"), F.col("top.held").alias("held")), "sig")
    spread_ = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    chunks = lambda n: F.ceil(n / F.lit(PART)).cast("int")
    if inner:
        rows = rows.withColumn("part", F.when(F.col("size") <= PART, 0).otherwise(spread_(chunks(F.col("size"))))).withColumn("side", F.lit(1))
        return rows.select("sig", "part", "side", "node", "root", "n", "sketch")
    minor = F.greatest(F.lit(1), chunks(F.col("size") - F.col("held")))
    rows = rows.withColumn("minor", minor).withColumn("own", F.when(F.col("size") <= PART, 0).when(F.col("root") == F.col("top"), F.col("minor") + spread_(chunks(F.col("held")))).otherwise(spread_(F.col("minor"))))
    # part (a, x) with a < minor and a <= x: chunk a is compared with itself (a = x) or with chunk x
    as_first = F.when(F.col("own") < F.col("minor"), F.transform(F.sequence(F.col("own"), F.when(F.col("size") <= PART, 0).otherwise(F.col("minor") + chunks(F.col("held")) - 1).cast("int")), lambda x: F.struct((F.col("own").cast("long") * F.lit(1 << 31) + x).alias("part"), F.lit(1).alias("side"))))
    as_second = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), (F.least("own", "minor") - 1).cast("int")), lambda a: F.struct((a.cast("long") * F.lit(1 << 31) + F.col("own")).alias("part"), F.lit(2).alias("side"))))
    none = F.array().cast("array<struct<part:bigint,side:int>>")
    return rows.withColumn("p", F.explode(F.concat(F.coalesce(as_first, none), F.coalesce(as_second, none)))).select("sig", "p.part", "p.side", "node", "root", "n", "sketch")


def proposed(dealt: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b, more) that the parts of lists propose; a row with null a says that a part holds back pairs."""

    def batch_of(held: pa.Table) -> pa.RecordBatch:
        key = np.stack([held.column(c).to_numpy() for c in ("sig", "part")])
        edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        edges = np.append(edges, held.num_rows)
        raw = lambda c, width: np.frombuffer(b"".join(held.column(c).to_pylist()), f"V{width}")
        node, root = raw("node", 16), raw("root", 16)
        _, both = np.unique(np.concatenate([node, root]), return_inverse=True)
        number, root = both[: len(node)], both[len(node) :]
        n, side = held.column("n").to_numpy(), held.column("side").to_numpy()
        sketch = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
        pairs, more = [], False
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if y - x > 1:
                i, j, rest = proposals(number[x:y], root[x:y], n[x:y], sketch[x:y], side[x:y], most, percent)
                pairs.append(np.stack([i, j]) + x)
                more |= rest
        at = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        low, high = np.where(number[at[0]] < number[at[1]], at, at[::-1])
        _, keep = np.unique(number[low] * len(both) + number[high], return_index=True)
        a, b = (pa.array(node[x[keep]].tolist(), pa.binary()) for x in (low, high))
        if more:
            a, b = pa.concat_arrays([a, pa.nulls(1, pa.binary())]), pa.concat_arrays([b, pa.nulls(1, pa.binary())])
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own]).combine_chunks()
            sig, part = held.column("sig").to_numpy(), held.column("part").to_numpy()
            last = int(((sig != sig[-1]) | (part != part[-1])).sum())
            if last:
                yield batch_of(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield batch_of(held)

    rows = dealt.repartition("sig", "part").sortWithinPartitions("sig", "part", "node")
    return rows.mapInArrow(B.tidy(run), "a binary, b binary")


def links(members: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all sets with a link, from the lists (sig, node, n, sketch)."""
    most, round_, checked, roots = PROPOSED, 0, None, None
    live = members.withColumn("root", F.col("node"))
    while True:
        inner = round_ < INNER
        pairs = B.written(proposed(parts(live, inner), most, percent).distinct(), "proposed")
        more = inner or not pairs.where("a is null").isEmpty()
        new = pairs.where("a is not null")
        if checked is not None:
            new = new.join(checked, ["a", "b"], "left_anti")
        new = B.written(new, "pairs")
        if not new.isEmpty():
            checked = new if checked is None else checked.union(new)
            roots = joined(roots, B.written(verified(new, values, percent), "links"))
        if not more:
            return roots if roots is not None else members.select("node", F.col("node").alias("root")).limit(0)
        if roots is not None:
            live = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        round_, most = round_ + 1, most * MORE


def classes(docs: DataFrame, k: int, percent: int, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The block table, the sets of all rows, and (node, least, root) of all sets with words.

    `least` is the first of the set's rows: the smallest (none, doc_id, block_id, idx), where `none` says that there is
    no doc_id.
    """
    spark = docs.sparkSession
    begun = len(B.made())
    table = B.block_table(docs, BLOCK_BYTES, whole=whole)
    n_shards = B.shard_count(spark)
    bits = min(64, int(np.ceil(np.log2(B.total_bytes(table) // 4 + 2))) + 10)
    texts = table.drop("rest")
    known = B.answer(B.send(texts, lambda r: ask_counts(r, k, n_shards, bits)), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield describe(batch.slice(i, 1).to_pylist()[0], k, n_shards, bits, percent)

    rows = B.written(B.with_replies(texts, known, "counts").mapInArrow(B.tidy(run), DESCRIBED), "sets")
    nodes = rows.where("prefix is not null").groupBy("node").agg(F.min(F.struct("block_id", "idx")).alias("s")).select("s.*")
    nodes = B.written(rows.where("prefix is not null").join(nodes, ["block_id", "idx"], "left_semi").select("node", F.col("n_shingles").alias("n"), "single", "prefix", "light_cost", "heavy_cost", "sketch", "hashes"), "nodes")
    every = lists(nodes, boundary(nodes), percent)
    shared = every.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    members = distinct_lists(B.written(every.join(shared, "sig", "left_semi"), "lists"))
    members = B.written(members.join(nodes.select("node", "sketch"), "node"), "members")
    roots = links(members, nodes.select("node", "hashes"), percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block_id", "idx")
    least = rows.where("n_shingles > 0").groupBy("node").agg(F.min(first).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = B.written(least, "least")
    B.drop(spark, begun, keep=("sets", "least", *(["blocks"] if whole else [])))
    return table, rows, least


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row.

    Texts without words and null texts have the empty set and link with nothing.  A text of fewer than k words has one
    shingle, its whole sequence.  Rows with equal sets are linked; a null doc_id counts as the largest and is answered
    with null only where its class has no other.  An empty table gives no rows; other columns are not looked at.
    """
    _, rows, least = classes(docs, k, percent)
    named = least.join(least.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", F.col("first.doc_id").alias("component_id"))
    full = rows.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
    return full.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest doc_id, with all columns of docs.

    A null doc_id counts as the largest; of rows that share the smallest doc_id the first in the blocks stays.  Rows
    without words are classes of their own and all stay.  Whole rows lie in the blocks and are not shuffled.
    """
    table, rows, least = classes(docs, k, percent, whole=True)
    firsts = least.groupBy("root").agg(F.min("least").alias("least")).select("least.block_id", "least.idx")
    kept = firsts.union(rows.where("n_shingles = 0").select("block_id", "idx")).groupBy("block_id").agg(F.collect_list("idx").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keep = np.zeros(row["n_docs"], bool)
                keep[row["kept"]] = True
                for at, b in B.whole_rows(row):
                    yield b.filter(pa.array(keep[at : at + b.num_rows]))

    return table.drop("ids").join(kept, "block_id").mapInArrow(B.tidy(run), docs.schema)
