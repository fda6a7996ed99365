"""Benchmark decontamination with spaced seeds.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A seed is a window of words of which a fixed
mask looks at some and ignores the others, so a replaced word breaks only the seeds that look at it.  The masks are chosen
so that every overlap which the verifier admits leaves a seed intact, whichever words are replaced or cut off.  Seeds that a
document and a benchmark item share are put on diagonals (place in the document less place in the item), and each
diagonal is verified word by word: a leak is a stretch of min(13, item) words of which at least 80 % are equal.
Items of 5 to 8 words have shorter masks of their own; items of 1 to 4 words are seeds as a whole, since the 80 % rule allows
them no other word, and their first place in a document is their leak.

A benchmark of up to PART_BYTES is sent to every executor and joined with the seeds of a document where it lies.  A larger
one is a table of seeds: the corpus, in blocks, is read once, seeds that a bit table of fixed size does not rule out are
joined with that table, and the pairs that meet go back to the blocks, where the same verification decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import Block, U

#: Places that each mask looks at, by the words of the item; the last entry serves all items from 9 words on.  Of 5 to 9
#: words one may differ, of 10 to 13 two.
MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
    8: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    9: ((0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7), (0, 1, 3, 4, 7, 8), (0, 1, 2, 3, 5, 7), (0, 2, 4, 5, 6, 7)),
}
LONG = 9
#: Items of up to so many words must be equal word by word.
EXACT = 4
#: A filter leaves documents alone that hold an item of fewer words: one or two common words are no passage.
MIN_WORDS = 4
#: Seeds of a document are dealt to so many tasks a seed.
SALTS = 8
STRETCH = 13
EQUAL_PERCENT = 80
#: Bytes of benchmark text up to which it is sent to every executor.
PART_BYTES = 4 << 20
#: Bits of a seed by which tables rule it out: of the seeds sent, and of a larger benchmark's (16 MB, whatever its size).
TABLE_BITS, FILTER_BITS = 22, 27

GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


#: The same words as a pattern.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[B.Words, np.ndarray]:
    data = B.LOWER[data]
    w = B.Words(data, offsets, GAP)
    return w, w.hashes()


def seed_hashes(wh: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the seed that starts at each word; texts are not looked at."""
    n = max(0, len(wh) - mask[-1])
    out = np.zeros(n, np.uint64)
    for j in mask:
        out = (out + wh[j : j + n]) * U(0x9FB21C651E98DF25 + 2 * j)
        out ^= out >> U(29)
    return out


#: Salts of masks for items of more than EXACT words start here.
EXACT_SALT = U(100 * (EXACT + 1))


def first_places(w: B.Words, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each seed once a text, at its first word."""
    order = np.lexsort((at, key, w.doc[at]))
    k, d = key[order], w.doc[at[order]]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[new], at[order[new]]


def overlap(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int] | None:
    """(equal words, -first word) of an item laid over a text from `diagonal` on, null where no stretch has enough."""
    n = len(item)
    lo, hi = max(0, -diagonal), min(n, len(words) - diagonal)
    same = np.zeros(n, np.int64)
    same[lo:hi] = words[diagonal + lo : diagonal + hi] == item[lo:hi]
    width = min(STRETCH, n)
    total = np.concatenate([[0], np.cumsum(same)])
    if 100 * int((total[width:] - total[:-width]).max()) < EQUAL_PERCENT * width:
        return None
    return int(total[-1]), -max(0, diagonal)


class Benchmark:
    """Seeds of a part of the benchmark, in one sorted array with the item and place of each."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        w, self.words = word_hashes(data, offsets)
        self.ids, self.first, self.counts = ids, w.first, w.counts
        keys, items, places = [], [], []
        #: (mask, salt) of the masks that items of this part need; a salt follows from the size and the mask's number.
        self.masks = []
        for size in sorted({min(int(n), LONG) for n in w.counts if n}):
            own = (w.counts == size) if size < LONG else (w.counts >= LONG)
            for number, mask in enumerate(MASKS[size]):
                self.masks.append((mask, U(100 * size + number + 1)))
                at = B.window_starts(w.first, w.counts, mask[-1] + 1)
                at = at[own[w.doc[at]]]
                keys.append(seed_hashes(self.words, mask)[at] ^ self.masks[-1][1])
                items.append(w.doc[at])
                places.append(at - w.first[w.doc[at]])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(items)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if keys else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.key >> U(64 - TABLE_BITS)] = True

    def hits(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, items and places in the items of all seeds of a text that are seeds of the benchmark."""
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = hi - lo
        to = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.item[to], self.place[to]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, equal words, first word) of every verified overlap, the best for each text and item."""
        w, wh = word_hashes(data, offsets)
        found = []
        for mask, salt in self.masks:
            at = B.window_starts(w.first, w.counts, mask[-1] + 1)
            if len(at):
                key = seed_hashes(wh, mask)[at] ^ salt
                some = self.seen[key >> U(64 - TABLE_BITS)]
                key, at = key[some], at[some]
                if salt < EXACT_SALT:
                    key, at = first_places(w, key, at)
                found.append(self.hits(key, at))
        if not found:
            return []
        word, item, place = (np.concatenate(x) for x in zip(*found))
        if not len(word):
            return []
        lines = np.unique(np.stack([w.doc[word], item, word - w.first[w.doc[word]] - place]), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, it, diagonal in lines.T.tolist():
            own = self.words[self.first[it] : self.first[it] + self.counts[it]]
            got = overlap(wh[w.first[doc] : w.first[doc + 1]], own, diagonal)
            if got is not None:
                best[doc, it] = max(best.get((doc, it), got), got)
        return [(d, i, n, -a) for (d, i), (n, a) in best.items()]


def item_rows(benchmark: DataFrame) -> DataFrame:
    """The items; equal rows are one."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def sent(benchmark: DataFrame) -> Benchmark | None:
    """The benchmark as one object, if its texts have at most PART_BYTES; else null."""
    rows = item_rows(benchmark)
    if rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > PART_BYTES:
        return None
    own = rows.toArrow().combine_chunks()
    batch = own.to_batches()[0] if own.num_rows else pa.RecordBatch.from_pydict({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    return Benchmark(batch.column("item_id").to_numpy(), *B.texts_of(batch))


# ---------------------------------------------------------------- larger benchmarks


def seed_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, words, places): seeds and places of each distinct item, and its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches):
            for i in range(batch.num_rows):
                own = Benchmark(np.zeros(1, np.int64), data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                if len(own.key):
                    salts = pa.array([own.key.view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, 1), batch.column("item").slice(i, 1), pa.array([own.words.tobytes()], pa.binary()), salts, pa.array([own.place], pa.list_(pa.int64()))], ["item_id", "item", "words", "seeds", "places"])

    rows = item_rows(benchmark).withColumn("item", F.xxhash64("item_id", "text"))
    return B.written(rows.mapInArrow(B.tidy(run), "item_id long, item long, words binary, seeds array<long>, places array<long>"), "items")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of a seed's first FILTER_BITS bits: does a seed of the benchmark have it?"""
    cell = F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1
    rows = seeds.select(F.bitmap_bucket_number(cell).alias("k"), F.bitmap_bit_position(cell).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    # at most 2 ** (FILTER_BITS - 15) rows of 4 kB
    for r in rows.collect():
        out[(r.k - 1) << 12 : r.k << 12] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def joined_leaks(table: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(block_id, idx, and LEAK) of every leak in a block table, by a join of seeds."""
    spark = table.sparkSession
    items = seed_table(benchmark)
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    bits = spark.sparkContext.broadcast(seed_filter(seeds))
    masks = [(mask, U(100 * size + i + 1)) for size in MASKS for i, mask in enumerate(MASKS[size])]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for a, _, data, offsets in block.pieces():
                    w, wh = word_hashes(data, offsets)
                    for mask, salt in masks:
                        at = B.window_starts(w.first, w.counts, mask[-1] + 1)
                        key = seed_hashes(wh, mask)[at] ^ salt
                        cell = (key >> U(64 - FILTER_BITS)).astype(np.int64)
                        some = (bits.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                        key, at = key[some], at[some]
                        if salt < EXACT_SALT:
                            key, at = first_places(w, key, at)
                        if len(key):
                            doc = w.doc[at]
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), block.id)), pa.array((doc + a).astype(np.int32)), pa.array(at - w.first[doc])], ["seed", "block_id", "idx", "at"])

    hits = table.drop("rest").mapInArrow(B.tidy(find), "seed long, block_id long, idx int, at long").withColumn("salt", F.pmod("block_id", F.lit(SALTS)))
    seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    pairs = B.written(hits.join(seeds, ["seed", "salt"]).select("block_id", "idx", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct(), "pairs")
    # an item's words go to a block once, however many of its pairs are there
    own = pairs.select("block_id", "item").distinct().join(items.select("item", "item_id", "words"), "item").groupBy("block_id").agg(F.collect_list(F.struct("item", "item_id", "words")).alias("items"))
    wanted = pairs.groupBy("block_id").agg(F.collect_list(F.struct("idx", "diagonal", "item")).alias("pairs")).join(own, "block_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                texts = {x["item"]: (x["item_id"], np.frombuffer(x["words"], np.uint64)) for x in row["items"]}
                by_doc: dict[int, list[dict]] = {}
                for p in row["pairs"]:
                    by_doc.setdefault(p["idx"], []).append(p)
                out = []
                for doc, own in by_doc.items():
                    data = block.data[block.offsets[doc] : block.offsets[doc + 1]]
                    _, wh = word_hashes(data, np.array([0, len(data)]))
                    best: dict[int, tuple] = {}
                    for p in own:
                        item_id, item = texts[p["item"]]
                        got = overlap(wh, item, p["diagonal"])
                        if got is not None:
                            best[p["item"]] = max(best.get(p["item"], (*got, item_id, len(item))), (*got, item_id, len(item)))
                    out += [(block.id, doc, int(block.ids[doc]), item_id, n, words, -first) for n, first, item_id, words in best.values()]
                if out:
                    cols = [np.array(c, np.int64) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), B.id_array(cols[2]), *(pa.array(c) for c in cols[3:])], ["block_id", "idx", "doc_id", "item_id", "n_equal", "item_words", "first_word"])

    return table.drop("rest").join(wanted, "block_id").mapInArrow(B.tidy(verify), f"block_id long, idx int, {LEAK}")


LEAK = "doc_id long, item_id long, n_equal long, item_words long, first_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, item_words, first_word) of every leak of a benchmark item in a document.

    Null and empty texts, items without an id and items without a word give none.  Repeated documents each give their
    leaks; equal rows of the benchmark count as one item, rows of one item_id with other texts as several.  Empty tables
    give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    part = sent(benchmark)
    if part is None:
        return joined_leaks(B.block_table(docs), benchmark).drop("block_id", "idx")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, offsets in B.pieces(batches):
            ids = B.ids_of(batch)
            found = own.leaks(data, offsets)
            if found:
                doc, item, n, first = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([B.id_array(ids[doc]), pa.array(own.ids[item]), pa.array(n), pa.array(own.counts[item].astype(np.int64)), pa.array(first)], ["doc_id", "item_id", "n_equal", "item_words", "first_word"])

    return rows.mapInArrow(B.tidy(run), LEAK)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any leak of an item of MIN_WORDS words or more, with all their columns.

    Null and empty texts stay, repeated rows share their fate, an empty benchmark takes nothing away.
    """
    spark = docs.sparkSession
    rows = item_rows(benchmark)
    benchmark = rows.where(F.size(F.regexp_extract_all("text", F.lit(WORD), 0)) >= MIN_WORDS)
    part = sent(benchmark)
    if part is None:
        table = B.block_table(docs, whole=True)
        gone = joined_leaks(table, benchmark).select("block_id", "idx").distinct().groupBy("block_id").agg(F.collect_list("idx").alias("gone"))

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    keep = np.ones(row["n_docs"], bool)
                    keep[row["gone"] or []] = False
                    for at, b in B.whole_rows(row):
                        yield b.filter(pa.array(keep[at : at + b.num_rows]))

        return table.drop("ids").join(gone, "block_id", "left").mapInArrow(B.tidy(left), docs.schema)
    shared = spark.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, offsets in B.pieces(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in own.leaks(data, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(B.tidy(run), docs.schema)
