"""Shared ground of the text operators: byte blocks, word and window hashes, and exchanges between blocks and key shards.

A *block* is a few megabytes of whole texts, written once to a bucketed table in the shared folder.  Every later pass
reads the same blocks, so block numbers are durable: a lost executor re-reads a file, it never renumbers anything.
Passes that compare texts send sorted keys of a block to key *shards* and get one small answer per key back; a key that
occurs in a third of all rows is one entry per block, so no group grows with a hot key.
"""

from __future__ import annotations

import ctypes
import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Stands for a null doc_id: it comes after every other id.
NO_ID = np.iinfo(np.int64).max

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
BLOCK_SCHEMA = "block_id long, n_docs int, n_units long, ids binary, lens binary, body binary, rest binary"


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"
    made().append(path)
    return path


_local = threading.local()


def made() -> list[str]:
    """Folders that this thread's operators have made so far."""
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def drop(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders made since then, but for those of tables named in keep, and their entries in the catalog.

    For tables of an operator that no frame it returns reads; what they led to must have been written.
    """
    entries = named()
    conf = spark._jsc.hadoopConfiguration()
    for folder in made()[since:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")) for name in keep):
            if folder in entries:
                spark.sql(f"DROP TABLE IF EXISTS {entries.pop(folder)}")
            fs.delete(path, True)


def named() -> dict[str, str]:
    """Folder -> catalog name of the bucketed tables that this thread's operators have made."""
    if not hasattr(_local, "names"):
        _local.names = {}
    return _local.names


def bucketed(rows: DataFrame, kind: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by block_id."""
    spark = rows.sparkSession
    name, folder = f"quire_{kind}_{uuid.uuid4().hex}", shared_dir(spark)
    rows.write.bucketBy(partitions(spark), "block_id").option("path", f"{folder}/{kind}").format("parquet").saveAsTable(name)
    named()[folder] = name
    return spark.table(name)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and other stages need the room."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of an Arrow batch that goes to a Python worker (one row may be larger).
BATCH_BYTES = 8 << 20


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases its memory when its task ends.

    The session's batches are bounded by BATCH_BYTES from then on, if they were larger: a batch is held several times
    over, by the JVM, the pipe and the worker.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        given = spark.conf.get(key)
        if not given.rstrip("b").isdigit() or int(given.rstrip("b")) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: base**i and base**-i modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _STEP) -> np.ndarray:
    """A hash of values[start:end] for every span of a few mixed values; equal spans have equal hashes wherever they stand.

    A polynomial modulo 2**64: long spans over two values can be made to collide, so it is for spans of words, not of bytes.
    """
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(_BASE))


#: Strings longer than this are hashed one by one by a library function.
LONG_BYTES = 64


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of every span: eight bytes at a time through a mixer, or BLAKE2 where a span is long.

    Hashes with different seeds are independent.
    """
    n = ends - starts
    out = mix((n.astype(np.uint64) + U(1)) * U(_BASE) ^ U(seed))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    short = n <= LONG_BYTES
    at = np.arange(len(n)) if short.all() else np.flatnonzero(short)
    for j in range(0, LONG_BYTES, 8):
        at = at[n[at] > j]
        if not len(at):
            break
        rest = np.minimum(n[at] - j, 8).astype(np.uint64)
        x = eights[starts[at] + j] << (U(64) - U(8) * rest)
        out[at] = mix(out[at] ^ x * U(_STEP))
    for i in np.flatnonzero(~short).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = U(int.from_bytes(digest, "little"))
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of the texts of a block: maximal runs of bytes that are not in `gap`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        word = ~gap[data]
        inside = word.copy()
        inside[1:] &= word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        inside[heads] = False
        self.starts = np.flatnonzero(word & ~inside)
        last = word
        last[:-1] &= ~inside[1:]
        self.ends = np.flatnonzero(last) + 1
        #: Number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.data = data

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, seed)


def window_starts(first: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words at which a window of k words of one text starts."""
    n = np.maximum(counts - k + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places are covered by spans of one length."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 1000 else np.add(edge, np.bincount(starts, minlength=n + 1), out=edge, casting="unsafe")
    np.subtract(edge, np.bincount(starts + length, minlength=n + 1), out=edge, casting="unsafe") if len(starts) else None
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- texts from Arrow


def texts_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its offsets; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of up to `most` bytes of text (one row may be longer), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts_of(batch, column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    return pc.fill_null(col, int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


# ---------------------------------------------------------------- packing


def zip_bytes(a: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unzip_bytes(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def pack_ints(a: np.ndarray) -> bytes:
    """64-bit integers, small ones in little room: byte planes, compressed."""
    return zip_bytes(np.ascontiguousarray(a.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T)


def unpack_ints(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip_bytes(b), np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack_ints(np.diff(a, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b), dtype=np.uint64)


def pack_bits(a: np.ndarray) -> bytes:
    return zip_bytes(np.packbits(a))


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unzip_bytes(b), np.uint8), count=n).view(bool)


def shard_cuts(n_shards: int) -> np.ndarray:
    """Lowest key of every shard but the first; keys are spread over all 64 bits."""
    return np.array([(i << 64) // n_shards for i in range(1, n_shards)], np.uint64)


def by_shard(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys that belong to one shard."""
    at = np.concatenate([[0], np.searchsorted(keys, shard_cuts(n_shards)), [len(keys)]])
    for s in np.flatnonzero(np.diff(at)):
        yield int(s), slice(int(at[s]), int(at[s + 1]))


# ---------------------------------------------------------------- blocks


class Block:
    """Texts of one row of the block table."""

    def __init__(self, row: dict):
        self.id = row["block_id"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))])
        self.data = np.frombuffer(unzip_bytes(row["body"]), np.uint8)

    def pieces(self, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last document, bytes and offsets of runs of whole documents."""
        at = 0
        while at < len(self.ids):
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + most, "right")) - 1)
            yield at, to, self.data[self.offsets[at] : self.offsets[to]], self.offsets[at : to + 1] - self.offsets[at]
            at = to


def block_table(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", whole: bool = False) -> DataFrame:
    """Writes doc_id and text of all rows as compressed blocks, bucketed by block_id, and returns the table.

    The table is the only copy of the texts that the operators make; joins on block_id read it where it lies, without
    a shuffle of texts.  If `whole`, the other columns stand beside them (`rest`), for whole_rows to put together again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        body: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            out = {"block_id": [(part << 24) + seq], "n_docs": [sum(map(len, ids))], "n_units": [size], "ids": [np.concatenate(ids).tobytes()], "lens": [np.concatenate(lens).tobytes()], "body": [zip_bytes(b"".join(body), 3)], "rest": [packed_rows(rest) if whole else None]}
            seq, size = seq + 1, 0
            for x in (ids, lens, body, rest):
                x.clear()
            return pa.RecordBatch.from_pydict(out, pa.schema([("block_id", pa.int64()), ("n_docs", pa.int32()), ("n_units", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("body", pa.binary()), ("rest", pa.binary())]))

        for batch, data, offsets in pieces(batches, 1 << 20):
            ids.append(ids_of(batch, id_column))
            lens.append(np.diff(offsets))
            body.append(data.tobytes())
            if whole:
                at = batch.schema.get_field_index("text")
                rest.append(batch.set_column(at, "text", batch.column(at).is_valid()))
            size += len(data)
            if size >= block_bytes:
                yield flush()
        if ids:
            yield flush()

    if not whole:
        docs = docs.select(F.col(id_column).cast("long").alias(id_column), F.col("text").cast("string").alias("text"))
    return bucketed(docs.mapInArrow(tidy(run), BLOCK_SCHEMA), "blocks")


def packed_rows(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as stream:
        for b in batches:
            stream.write_batch(b)
    return zip_bytes(sink.getvalue().to_pybytes(), 3)


def whole_rows(row: dict) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a block that holds whole rows, in batches, each with the number of its first row."""
    lens = np.frombuffer(row["lens"], np.int64)
    body, at, byte = pa.py_buffer(unzip_bytes(row["body"])), 0, 0
    for batch in pa.ipc.open_stream(unzip_bytes(row["rest"])):
        n = batch.num_rows
        offsets = np.concatenate([[byte], byte + np.cumsum(lens[at : at + n])]).astype(np.int32)
        c = batch.schema.get_field_index("text")
        valid = batch.column(c)
        text = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), body, pa.array(valid.to_numpy(zero_copy_only=False), pa.bool_()).buffers()[1])
        yield at, batch.set_column(c, "text", text)
        at, byte = at + n, int(offsets[-1])


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_units"), F.lit(0))).first()[0]


def shard_count(spark: SparkSession) -> int:
    return 2 * partitions(spark)


MESSAGE = "kind int, shard int, block_id long, blob binary"


def send(blocks: DataFrame, make: Callable[[dict], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """One message (kind, shard, blob) for what a block has to tell a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = list(make(row))
                if out:
                    yield pa.RecordBatch.from_pydict(
                        {"kind": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([x[1] for x in out], pa.int32()), "block_id": pa.array([row["block_id"]] * len(out), pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())}
                    )

    return blocks.mapInArrow(tidy(run), MESSAGE)


def answer(messages: DataFrame, reply: Callable[[int, int, list[bytes]], list[bytes]]) -> DataFrame:
    """For each shard, the answers to its messages, gathered for each block: (block_id, replies).

    A shard holds a bounded range of keys with one entry per block and key at most.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = reply(table.column("kind")[0].as_py(), table.column("shard")[0].as_py(), table.column("blob").to_pylist())
        release()
        return pa.table({"kind": table.column("kind"), "shard": table.column("shard"), "block_id": table.column("block_id"), "blob": pa.array(out, pa.binary())})

    back = messages.groupBy("kind", "shard").applyInArrow(run, MESSAGE)
    return back.groupBy("block_id").agg(F.collect_list(F.struct("kind", "shard", "blob")).alias("replies"))


def with_replies(blocks: DataFrame, replies: DataFrame, name: str = "replies") -> DataFrame:
    return blocks.join(replies.select("block_id", F.col("replies").alias(name)), "block_id", "left")


def reply_map(row: dict, name: str = "replies") -> dict[tuple[int, int], bytes]:
    return {(x["kind"], x["shard"]): x["blob"] for x in row[name] or ()}
