"""Token-ID output: one zstandard frame a document, with a shared dictionary.

A store is a folder with two Parquet tables.  `dictionary` has one row: the dictionary, its SHA-256 and the bytes an id.
`segments` has a row for each run of documents, in ascending doc_id order.  Layout of a segment (all numbers
little-endian): magic, SHA-256 of the dictionary, bytes an id, number of documents; then for each document its doc_id,
number of ids, and the end of its frame; then the frames.  So one document is read from a few bytes of index and its own
frame, and a store is read from its files alone, by any session.  The dictionary is trained on the serialized ids of a
bounded sample.  Texts are encoded where they lie; only their frames are shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .lpf import spread

MAGIC = b"QTOK1\n"
END_ID = 2
#: Documents and characters of each that the dictionary is trained on, at most, and the dictionary's size.  Of a longer
#: document a stretch of so many characters is taken, from a place that its hash gives.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 800, 20_000, 48 << 10
SEGMENT_BYTES = 2 << 20
#: Bytes of text that are encoded at once (more where a document is longer).
PIECE_BYTES = 2 << 20
#: Bytes of frames that one task puts in order.
SHARD_BYTES = 64 << 20
#: Distinct words that a worker remembers within a task.
REMEMBERED = 300_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
#: Fixed value: the pre-tokenizer pattern that Encoder knows how to cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes by what that pattern takes them for: letters, digits, other signs; runs with other bytes (beyond ASCII, controls,
#: apostrophes, and the sign that special tokens begin with) are not cut.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*b"'<"]] = _ODD
_KIND[BLANK] = 0
_odd = re.compile(r"[^\x21-\x7e]|['<]").search
#: Pieces that go to the library as one text.
JOINED = 256
_HEAD = struct.Struct("<6s32sBI")


def cuttable(path: str) -> bool:
    """Whether the tokenizer file drops white space and never joins what it separates.

    That holds if the last step that can see blanks is a pre-tokenizer that splits by a pattern and removes the rest or
    the blanks, no added token holds a blank, and joined samples give the ids of their parts.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    splits = any(x.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or x.get("type") == "Split" and x.get("behavior") == "Removed" for x in steps)
    if not splits or any(c.isspace() for x in spec.get("added_tokens", []) for c in x["content"]):
        return False
    library = Tokenizer.from_file(path)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    samples = ["a", "Ab", "it's", "'s", "12", "!?", "\u0301", "\u4e2d", "\u200d", "\U0001f642", "e\u0301", *[x["content"] for x in spec.get("added_tokens", [])]]
    return all(ids(x + gap + y) == ids(x) + ids(y) for x in samples for y in samples for gap in (" ", "\n", "\t ", "\r\n", "   "))


def piece_ends(path: str) -> np.ndarray | None:
    """Which ids end a pre-token, if the file cuts lower-cased text by PATTERN and marks the ends of pre-tokens; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("normalizer") or {}
    steps = [x.get("type") for x in steps.get("normalizers", [steps])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    end = spec["model"].get("end_of_word_suffix")
    if set(steps) != {"NFC", "Replace", "Lowercase"} or split[0].get("pattern") != {"Regex": PATTERN} or not split[0].get("invert") or [x["type"] for x in split[1:]] != ["ByteLevel"] or not end:
        return None
    if not all(x["content"].startswith("<") for x in spec["added_tokens"]):
        return None
    vocabulary = spec["model"]["vocab"]
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
    return out


class Encoder:
    """ids of texts, as the library gives them for each piece, remembered by piece.

    Pieces are runs without blanks or, where the tokenizer's file is as piece_ends wants it, lower-cased pre-tokens of
    ASCII runs; many of those go to the library as one text, whose ids fall apart at the ends of pre-tokens.  Where the
    file does not allow runs either (cuttable), whole texts go to the library and nothing is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = cuttable(path)
        self.ends = piece_ends(path) if self.cut else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: ids of all known pieces end to end, and where those of each piece start; piece 0 is the end id.
        self.ids = np.full(1, END_ID, self.dtype)
        self.edge = np.array([0, 1])

    def learn(self, ids: list[int] | np.ndarray, counts: list[int] | np.ndarray, pieces: list[str]) -> None:
        self.known.update(zip(pieces, range(len(self.edge) - 1, len(self.edge) - 1 + len(pieces))))
        self.ids = np.concatenate([self.ids, np.asarray(ids, self.dtype)])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(counts, dtype=np.int64)])

    def each(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            own = pieces[at : at + 4096]
            found = [e.ids for e in self.library.encode_batch_fast(own, add_special_tokens=False)]
            self.learn([i for x in found for i in x], [len(x) for x in found], own)

    def together(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 64 * JOINED):
            own = pieces[at : at + 64 * JOINED]
            texts = [" ".join(own[i : i + JOINED]) for i in range(0, len(own), JOINED)]
            ids = np.array([i for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                self.learn(ids, np.diff(ends, prepend=0), own)
            else:
                self.each(own)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces; those that are not known yet go to the library."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.forget()
        out = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(out < 0)
        if len(at):
            fresh = [pieces[i] for i in at.tolist()]
            odd = fresh
            if self.ends is not None:
                marks = list(map(_odd, fresh))
                odd = [x for x, m in zip(fresh, marks) if m is not None]
                # letters alone are one pre-token, whatever the script, if composing and lower case leave letters alone
                one = [x.isalpha() and x.lower().isalpha() and unicodedata.is_normalized("NFC", x) for x in odd]
                self.together([x for x, m in zip(fresh, marks) if m is None] + [x for x, m in zip(odd, one) if m])
                odd = [x for x, m in zip(odd, one) if not m]
            self.each(odd)
            out[at] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces end to end, where each starts, and the first piece of each text."""
        if not self.cut:
            return data, offsets, np.arange(len(offsets))
        w = B.Words(data, offsets, BLANK)
        length = w.ends - w.starts
        if self.ends is None:
            return data[~BLANK[data]], np.concatenate([[0], np.cumsum(length)]), w.first
        kind = _KIND[data]
        whole = np.zeros(len(w.starts), bool)
        whole[np.searchsorted(w.starts, np.flatnonzero(kind == _ODD), "right") - 1] = True
        word = kind > 0
        kind = kind[word]
        whole_bytes = np.repeat(whole, length)
        run_start = np.concatenate([[0], np.cumsum(length)])
        start = kind == _DIGIT
        start[1:] |= kind[1:] != kind[:-1]
        start &= ~whole_bytes
        start[run_start[:-1]] = True
        edge = np.append(np.flatnonzero(start), len(kind))
        data = data[word]
        return np.where(whole_bytes, data, B.LOWER[data]), edge, np.searchsorted(edge, run_start[w.first])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each with the end id after it, and where each text's ids end."""
        data, edge, first = self.pieces(data, offsets)
        found = pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        # to_numpy makes the strings in one go, to_pylist one scalar after the other
        number = self.numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
        number = np.insert(number, first[1:], 0)
        count = np.diff(self.edge)[number]
        ids = self.ids[spread(self.edge[number], count)]
        if not self.cut:
            self.forget()
        return ids, np.cumsum(count)[first[1:] + np.arange(len(first) - 1)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and the ids of each.  What a worker has learned goes with its task: the next stage needs the room."""
    for batch, data, offsets in B.pieces(batches, PIECE_BYTES):
        ids, ends = encoder(path).encode(data, offsets)
        yield batch, np.split(ids, ends[:-1])
    encoder(path).forget()


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the SAMPLE documents whose doc_id hashes lowest, SAMPLE_CHARS characters of each at most.

    Where many rows share such a doc_id, any SAMPLE of them serve.
    """
    draw = F.xxhash64("doc_id")
    lowest = docs.select(draw.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if lowest is None:
        return b""
    room = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
    stretch = F.substring("text", F.pmod(draw, room).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = docs.where((draw <= lowest) & (F.length("text") > 0)).select("doc_id", stretch.alias("text")).limit(SAMPLE).toArrow()
    samples = [x.tobytes() for _, own in encoded_pieces(rows.sort_by("doc_id").combine_chunks().to_batches(), path) for x in own]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples: their own bytes serve
        return b"".join(samples)[:DICTIONARY_BYTES]


def make_segment(ids: np.ndarray, frames: list[bytes], n_tokens: np.ndarray, dictionary_hash: bytes, width: int) -> bytes:
    index = np.stack([ids, n_tokens, np.cumsum([len(f) for f in frames])], 1).astype("<i8")
    return _HEAD.pack(MAGIC, dictionary_hash, width, len(ids)) + index.tobytes() + b"".join(frames)


class Segment:
    """Read access to a segment, document by document."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, digest, self.width, n = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        index = np.frombuffer(blob, "<i8", 3 * n, _HEAD.size).reshape(n, 3)
        self.ids, self.n_tokens, self.ends = index.T
        self.base = _HEAD.size + 24 * n
        self.blob = memoryview(blob)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> np.ndarray:
        """ids of the i-th document, from its own frame only."""
        a = self.base + (int(self.ends[i - 1]) if i else 0)
        return np.frombuffer(self.reader.decompress(self.blob[a : self.base + int(self.ends[i])], max_output_size=self.width * int(self.n_tokens[i])), f"<u{self.width}")


FRAMES = "doc_id long, draw long, seq long, n int, frame binary"
WRITTEN = "shard int, segment int, before long, n_docs int, n_tokens long, blob binary"


def write_tokens(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Writes a store with the ids of all texts in ascending doc_id order; returns its folder.

    Rows of one doc_id stand in the order of their texts' hashes, null doc_ids last.  `segments` has a row a segment:
    its shard and place, and how many ids of the shard stand before it.
    """
    spark = docs.sparkSession
    folder = folder or B.shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, path)
    digest = hashlib.sha256(dictionary).digest()
    width = encoder(path).dtype.itemsize
    spark.createDataFrame([(bytearray(digest), width, bytearray(dictionary))], "sha256 binary, width int, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        seq = TaskContext.get().partitionId() << 40
        for batch, ids in encoded_pieces(batches, path):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("draw"), pa.array(np.arange(seq, seq + len(ids))), pa.array([len(x) for x in ids], pa.int32()), pa.array([zstd.compress(x) for x in ids], pa.binary())],
                ["doc_id", "draw", "seq", "n", "frame"],
            )
            seq += len(ids)

    made = len(B.made())
    done = B.written(rows.withColumn("draw", F.xxhash64("text")).mapInArrow(B.tidy(frames), FRAMES), "frames")
    total = done.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).first()[0]
    # seq tells equal rows apart, so that any number of them can be dealt to several shards
    order = [F.col("doc_id").asc_nulls_last(), F.col("draw"), F.col("seq")]
    dealt = done.repartitionByRange(max(B.partitions(spark), -(-total // SHARD_BYTES)), *order).sortWithinPartitions(*order)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        frame: list[bytes] = []
        n: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, size
            count = np.concatenate(n)
            out = {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "before": [before], "n_docs": pa.array([len(count)], pa.int32()), "n_tokens": [int(count.sum())], "blob": [make_segment(np.concatenate(ids), frame, count, digest, width)]}
            segment, before, size = segment + 1, before + int(count.sum()), 0
            for x in (ids, frame, n):
                x.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                ids.append(B.ids_of(own))
                n.append(own.column("n").to_numpy().astype(np.int64))
                frame += (blobs := own.column("frame").to_pylist())
                size += sum(map(len, blobs))
                if size >= SEGMENT_BYTES:
                    yield flush()
        if ids:
            yield flush()

    dealt.mapInArrow(B.tidy(segments), WRITTEN).write.parquet(f"{folder}/segments")
    B.drop(spark, made)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of a store."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    segments = spark.read.schema(WRITTEN).parquet(f"{folder}/segments")
    # one sum a shard, and a shard holds tens of megabytes
    sums = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base: dict[int, int] = {}
    total = 0
    for r in sums:
        base[r.shard] = total
        total += r.n
    shared = spark.sparkContext.broadcast((base, dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, dictionary = shared.value
        for batch in batches:
            for shard, before, blob in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("blob")):
                s = Segment(blob.as_py(), dictionary)
                start = base[shard] + before + np.cumsum(s.n_tokens) - s.n_tokens
                crc = [zlib.crc32(s.tokens(i).astype("<u4").tobytes()) for i in range(len(s))]
                yield pa.RecordBatch.from_arrays([B.id_array(np.array(s.ids)), pa.array(start), pa.array(np.array(s.n_tokens)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("shard", "before", "blob").mapInArrow(B.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Writes the texts' ids, reads the files back, and returns doc_id, start, n_tokens, ids_crc32 of every row.

    Null and empty texts have the end id alone.  An empty table gives no rows; other columns are not looked at.
    """
    return read_tokens(docs.sparkSession, write_tokens(docs, path, folder))
