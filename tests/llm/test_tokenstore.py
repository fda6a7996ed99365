"""Token stores: odd texts against the library, files read by another session, segments and their dictionary."""

import json
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import blocks, tokenstore
from quire.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
POOL = ["a", "Bc", "ing", "'s", "'", "it's", "12", "3", "!", "?!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "|", "é", "é", "́", "中文", "½", "²", "🙂", "‍", "\x00", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "K", "İ", "ß", " ", "  ", "\n", "\t", "\r", "-", "_", "x" * 30, "'ll", "'RE", "~", "\x7f"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("mode", ["pieces", "runs", "whole"])
def test_ids_equal_the_library(mode):
    rng = random.Random(11)
    texts = ["", *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(3000 if mode == "pieces" else 500))]
    encoder = tokenstore.Encoder(PATH)
    assert encoder.cut and encoder.ends is not None
    if mode != "pieces":
        encoder.ends = None
    encoder.cut = mode != "whole"
    tool, at = library(), 0
    for size in (1, 7, len(texts)):
        own = texts[at : at + size]
        at += size
        data, offsets = blocks.texts_of(pa.RecordBatch.from_pydict({"text": own}))
        ids, ends = encoder.encode(data, offsets)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [[*tool.encode(t, add_special_tokens=False).ids, 2] for t in own]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenstore, "REMEMBERED", 40)
    encoder, tool = tokenstore.Encoder(PATH), library()
    for i in range(30):
        text = f"word{'abcdefghij'[i % 10]} number{i} it's{i}"
        data, offsets = blocks.texts_of(pa.RecordBatch.from_pydict({"text": [text]}))
        assert encoder.encode(data, offsets)[0].tolist() == [*tool.encode(text, add_special_tokens=False).ids, 2]
        assert len(encoder.known) <= 40


def test_other_files_are_not_cut(tmp_path):
    assert not tokenstore.cuttable(vocabulary("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    assert tokenstore.piece_ends(str(other)) is None and tokenstore.cuttable(str(other))


def rows():
    rng = random.Random(3)
    out = [(i, "".join(rng.choice(POOL) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return out + [(7, "again"), (7, "again"), (None, "none"), (None, None), (5, "x" * 50_000), (900, "long text " * 9000)]


def truth(rows):
    tool = library()
    return sorted((i, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes())) if i is not None else (1 << 60, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes())) for i, t in rows for e in [tool.encode(t or "", add_special_tokens=False).ids])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, frame string").repartition(3)


def test_files_are_read_by_another_session(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenstore, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(tokenstore, "SHARD_BYTES", 8000)
    folder = f"{tmp_path}/store"
    own = rows()
    tokenstore.write_tokens(frame(spark, own), PATH, folder)
    code = (
        "import sys, json; sys.path.insert(0, '.');from pyspark.sql import SparkSession;from quire.llm import tokenstore;"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate();"
        f"print('ROWS' + json.dumps([list(r) for r in tokenstore.read_tokens(s, {folder!r}).collect()]))"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    got = json.loads(said.split("ROWS")[1].splitlines()[0])
    assert sorted((1 << 60 if i is None else i, n, c) for i, _, n, c in got) == truth(own)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda i: (i is None, i or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_empty_table_and_no_sample(spark):
    assert tokenstore.token_output(frame(spark, []), PATH).count() == 0
    only = tokenstore.token_output(frame(spark, [(1, None), (2, "")]), PATH).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(only)] == [(1, 0, 1), (2, 1, 1)]


def test_a_segment_needs_its_dictionary():
    blob = tokenstore.make_segment(np.array([4]), [b"x"], np.array([1]), b"\x01" * 32, 2)
    with pytest.raises(ValueError):
        tokenstore.Segment(blob, b"other")
