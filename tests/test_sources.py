"""Files, containers, word tables, the hot folder."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import files, words


def test_kinds(spark):
    raw = [bytearray(b) for b in (b"PK\x03\x04x", b"\x89PNG", b"\xff\xd8\xff\xe1", b"II*\x00", b"MM\x00*", b"%PDF", b"P", b"")]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(raw)] + [(8, None)], "i int, b binary")
    assert [r.k for r in rows.orderBy("i").select(files.kind(F.col("b")).alias("k")).collect()] == ["container", "image/png", "image/jpeg", "image/tiff", "image/tiff", "application/pdf", "application/pdf", "", ""]


def test_folder_leaves_out_what_is_done(spark, tmp_path):
    for name in ("b.pdf", "a/c.pdf", "Done/d.pdf", "e.md.pdf", "f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert [os.path.relpath(r.path.removeprefix("file:"), tmp_path) for r in files.folder(spark, str(tmp_path)).collect()] == ["a/c.pdf", "b.pdf"]


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    return out.getvalue()


def test_members_are_bounded(spark):
    rows = spark.createDataFrame([("p", bytearray(packed({"a.json": b"{}", "big": b"0" * 5000})))], "path string, content binary")
    assert {r.name: len(r.content) for r in files.members(rows).collect()} == {"a.json": 2, "big": 5000}
    for limits in ((4999, 10**6), (10**6, 5001)):
        with pytest.raises(Exception, match="member big"):
            files.members(rows, *limits).collect()


def test_ocr_rows(spark):
    row = lambda level, text, conf="90", line="1": "\t".join([level, "1", "1", "1", line, "1", "5", "6", "7", "8", conf, text])
    given = [row("5", "one"), row("4", "no"), row("5", " "), row("5", "two", "-1", "7"), row("5", "bad", "x"), "5\tshort", row("5", "three", "50")]
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(given)], "doc_id long, no long, row string")
    assert [(r.text, r.conf, r.line) for r in words.ocr_words(rows).orderBy("no").collect()] == [("one", 0.9, 0), ("two", -1.0, 1), ("three", 0.5, 0)]
    page = words.ocr_pages(words.ocr_words(rows)).collect()[0]
    assert (page.text, page.n_words, page.n_doubtful) == ("one three\ntwo", 3, 1)
