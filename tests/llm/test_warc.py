"""Op 13: hand-made archives of both versions, round trips, and the query against a plain walk over the pages."""

import gzip
import hashlib
import io

import pytest

from quire.llm import warc

HTTP = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n"
BODY = HTTP + b"x" * 150


def version_1(*records):
    head = b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"
    out = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n" % (len(head) + 1, head)
    return out + b"".join(b"\n%s %d\n%s\n" % (line, len(body), body) for line, body in records)


def version_2(*records):
    head = b"2 0 Alexa\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    out = b"filedesc://b.arc 0.0.0.0 19970101 text/plain 200 - - 0 b.arc %d\n%s\n" % (len(head) + 1, head)
    return out + b"".join(b"\n%s %d\n%s" % (line, len(body), body) for line, body in records)


OLD = version_1(
    (b"http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html", BODY),
    (b"http://a/with blank 1.2.3.4 1996110414 text/html", HTTP + b"short"),
    (b"dns:a.org 1.2.3.4 19961104142104 text/dns", b"a.org. 600 IN A 1.2.3.4\n" * 9),
)
NEW = version_2(
    (b"http://b/1 1.2.3.5 19990101000000 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 b.arc", BODY),
    (b"http://b/2 1.2.3.5 19950101000000 text/html 200 - - 400 b.arc", b"HTTP/1.1 200 OK\r\nContent-Length: 150\r\n\r\n" + b"x" * 150),
    (b"http://b/3 1.2.3.5 19950101000001 text/html 404 - - 400 b.arc", HTTP + b"short"),
)


def test_header_lines():
    one, two = list(warc.arc_records(io.BytesIO(OLD), "a")), list(warc.arc_records(io.BytesIO(NEW), "b"))
    assert [(r["version"], r["type"], r["url"], r["date"], r["status"]) for r in one] == [
        (1, "warcinfo", "filedesc://a.arc", "19960923142103", None), (1, "response", "http://www.dryswamp.edu:80/index.html", "19961104142103", None),
        (1, "response", "http://a/with blank", "1996110414", None), (1, "resource", "dns:a.org", "19961104142104", None),
    ]
    assert [(r["version"], r["type"], r["url"], r["status"], r["payload_bytes"]) for r in two[1:]] == [(2, "response", "http://b/1", 200, 150), (2, "response", "http://b/2", 200, 150), (2, "response", "http://b/3", 404, 5)]
    assert one[1]["payload_digest"] == two[1]["payload_digest"] == hashlib.sha256(b"x" * 150).hexdigest()


def test_truncated_and_damaged():
    *_, last = warc.arc_records(io.BytesIO(OLD[:-40]), "a")
    assert last["truncated"] and last["length"] == 24 * 9
    with pytest.raises(ValueError, match="no ARC header line"):
        list(warc.arc_records(io.BytesIO(OLD.replace(b"text/dns 216", b"text/dns 100")), "a"))
    good = warc.warc_record(warc.converted(list(warc.arc_records(io.BytesIO(OLD), "a"))[1], None))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.warc_records(io.BytesIO(good.replace(b"xxx", b"xyx")), "a"))


def test_timestamps():
    assert [warc.timestamp(x) for x in ("1996", "199611", "19961104142103")] == ["1996-01-01T00:00:00Z", "1996-11-01T00:00:00Z", "1996-11-04T14:21:03Z"]


def test_conversion(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/a.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in (OLD[:200], OLD[200:])))
    (tmp_path / "arc/b.arc").write_bytes(NEW)
    warc.convert(spark, str(tmp_path / "arc"), f"file://{tmp_path}/warc")
    rows = {r.url: r for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect() if r.type != "warcinfo"}
    assert len(rows) == 6
    first = rows["http://b/2"]
    assert {u: r.type for u, r in rows.items()} == {"http://www.dryswamp.edu:80/index.html": "revisit", "http://a/with blank": "response", "dns:a.org": "resource", "http://b/1": "revisit", "http://b/2": "response", "http://b/3": "response"}
    for u in ("http://b/1", "http://www.dryswamp.edu:80/index.html"):
        assert (rows[u].refers_to, rows[u].refers_url, rows[u].refers_date) == (first.record_id, "http://b/2", "1995-01-01T00:00:00Z")
        assert rows[u].content == HTTP and rows[u].payload_digest == first.payload_digest
    assert bytes(first.content).endswith(b"x" * 150) and first.payload_bytes == 150
    assert rows["dns:a.org"].content_type == "text/dns" and rows["http://a/with blank"].date == "1996-11-04T14:00:00Z" and rows["http://b/1"].ip == "1.2.3.5"
    raw = b"".join(gzip.decompress(x.read_bytes()) for x in (tmp_path / "warc").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 6 + 2 + len(list((tmp_path / "warc").glob("*.warc.gz")))


def truth(rows):
    first = {}
    for p, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and p is not None:
            first[body] = min(first.get(body, p), p)
    out, met = [], set()
    for p, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = len(body) >= 100 and body in met
        met.add(body)
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first.get(body) if again else None))
    return sorted(out, key=repr)


def test_pages(spark):
    long_ = "<p>é</p>\r\n\r\nHTTP/1.1 X-Page-Id: 7\r\n" * 4000
    rows = [(i, [None, "", "short", "y" * 99, "y" * 100, long_, f"<html>{i}" + "z" * 200][i % 7]) for i in range(-5, 90)] + [(None, "y" * 100), (None, "w" * 300), (None, "w" * 300), (4, "y" * 100), (4, "other" * 30), (4, "other" * 30)]
    pages = spark.createDataFrame([(p, [None, "http://a b/é", "http://x\ny"][i % 3], h, 1, "t") for i, (p, h) in enumerate(rows)], "page_id long, url string, html string, seq int, type string").repartition(5)
    got = warc.archived(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == truth(rows)
    assert warc.archived(pages.where("false")).count() == 0


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    warc.register(spark)
    rows = warc.page_rows(spark.createDataFrame([(i, "u", "h" * 500) for i in range(40)], "page_id long, url string, html string")).coalesce(1)
    rows.write.format("quire_arc").option("fileBytes", "600").option("versions", "1").mode("append").save(folder)
    names = list((tmp_path / "out").glob("*.arc.gz"))
    assert len(names) > 3
    (tmp_path / "out/lost-attempt.arc.gz").write_bytes(names[0].read_bytes())
    assert warc.read_arc(spark, folder, content=False).where("type = 'response'").count() == 40
