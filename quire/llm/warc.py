"""Web archives: the legacy ARC format read, converted to WARC, and both formats as Spark data sources.

An ARC file opens with a version block that names its fields; a record is a header line of five fields (version 1) or ten
(version 2), the last of which declares the length of what follows.  A WARC record is synthesised from it: an identifier from
the file's name and the record's number (so a rerun gives the same), the timestamp from the digits of the date, the type from
scheme and content (responses over HTTP, resources, the version block as warcinfo), and SHA-256 digests of block and payload.
Records with an equal payload become revisits of one of them.

Both sources read a file a task, as a stream: memory is bounded by a record and a batch.  A task writes files of FILE_BYTES
or so under names of its own, and only the files that the commit lists are read, so what lost attempts leave is never seen.
Contents are never shuffled: what is compared is a digest a record, and each file is told which of its records to shorten.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import blocks as B

FILE_BYTES = 64 << 20
BATCH_ROWS = 512
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Rows of one digest are dealt to so many tasks where they meet their first copy.
SALTS = 16
#: Files beyond so many share a task of the conversion.
MOST_TASKS = 10000
LEVEL = 1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of a header line by version, as their version blocks name them (fixed values of the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

# ---------------------------------------------------------------- files


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def listed(uri: str, ending: str) -> list[str]:
    """Addresses of the archives of a folder (those its commits name, where there are any), or of one file."""
    fs, path = opened(uri)
    own = fs.get_file_info(path)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else uri[: uri.index(":") + 1] + "//"
    if own.type == pafs.FileType.File:
        return [uri]
    if own.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    names = [x.path for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File]
    commits = [x for x in names if x.rsplit("/", 1)[-1].startswith("_commit-")]
    if commits:
        names = [f"{c.rsplit('/', 1)[0]}/{n}" for c in commits for n in json.loads(fs.open_input_stream(c).read())]
    return sorted(head + x for x in names if re.search(rf"\.{ending}(\.gz)?$", x))


def stream(uri: str) -> BinaryIO:
    """A file's bytes, unpacked if they are gzip members."""
    fs, path = opened(uri)
    raw = fs.open_input_file(path)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)


class Parts(DataSourceArrowWriter):
    """Writes the records of a task to files of bounded size; each record is a gzip member."""

    kind = ""

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("fileBytes", FILE_BYTES))
        self.versions = [int(x) for x in options.get("versions", "2").split(",")]

    def head(self, name: str) -> bytes:
        raise NotImplementedError

    def record(self, row: dict, name: str, offset: int) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        attempt, names = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", []
        self.version = self.versions[TaskContext.get().partitionId() % len(self.versions)]
        out, size, name = None, 0, ""

        def put(record: bytes) -> None:
            nonlocal size
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for x in (packer.compress(record), packer.flush()):
                out.write(x)
                size += len(x)

        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{attempt}-{len(names):05d}.{self.kind}.gz"
                    out, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    names.append(name)
                    put(self.head(name))
                put(self.record(batch.slice(i, 1).to_pylist()[0], name, size))
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_commit-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.folder)
        for n in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{path}/{n}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class OneFile(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class Files(DataSourceReader):
    """Reads the archives of a folder, one a task; option content=false leaves the records' bytes out."""

    kind = ""

    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.folder, self.schema = options["path"], schema

    def partitions(self) -> list[InputPartition]:
        return [OneFile(x) for x in listed(self.folder, self.kind)] or [OneFile("")]

    def records(self, uri: str) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            yield from batched(self.records(partition.uri), self.schema)


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own, size, names = [], 0, schema.names
    for row in rows:
        own.append({c: row[c] for c in names})
        size += len(row.get("content") or b"")
        if len(own) >= BATCH_ROWS or size >= B.BATCH_BYTES // 2:
            yield pa.RecordBatch.from_pylist(own, schema)
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, schema)


# ---------------------------------------------------------------- ARC


def quoted(url: str | None) -> str:
    """An address for a header line: blanks and controls are percent-encoded, a missing one is a dash."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_head(name: str, version: int, date: str = "19960101000000") -> bytes:
    body = f"{version} 0 quire\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(fields).encode() + b"\n" + body


def arc_record(row: dict, version: int, name: str, offset: int) -> bytes:
    content = row["content"] or b""
    fields = [quoted(row["url"]), row["ip"] or "0.0.0.0", row["date"] or "19960101000000", (row["mime"] or "no-type").replace(" ", "")]
    if version == 2:
        fields += [str(row["status"] or 200), "-", "-", str(offset), name]
    return b"\n" + " ".join([*fields, str(len(content))]).encode() + b"\n" + content


def arc_line(line: bytes) -> dict | None:
    """A header line's fields by its version, or null.  An address may hold blanks, so fields are taken from the end."""
    parts = line.decode("utf-8", "replace").split(" ")
    for version in (2, 1):
        names = ARC_FIELDS[version]
        extra = len(parts) - len(names)
        if extra < 0:
            continue
        values = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
        dated = values["Archive-date"].isdigit() and 4 <= len(values["Archive-date"]) <= 14
        if dated and values["Archive-length"].isdigit() and (version == 1 or re.fullmatch(r"\d{1,3}|-", values["Result-code"])):
            return values | {"version": version}
    return None


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """Header with its blank line, and payload, of an HTTP response."""
    if not content.startswith(b"HTTP/"):
        return None
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.end()], content[found.end() :]) if found else (content, b"")


def arc_records(source: BinaryIO, name: str, content: bool = True) -> Iterator[dict]:
    """The records of an ARC file.  One whose declared length goes beyond the file's end is `truncated`; a line that is no header
    ends the file as damaged."""
    seq = 0
    while line := source.readline():
        if not line.strip():
            continue
        fields = arc_line(line.rstrip(b"\r\n"))
        if fields is None:
            raise ValueError(f"{name}, record {seq}: no ARC header line: {line[:80]!r}")
        length = int(fields["Archive-length"])
        body = source.read(length)
        http = http_parts(body)
        header, payload = http or (b"", body)
        yield {
            "file": name, "seq": seq, "version": fields["version"], "url": None if fields["URL"] == "-" else fields["URL"], "ip": fields["IP-address"], "date": fields["Archive-date"], "mime": fields["Content-type"],
            "status": int(fields["Result-code"]) if fields.get("Result-code", "-").isdigit() else None, "length": length, "truncated": len(body) < length, "type": "warcinfo" if fields["URL"].startswith("filedesc:") else "response" if http else "resource",
            "http_header": header.decode("utf-8", "replace"), "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "content": body if content else None,
        }
        seq += 1


_ARC = [("file", pa.string()), ("seq", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.int32()), ("length", pa.int64()), ("truncated", pa.bool_()), ("type", pa.string()), ("http_header", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _ddl(columns: list[tuple[str, pa.DataType]]) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in columns)


def _columns(columns: list[tuple[str, pa.DataType]], options: dict[str, str]) -> list[tuple[str, pa.DataType]]:
    return columns + [("content", pa.binary())] * (options.get("content", "true").lower() != "false")


class ArcReader(Files):
    kind = "arc"

    def records(self, uri: str) -> Iterator[dict]:
        with stream(uri) as source:
            yield from arc_records(source, uri, "content" in self.schema.names)


class ArcWriter(Parts):
    """Writes rows (url, ip, date, mime, status, content); option versions deals tasks to format versions."""

    kind = "arc"

    def head(self, name: str) -> bytes:
        return arc_head(name, self.version)

    def record(self, row: dict, name: str, offset: int) -> bytes:
        return arc_record(row, self.version, name, offset)


class ArcSource(DataSource):
    """Format `quire_arc`."""

    @classmethod
    def name(cls) -> str:
        return "quire_arc"

    def schema(self) -> str:
        return _ddl(_columns(_ARC, self.options))

    def reader(self, schema) -> DataSourceReader:
        return ArcReader(self.options, pa.schema(_columns(_ARC, self.options)))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return ArcWriter(self.options)


# ---------------------------------------------------------------- WARC


def record_id(file: str, seq: int) -> str:
    """A name-based identifier of a record of a file, wherever the file lies."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{file.rsplit("/", 1)[-1]}#{seq}'.encode()).digest()[:16], version=5)}>"


def timestamp(digits: str) -> str:
    """An ARC date of 4 to 14 digits in the form of WARC; months and days that it leaves out are the first."""
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


_WARC = [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("refers_url", pa.string()), ("refers_date", pa.string()), ("truncated", pa.bool_())]
_READ = [*_WARC, ("http_header", pa.string()), ("payload_bytes", pa.int64())]
#: Header names of the columns (fixed values of the format).
_NAMES = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "url": "WARC-Target-URI", "ip": "WARC-IP-Address", "refers_to": "WARC-Refers-To", "refers_url": "WARC-Refers-To-Target-URI",
    "refers_date": "WARC-Refers-To-Date", "content_type": "Content-Type",
}


def warc_record(row: dict) -> bytes:
    block = row["content"] or b""
    lines = ["WARC/1.1", *(f"{name}: {row[c]}" for c, name in _NAMES.items() if row[c] is not None)]
    lines += [f"WARC-Profile: {REVISIT}"] * (row["type"] == "revisit") + ["WARC-Truncated: unspecified"] * bool(row["truncated"])
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}"] * (row["payload_digest"] is not None)
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def warc_records(source: BinaryIO, name: str, content: bool = True) -> Iterator[dict]:
    """The records of a WARC file; a block or payload that is not what its digest says raises ValueError.

    payload_bytes of a revisit is what its HTTP header declares.
    """
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record: {line[:80]!r}")
        head = {}
        while (line := source.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        block = source.read(int(head["content-length"]))
        digest = head.get("warc-block-digest")
        if digest and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
            raise ValueError(f"{name}: block of {head.get('warc-record-id')} is damaged")
        row = {c: head.get(n.lower()) for c, n in _NAMES.items()} | {"truncated": "warc-truncated" in head, "content": block if content else None}
        http = http_parts(block)
        header, payload = http or (b"", block)
        given = (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        row |= {"http_header": header.decode("utf-8", "replace"), "payload_digest": given, "payload_bytes": len(payload)}
        if row["type"] == "revisit":
            declared = re.search(r"(?im)^content-length:\s*(\d+)", row["http_header"])
            row["payload_bytes"] = int(declared[1]) if declared else None
        elif row["type"] in ("response", "resource"):
            row["payload_digest"] = hashlib.sha256(payload).hexdigest()
            if given and given != row["payload_digest"]:
                raise ValueError(f"{name}: payload of {row['record_id']} is damaged")
        yield row


class WarcReader(Files):
    kind = "warc"

    def records(self, uri: str) -> Iterator[dict]:
        with stream(uri) as source:
            yield from warc_records(source, uri, "content" in self.schema.names)


class WarcWriter(Parts):
    """Writes rows with the columns of the format; each file opens with a warcinfo record of its own."""

    kind = "warc"

    def head(self, name: str) -> bytes:
        row = dict.fromkeys(c for c, _ in _WARC) | {"type": "warcinfo", "record_id": record_id(name, -1), "date": "1996-01-01T00:00:00Z", "content_type": "application/warc-fields"}
        return warc_record(row | {"content": f"software: quire\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()})

    def record(self, row: dict, name: str, offset: int) -> bytes:
        return warc_record(row)


class WarcSource(DataSource):
    """Format `quire_warc`."""

    @classmethod
    def name(cls) -> str:
        return "quire_warc"

    def schema(self) -> str:
        return _ddl(_columns(_READ, self.options))

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, pa.schema(_columns(_READ, self.options)))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (ArcSource, WarcSource):
        spark.dataSource.register(source)


def read_arc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("quire_arc").option("content", str(content).lower()).load(path)


def read_warc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("quire_warc").option("content", str(content).lower()).load(path)


# ---------------------------------------------------------------- conversion


def converted(rec: dict, first: dict | None) -> dict:
    """The WARC record of an ARC record; `first` is the record that it repeats."""
    out = dict.fromkeys(c for c, _ in _WARC) | {"record_id": record_id(rec["file"], rec["seq"]), "type": rec["type"], "date": timestamp(rec["date"]), "truncated": rec["truncated"], "content": rec["content"]}
    if rec["type"] == "warcinfo":
        text = f"software: quire\r\nformat: WARC File Format 1.1\r\nisPartOf: {rec['url']}\r\ndescription: converted from ARC version {rec['version']}\r\n"
        return out | {"content_type": "application/warc-fields", "content": text.encode()}
    out |= {"url": rec["url"], "ip": None if rec["ip"] in ("-", "0.0.0.0") else rec["ip"], "payload_digest": rec["payload_digest"]}
    out["content_type"] = "application/http; msgtype=response" if rec["type"] == "response" else rec["mime"]
    if first is not None:
        out |= {"type": "revisit", "content": http_parts(rec["content"])[0], "refers_to": record_id(first["file"], first["seq"]), "refers_url": first["url"], "refers_date": timestamp(first["date"])}
    return out


def repeats(index: DataFrame, order: list[Column], least: int) -> DataFrame:
    """(file, seq, first) of every response whose payload an earlier one in the order has."""
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), "file", "seq", "url", "date")
    rows = index.where((F.col("type") == "response") & ~F.col("truncated") & (F.col("payload_bytes") >= least)).select("file", "seq", "payload_digest", key.alias("key"))
    firsts = rows.groupBy("payload_digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select("payload_digest", F.col("first").dropFields(*(f"k{i}" for i in range(len(order)))).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.drop("key").withColumn("salt", F.pmod(F.xxhash64("file", "seq"), F.lit(SALTS)).cast("int"))
    return rows.join(firsts, ["payload_digest", "salt"]).where("file <> first.file or seq <> first.seq").select("file", "seq", "first")


def convert(spark: SparkSession, path: str, folder: str, order: list[Column] | None = None, least: int = LEAST_BYTES) -> None:
    """Converts the ARC files of a path to WARC files in a folder.

    Of responses with equal payloads of at least `least` bytes the first by `order` (columns of read_arc; by default the
    date), then by file and number, stays a response; the others become revisits with their HTTP header alone.  Truncated
    records are kept as they are and marked.
    """
    index = B.written(read_arc(spark, path, content=False), "index")
    again = repeats(index, order or [F.col("date")], least).groupBy("file").agg(F.collect_list(F.struct("seq", "first")).alias("again"))
    # as many entries as the file has records at most
    plan = index.select("file").distinct().join(again, "file", "left")
    # rows are names, files are many megabytes: partitions follow the files, not the bytes of the rows
    plan = plan.repartition(max(1, min(len(listed(path, "arc")), MOST_TASKS)), "file")
    columns = [*_WARC, ("content", pa.binary())]
    schema = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                firsts = {x["seq"]: x["first"] for x in row["again"] or ()}
                with stream(row["file"]) as source:
                    yield from batched((converted(r, firsts.get(r["seq"])) for r in arc_records(source, row["file"])), schema)

    register(spark)
    plan.mapInArrow(B.tidy(run), _ddl(columns)).write.format("quire_warc").mode("append").save(folder)


# ---------------------------------------------------------------- pages

#: Header of a page's number in the HTTP responses that are made of pages.
PAGE_HEADER = "X-Page-Id"


def page_rows(pages: DataFrame) -> DataFrame:
    """(url, ip, date, mime, status, content): pages as the HTTP responses of a crawl, a second apart by page_id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.coalesce(F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), page, F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    at = F.timestamp_seconds(F.lit(820454400) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9)))
    return pages.select(F.col("url").cast("string").alias("url"), F.lit(None).cast("string").alias("ip"), F.date_format(at, "yyyyMMddHHmmss").alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.concat(head, html).cast("binary").alias("content"))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as ARC files of both versions, converts these to WARC, and returns what the WARC files hold.

    (page_id, payload_bytes, payload_digest, record_type, refers_to) of every row.  A null html is an empty payload, an
    empty one is never a revisit.  A null page_id has no header line of its own, so it comes back as null, and as first of its
    payload only where no page with a number has that payload.  Rows of one page_id and payload: one is the response, the others
    refer to their own number.  Null addresses are left out, blanks in them percent-encoded.  An empty table gives no rows;
    columns beyond page_id, url and html make no difference.
    """
    spark = pages.sparkSession
    folder = folder or B.shared_dir(spark)
    register(spark)
    page_rows(pages).write.format("quire_arc").option("versions", "1,2").mode("append").save(f"{folder}/arc")
    number = F.regexp_extract("http_header", rf"(?m)^{PAGE_HEADER}: (-?\d+)\r?$", 1)
    number = F.when(number != "", number.cast("long"))
    convert(spark, f"{folder}/arc", f"{folder}/warc", [number.isNull(), number])
    records = read_warc(spark, f"{folder}/warc", content=False).where("type in ('response', 'revisit')")
    rows = B.written(records.select(number.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "record_id", "refers_to"), "records")
    asked = rows.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    firsts = rows.where("record_type = 'response'").join(asked, "record_id").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    seconds = rows.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    seconds = seconds.join(firsts, ["refers_to", "salt"]).select(*columns, F.col("first").alias("refers_to"))
    return rows.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(seconds)
