"""Containers (zip packages of pages and their model) as a Spark data source, format `quire_container`.

A row is a member: what it is, its page number, its size, and its bytes.  Only a container's directory is read until a row
survives the filters that Spark pushes down (on path, kind, name and page_no), and bytes are inflated only if the schema that
the reader is given has `content`; so a tiered read of two pages opens two members, however large the rest.  Small containers
share a task, by bytes.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.files import MOST_CONTAINER, MOST_MEMBER

#: Fixed values of the format: the package folder, its version, and members by name.
PACKAGE, VERSION = "OEBPS/", "4"
MODEL = ("meta", "outline", "structures", "annots")
#: Bytes of containers that make a task, what opening one counts as, and up to which size one is read at a go.
TASK_BYTES, OPEN_BYTES, WHOLE = 64 << 20, 8 << 10, 256 << 10
SCHEMA = "path string, name string, kind string, page_no int, n_bytes long, content binary"
_TYPES = {"path": pa.string(), "name": pa.string(), "kind": pa.string(), "page_no": pa.int32(), "n_bytes": pa.int64(), "content": pa.binary()}


@lru_cache(1 << 16)
def kind_of(name: str) -> str:
    """What a member is by its name."""
    rest = name.removeprefix(PACKAGE)
    if rest == name:
        return "package"
    for m in MODEL:
        if re.fullmatch(rf"[^/]+/{m}\.json", rest):
            return m
    if re.fullmatch(r"pages/page-\d+\.xhtml", rest):
        return "page"
    if rest == "pages/fonts.svg":
        return "fonts"
    if rest.startswith(("images/", "media/")):
        return rest.split("/", 1)[0].rstrip("s")
    return "package" if rest in ("content.opf", "nav.xhtml", "toc.ncx") or rest.endswith(".css") else "passenger"


def spine(package: bytes) -> list[str]:
    """Member names of the pages in the order that the package states."""
    if b"<!DOCTYPE" in package or b"<!ENTITY" in package:
        raise ValueError("the package has a document type: refused")
    root = ElementTree.fromstring(package)
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    hrefs = {x.get("id"): x.get("href") for x in root.iter() if local(x) == "item"}
    return [PACKAGE + hrefs[x.get("idref")] for x in root.iter() if local(x) == "itemref" and hrefs.get(x.get("idref"))]


def page_numbers(z: zipfile.ZipFile) -> dict[str, int]:
    """Page members by number: as the spine has them, then those it does not name, by name: none is lost."""
    pages = [n for n in z.namelist() if kind_of(n) == "page"]
    stated = spine(read_member(z, z.getinfo(PACKAGE + "content.opf"))) if PACKAGE + "content.opf" in z.namelist() else []
    place = {n: i for i, n in reversed(list(enumerate(stated)))}
    return {n: i for i, n in enumerate(sorted(pages, key=lambda n: (place.get(n, len(place)), n)))}


def read_member(z: zipfile.ZipFile, info: zipfile.ZipInfo, most: int = MOST_MEMBER) -> bytes:
    """A member's bytes, counted while they are inflated."""
    with z.open(info) as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"member {info.filename} inflates beyond the limit")
    return raw


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- filters


def passes(filters: list[D.Filter], row: dict) -> bool:
    """Do the pushed filters take a row?  Null passes none but a test for null."""
    for f in filters:
        v = row[f.attribute[0]]
        if isinstance(f, D.IsNotNull):
            ok = v is not None
        elif isinstance(f, D.IsNull):
            ok = v is None
        elif v is None:
            ok = False
        elif isinstance(f, D.In):
            ok = v in f.value
        elif isinstance(f, D.StringStartsWith):
            ok = v.startswith(f.value)
        elif isinstance(f, D.StringEndsWith):
            ok = v.endswith(f.value)
        elif isinstance(f, D.StringContains):
            ok = f.value in v
        else:
            ok = {D.EqualTo: v == f.value, D.GreaterThan: v > f.value, D.GreaterThanOrEqual: v >= f.value, D.LessThan: v < f.value, D.LessThanOrEqual: v <= f.value}[type(f)]
        if not ok:
            return False
    return True


PUSHED = (D.EqualTo, D.In, D.IsNull, D.IsNotNull, D.StringStartsWith, D.StringEndsWith, D.StringContains, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


class Task(D.InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class ContainerReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.folder, self.ending, self.names = options["path"], options.get("ending", ".epub"), names
        self.most_member, self.most = int(options.get("mostMember", MOST_MEMBER)), int(options.get("mostContainer", MOST_CONTAINER))
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in ("path", "name", "kind", "page_no"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        fs, path = opened(self.folder)
        head = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else "file://"
        own = fs.get_file_info(path)
        if own.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        found = [own] if own.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(self.ending)]
        by_path = [f for f in self.filters if f.attribute == ("path",)]
        out: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if passes(by_path, {"path": head + x.path}):
                cost = x.size + OPEN_BYTES
                if room < cost:
                    out.append([])
                    room = TASK_BYTES
                out[-1].append(head + x.path)
                room -= cost
        return [Task(x) for x in out] or [Task([])]

    def rows(self, uri: str) -> Iterator[dict]:
        fs, path = opened(uri)
        total = 0
        # page numbers are made of the package, so they wait until a page passes all other filters
        plain, by_page = ([f for f in self.filters if (f.attribute == ("page_no",)) == x] for x in (False, True))
        numbers: dict[str, int] | None = None if by_page or "page_no" in self.names else {}
        with fs.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read()) if f.size() <= WHOLE else f) as z:
            meta = [i for i in z.infolist() if kind_of(i.filename) == "meta"]
            if not meta:
                raise ValueError(f"{uri}: no meta.json: a foreign package is a book, not a model")
            version = json.loads(read_member(z, meta[0])).get("version")
            if version != VERSION:
                raise ValueError(f"{uri}: version {version}, where {VERSION} is read")
            for info in z.infolist():
                if info.is_dir():
                    continue
                row = {"path": uri, "name": info.filename, "kind": kind_of(info.filename), "page_no": None, "n_bytes": info.file_size, "content": None}
                if not passes(plain, row):
                    continue
                if row["kind"] == "page":
                    numbers = page_numbers(z) if numbers is None else numbers
                    row["page_no"] = numbers.get(info.filename)
                if not passes(by_page, row):
                    continue
                if "content" in self.names:
                    row["content"] = read_member(z, info, self.most_member)
                    total += len(row["content"])
                    if total > self.most:
                        raise ValueError(f"{uri} inflates beyond the limit")
                yield row

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _TYPES[n]) for n in self.names])
        for uri in partition.uris:
            held, size = [], 0
            for row in self.rows(uri):
                held.append({n: row[n] for n in self.names})
                size += len(row["content"] or b"")
                if size > 4 << 20 or len(held) > 1000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


class ContainerWriter(D.DataSourceArrowWriter):
    """Writes rows (path, name, content), a container's members one after another, to <folder>/<path>.

    A container is written under a name of its task's own and then renamed, so no reader meets half of one and a second
    attempt puts the same file in place.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        at, held = None, []

        def flush() -> None:
            if at is not None:
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in held:
                        # the media type stands first and uncompressed; no dates, so equal members make equal files
                        z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
                name = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(name, compression=None) as out:
                    out.write(body.getbuffer())
                fs.move(name, f"{folder}/{at}")

        for batch in iterator:
            for path, name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content"))):
                if path != at:
                    flush()
                    at, held = path, []
                held.append((name, content or b""))
        flush()
        return D.WriterCommitMessage()


class ContainerSource(D.DataSource):
    """Format `quire_container`."""

    @classmethod
    def name(cls) -> str:
        return "quire_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return ContainerReader(self.options, schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceArrowWriter:
        return ContainerWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and has Spark push filters to Python sources."""
    spark.dataSource.register(ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_containers(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """The members of the containers of a folder, or of one; `columns` is the part of SCHEMA that is wanted."""
    register(spark)
    return spark.read.format("quire_container").options(**options).schema(columns).load(path)


def write_containers(members: DataFrame, folder: str) -> None:
    """Writes members (path, place, name, content) as containers <folder>/<path>."""
    register(members.sparkSession)
    rows = members.repartition("path").sortWithinPartitions("path", "place").select("path", "name", "content")
    rows.write.format("quire_container").mode("append").save(folder)


# ---------------------------------------------------------------- the model's members

_META = "struct<id:string,title:string,authors:array<string>,subject:string,keywords:array<string>,creator:string,producer:string,language:string,created:string,modified:string,custom:map<string,string>,analysis:struct<textSegmented:boolean,headingsDetected:boolean>,layers:array<struct<id:string,name:string,visible:boolean,order:int,ocr:struct<engine:string,prep:string>>>>"
_ANNOTS = "struct<pages:map<string,struct<annots:array<struct<type:string,rect:array<double>,contents:string,author:string,modified:string,color:string,quads:array<array<double>>>>,fields:array<struct<type:string,rect:array<double>,name:string,value:string,options:array<string>,readonly:boolean,required:boolean,hidden:boolean>>>>>"


def text_of(members: DataFrame, kind: str) -> DataFrame:
    """path, json of the members of one kind."""
    return members.where(F.col("kind") == kind).select("path", F.decode("content", "UTF-8").alias("json"))


def page_index(name: Column) -> Column:
    """0-based page of a page's id: p1 is the first."""
    return F.regexp_extract(name, "^p([0-9]+)$", 1).try_cast("int") - 1


def meta_rows(members: DataFrame) -> DataFrame:
    """path and what the document says of itself; absent lists are empty, an absent flag is false."""
    m = text_of(members, "meta").select("path", F.from_json("json", _META).alias("m"))
    flag = lambda c: F.coalesce(F.col(f"m.analysis.{c}"), F.lit(False)).alias(T_NAMES[c])
    listed = lambda c: F.coalesce(F.col(f"m.{c}"), F.array().cast("array<string>")).alias(c)
    return m.select("path", "m.id", "m.title", listed("authors"), "m.subject", listed("keywords"), "m.creator", "m.producer", "m.language", "m.created", "m.modified", F.coalesce("m.custom", F.create_map().cast("map<string,string>")).alias("custom"), flag("textSegmented"), flag("headingsDetected"))


T_NAMES = {"textSegmented": "text_segmented", "headingsDetected": "headings_detected"}


def layer_rows(members: DataFrame) -> DataFrame:
    """path, layer_id, name, visible (unless said otherwise), ord, ocr_engine, ocr_prep."""
    m = text_of(members, "meta").select("path", F.explode(F.from_json("json", _META)["layers"]).alias("l"))
    return m.select("path", F.col("l.id").alias("layer_id"), "l.name", F.coalesce("l.visible", F.lit(True)).alias("visible"), F.coalesce("l.order", F.lit(0)).alias("ord"), F.col("l.ocr.engine").alias("ocr_engine"), F.col("l.ocr.prep").alias("ocr_prep"))


def noted_pages(members: DataFrame) -> DataFrame:
    """path, page_no, annots, fields: the notes of every page as the container has them."""
    pages = text_of(members, "annots").select("path", F.explode(F.from_json("json", _ANNOTS)["pages"]).alias("page", "of"))
    return pages.select("path", page_index(F.col("page")).alias("page_no"), "of.annots", "of.fields")


def _page_things(members: DataFrame, what: str) -> DataFrame:
    return noted_pages(members).select("path", "page_no", F.posexplode(what).alias("no", "a"))


def annotation_rows(members: DataFrame) -> DataFrame:
    """path, page_no, no, type, rect, contents, author, modified, color, quads of every annotation."""
    return _page_things(members, "annots").select("path", "page_no", "no", "a.*")


def field_rows(members: DataFrame) -> DataFrame:
    """path, page_no, no, type, rect, name, value, options, read_only, required, hidden of every form field."""
    rows = _page_things(members, "fields")
    flag = lambda c, n: F.coalesce(F.col(f"a.{c}"), F.lit(False)).alias(n)
    return rows.select("path", "page_no", "no", "a.type", "a.rect", "a.name", "a.value", F.coalesce("a.options", F.array().cast("array<string>")).alias("options"), flag("readonly", "read_only"), flag("required", "required"), flag("hidden", "hidden"))


def walked(roots: list[dict]) -> Iterator[tuple[int, int, int, int, dict]]:
    """(pre, last, parent, depth, node) of trees of any depth, without recursion: pre counts nodes as they are met, last is the
    greatest pre below a node, its own included; a root's parent is -1."""
    out: list[list] = []
    stack = [(x, -1, 0) for x in reversed(roots)]
    while stack:
        node, parent, depth = stack.pop()
        pre = len(out)
        out.append([pre, pre, parent, depth, node])
        stack += [(x, pre, depth + 1) for x in reversed(node.get("children") or [])]
    for pre, last, parent, _, _ in reversed(out):
        if parent >= 0:
            out[parent][1] = max(out[parent][1], out[pre][1])
    yield from map(tuple, out)


def _tree_rows(members: DataFrame, kind: str, schema: str, rows_of) -> DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<struct<page_no:int,node:string>>": pa.list_(pa.struct([("page_no", pa.int32()), ("node", pa.string())]))}
        own = pa.schema([(x.split(" ")[0], types[x.split(" ")[1]]) for x in schema.split(", ")])
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("json").to_pylist()):
                found = [dict(zip(names, (path, *r))) for r in rows_of(json.loads(raw))]
                for at in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_pylist(found[at : at + 4096], own)

    return text_of(members, kind).mapInArrow(run, schema)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"p([0-9]+)", value or "")
    return int(found[1]) - 1 if found else None


def outline_rows(members: DataFrame) -> DataFrame:
    """path, entry, last, parent, depth, title, page_no, y of every bookmark, in the order of a walk."""

    def rows_of(m: dict) -> Iterator[tuple]:
        for pre, last, parent, depth, x in walked(m.get("bookmarks") or []):
            yield pre, last, parent, depth, str(x.get("title", "")), _page(x.get("page")), float(x["y"]) if x.get("y") is not None else None

    return _tree_rows(members, "outline", "path string, entry int, last int, parent int, depth int, title string, page_no int, y double", rows_of)


STRUCTURE = "path string, structure string, is_default boolean, node int, last int, parent int, depth int, type string, level int, ordered boolean, col_span int, row_span int, head string, text string, lang string, alt string, refs array<struct<page_no:int,node:string>>"
#: What a cell is the head of.
HEADS = {"col": "column", "column": "column", "row": "row", "both": "both"}


def structure_rows(members: DataFrame) -> DataFrame:
    """Every node of every structure, numbered as a walk meets it: a node's descendants are those from node + 1 to last."""

    def rows_of(m: dict) -> Iterator[tuple]:
        for s in m.get("structures") or []:
            for pre, last, parent, depth, x in walked([{"type": "document"} | (s.get("root") or {})]):
                refs = [{"page_no": _page(r.get("page")), "node": r.get("node", "")} for r in x.get("refs") or []]
                yield (
                    s.get("id", ""), s.get("id", "") == m.get("default"), pre, last, parent, depth, str(x.get("type", "")).upper(), int(x.get("level") or 0), bool(x.get("ordered")), int(x.get("colspan") or 1), int(x.get("rowspan") or 1),
                    HEADS.get(x.get("header", ""), ""), str(x.get("text", "")), str(x.get("lang", "")), str(x.get("alt", "")), refs,
                )

    return _tree_rows(members, "structures", STRUCTURE, rows_of)
