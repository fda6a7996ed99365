"""The container source: pushed filters open only what they name, trees of any depth, refusals."""

import json
import zipfile

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quire import queries as Q
from quire.sources import container as C

OPF = '<package><manifest><item id="a" href="pages/page-003.xhtml"/><item id="b" href="pages/page-001.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'


def deep(n):
    out = {"type": "span", "text": f"leaf {n}", "refs": [{"page": "p1", "node": "x"}]}
    for i in range(n):
        out = {"type": "section", "children": [{"type": "paragraph", "text": str(i)}, out]}
    return out


def packed(path, extra=(), version="4", structures=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/model/meta.json", json.dumps({"version": version, "title": "T", "layers": [{"id": "l", "name": "n", "visible": False}]}))
        z.writestr("OEBPS/content.opf", OPF)
        for i in (1, 2, 3):
            z.writestr(f"OEBPS/pages/page-00{i}.xhtml", f"<html>{i}</html>" * 500)
        z.writestr("OEBPS/images/a.png", b"\x89PNG")
        z.writestr("OEBPS/viewer/side.json", "{}")
        if structures:
            z.writestr("OEBPS/model/structures.json", json.dumps(structures))
        for name, raw in extra:
            z.writestr(name, raw)


def broken(path, member):
    """Spoils a member's bytes: whoever inflates it fails."""
    with zipfile.ZipFile(path) as z:
        at = z.getinfo(member).header_offset + 30 + len(member) + 5
    raw = bytearray(path.read_bytes())
    raw[at : at + 8] = b"\xff" * 8
    path.write_bytes(raw)


def test_pages_follow_the_spine_and_filters_reach_the_source(spark, tmp_path):
    packed(tmp_path / "a.epub")
    packed(tmp_path / "b.epub")
    broken(tmp_path / "a.epub", "OEBPS/pages/page-001.xhtml")
    broken(tmp_path / "b.epub", "OEBPS/pages/page-003.xhtml")
    df = C.read_containers(spark, str(tmp_path))
    rows = df.where("page_no in (0, 2) and path like '%a.epub'").collect()
    assert {(r.name[-8:], r.page_no, bytes(r.content)[:14]) for r in rows} == {("03.xhtml", 0, b"<html>3</html>"), ("02.xhtml", 2, b"<html>2</html>")}
    assert df.where("kind = 'image'").count() == 2
    with pytest.raises(Exception, match="(?s)page-001|invalid|Error"):
        df.where("page_no = 1 and path like '%a.epub'").collect()
    # without content nothing is inflated
    sizes = C.read_containers(spark, str(tmp_path), "path string, name string, n_bytes long")
    assert sizes.where(F.endswith("name", F.lit(".xhtml"))).agg(F.sum("n_bytes")).first()[0] == 2 * 3 * 14 * 500
    plan = df.where("page_no in (0, 2)")._jdf.queryExecution().executedPlan().toString()
    # the source took the filter: Spark does not test it again
    assert "Filter (" not in plan and "quire_container" in plan


def test_small_containers_are_read_at_little_cost(spark, tmp_path, monkeypatch):
    for i in range(20):
        packed(tmp_path / f"{i}.epub")
    reader = C.ContainerReader({"path": str(tmp_path)}, ["path", "kind", "content"])
    # opening counts, so many small containers are no one task
    monkeypatch.setattr(C, "TASK_BYTES", 5 * C.OPEN_BYTES)
    tasks = reader.partitions()
    assert len(tasks) > 4 and sum(len(t.uris) for t in tasks) == 20
    # the package is not looked at for what asks for no page number
    monkeypatch.setattr(C, "page_numbers", lambda z: 1 / 0)
    reader.filters = [D.EqualTo(("kind",), "meta")]
    assert [r["kind"] for t in tasks for u in t.uris for r in reader.rows(u)] == ["meta"] * 20


def test_notes_come_from_one_reading(spark, sf_dir):
    own = Q.QUERIES["container_annots"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert own.count("BatchScan") == 1


def test_kinds(spark, tmp_path):
    packed(tmp_path / "a.epub")
    rows = C.read_containers(spark, str(tmp_path / "a.epub"), "name string, kind string, page_no int").collect()
    assert {(r.kind, r.page_no) for r in rows} == {("package", None), ("meta", None), ("page", 0), ("page", 1), ("page", 2), ("image", None), ("passenger", None)}


@pytest.mark.parametrize("version,extra,said", [("3", (), "version 3"), ("4", [("OEBPS/images/big", b"0" * 5000)], "inflates beyond")])
def test_refusals(spark, tmp_path, version, extra, said):
    packed(tmp_path / "a.epub", extra, version)
    with pytest.raises(Exception, match=said):
        C.read_containers(spark, str(tmp_path), mostMember="4999", mostContainer="20000").collect()


def test_foreign_books_and_doctypes_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("mimetype", "x")
    with pytest.raises(Exception, match="foreign package"):
        C.read_containers(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="document type"):
        C.spine(b'<!DOCTYPE a [<!ENTITY b "c">]><package/>')


def test_trees_of_any_depth(spark, tmp_path):
    packed(tmp_path / "a.epub", structures={"default": "s", "structures": [{"id": "s", "root": {"children": [deep(n) for n in (0, 1, 50)]}}, {"id": "t"}]})
    rows = C.structure_rows(C.read_containers(spark, str(tmp_path))).collect()
    own = sorted((r for r in rows if r.structure == "s"), key=lambda r: r.node)
    assert [r.node for r in own] == list(range(1 + 1 + 3 + 101)) and max(r.depth for r in own) == 51
    below = {r.node: sum(r.node < x.node <= r.last for x in own) for r in own}
    up = {r.node: r.parent for r in own}
    for r in own:
        n = 0
        for x in own:
            p = x.parent
            while p >= 0 and p != r.node:
                p = up[p]
            n += p == r.node
        assert below[r.node] == n
    assert [(r.node, r.last, r.type, r.is_default) for r in rows if r.structure == "t"] == [(0, 0, "DOCUMENT", False)]
    assert own[-1].refs[0].page_no == 0 and own[-1].text == "leaf 50"


def test_members_of_the_model(spark, tmp_path):
    annots = {"pages": {"p2": {"annots": [{"type": "highlight", "rect": [0, 1, 2, 3], "quads": [[0, 0, 1, 1]]}], "fields": [{"type": "choice", "name": "n", "options": ["a", "b"], "readonly": True}]}, "p1": {}}}
    outline = {"bookmarks": [{"title": "A", "page": "p6", "y": 640.2, "children": [{"title": "B"}]}, {"title": "C", "page": "x"}]}
    packed(tmp_path / "a.epub", [("OEBPS/model/annots.json", json.dumps(annots)), ("OEBPS/model/outline.json", json.dumps(outline))])
    df = C.read_containers(spark, str(tmp_path))
    m = C.meta_rows(df).collect()
    assert (m[0].title, m[0].authors, m[0].language, m[0].custom, m[0].text_segmented) == ("T", [], None, {}, False)
    assert [(r.layer_id, r.visible, r.ord, r.ocr_engine) for r in C.layer_rows(df).collect()] == [("l", False, 0, None)]
    assert [(r.page_no, r.type, r.rect, r.quads) for r in C.annotation_rows(df).collect()] == [(1, "highlight", [0, 1, 2, 3], [[0, 0, 1, 1]])]
    assert [(r.page_no, r.name, r.options, r.read_only, r.required) for r in C.field_rows(df).collect()] == [(1, "n", ["a", "b"], True, False)]
    assert [(r.entry, r.last, r.parent, r.depth, r.title, r.page_no, r.y) for r in C.outline_rows(df).collect()] == [(0, 1, -1, 0, "A", 5, 640.2), (1, 1, 0, 1, "B", None, None), (2, 2, -1, 0, "C", None, None)]
    assert "model" not in C.kind_of("OEBPS/model/other.json") and C.kind_of("OEBPS/model/other.json") == "passenger"


def test_written_containers_come_back(spark, tmp_path):
    rows = [(f"{d}.epub", i, n, bytearray(c)) for d in ("a", "b", "c") for i, (n, c) in enumerate([("mimetype", b"application/epub+zip"), ("OEBPS/m/meta.json", b'{"version":"4"}'), ("OEBPS/images/x", d.encode() * 70000)])]
    df = spark.createDataFrame(rows, "path string, place int, name string, content binary").repartition(4)
    for _ in range(2):  # a second write puts equal files in place
        C.write_containers(df, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.epub", "b.epub", "c.epub"]
    got = C.read_containers(spark, f"file://{tmp_path}/out").collect()
    assert {(r.path.rsplit("/", 1)[-1], r.name, bytes(r.content)) for r in got} == {(a, n, bytes(c)) for a, _, n, c in rows}
    assert zipfile.ZipFile(tmp_path / "out/a.epub").namelist()[0] == "mimetype"
