"""One call over targets and options; an option runs only the stages that depend on it."""

import pytest

from quire.catalogue import readout as Q
from quire.convert import TARGETS, Converter, content_key, convert
from quire.plans import model as M


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "\n".join([f"Title {i}"] + [f"Paragraph {j} of text {i} says a little more than {j}." for j in range(i % 17)]), "s", "en", 10) for i in range(1, 40)] + [(40, None, "s", "en", 0), (41, "", "s", "en", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")


def test_stages_run_as_options_change(spark, docs, tmp_path):
    c = Converter(spark, f"file://{tmp_path}/kept")
    ran = lambda target, **o: (c.ran.clear(), c.convert(docs, target, o).count(), list(c.ran))[2]
    assert ran("md") == ["blocks", "runs", "cut", "read", "types", "tables", "typed", "md"]
    assert ran("md") == []
    assert ran("html") == ["html"] and ran("doctags") == ["doctags"] and ran("doctags", grid=1000) == ["doctags"]
    assert ran("doctags", grid="500") == []
    assert ran("book") == ["book"] and ran("book", min_chapter=100) == ["book"]
    assert ran("md", headings="none") == ["types", "typed", "md"]
    assert ran("md", pages="1") == ["read", "types", "typed", "md"]
    assert ran("html", pages="1") == ["html"]
    assert ran("md", zones="0:0,0,400,400") == ["cut", "read", "types", "typed", "md"]
    # other rows are other content, the same rows in another order are not
    assert content_key(docs) == content_key(docs.repartition(5)) != content_key(docs.where("doc_id > 1"))
    again = Converter(spark, f"file://{tmp_path}/kept")
    assert again.convert(docs.repartition(3), "text").count() == 39 and again.ran == ["text"]


def test_targets_equal_the_operators(spark, docs):
    by_size = {"headings": "size"}
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    own = Q.with_tables(docs)
    assert same(convert(docs, "md", by_size), Q.K.markdown(own)) and same(convert(docs, "html", by_size), Q.K.html(own)) and same(convert(docs, "doctags", by_size | {"grid": 100}), Q.K.doctags(own, 100))
    assert same(convert(docs, "stages", by_size), Q.K.page_json(M.typed(docs))) and same(convert(docs, "book", by_size), Q.K.chapters(Q.units(docs)))


def test_pages_zones_and_headings(spark, docs):
    text = lambda **o: {r.doc_id: r.text for r in convert(docs, "text", o).collect()}
    plain, one, turned = text(), text(pages="1"), text(pages="2,1")
    assert one[16] == "\n".join(plain[16].split("\n")[:6]) and set(one) == set(plain)
    assert turned[16].split("\n") == plain[16].split("\n")[6:12] + plain[16].split("\n")[:6] and 1 not in turned
    cut = text(zones="0:0,0,1000,1000")
    assert cut[16] == "\n".join(plain[16].split("\n")[6:]) and 1 not in cut
    some = text(zones="0:0,0,190,1000")
    assert some[16] != plain[16] and some[16].split("\n")[-1] == plain[16].split("\n")[-1] and len(some[16]) < len(plain[16])
    titles = lambda **o: {(r.doc_id, r.title) for r in convert(docs, "toc", o).collect()}
    assert titles(headings="none") == set() and titles(headings="size") > titles() > set()
    assert all(not t.endswith(".") for _, t in titles())
    assert "|" not in "".join(r.markdown for r in convert(docs, "md", {"tables": False}).collect())


def test_refusals(docs):
    for target, options, said in (("pdf", {}, "none of"), ("md", {"grid": "x"}, "grid"), ("md", {"nothing": 1}, "no such option"), ("md", {"pages": "a-b"}, "no page set")):
        with pytest.raises(ValueError, match=said):
            convert(docs, target, options)
    with pytest.raises(ValueError, match="local file"):
        convert(docs, "md", {"done_folder": "/d"}, from_request=True)
    assert all(convert(docs.where("false"), t).count() == 0 for t in TARGETS[:3])
