"""Options, patches and reports as files."""

import pytest

from quire.operators import paging
from quire.options import Options


def test_options():
    o = Options.of({"grid": "1000", "refine": "yes", "min_chapter": 400})
    assert o.given == {"grid": 1000, "refine": True} and o["min_chapter"] == 400 and o.group("doctags") == {"grid": 1000}
    for bad in ({"grid": "x"}, {"refine": "maybe"}, {"headings": "some"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            Options.of(bad)
    assert Options.of({"done_folder": "/d"})["done_folder"] == "/d"
    with pytest.raises(ValueError):
        Options.of({"done_folder": "/d"}, from_request=True)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.glob("bucket=*/*.parquet")}


def test_patch_writes_only_the_buckets_it_touches(spark, tmp_path):
    rows = spark.createDataFrame([(d, p, f"{d}-{p}") for d in range(40) for p in range(5)], "doc_id long, page_no long, text string").repartition(7)
    model = tmp_path / "model"
    paging.write_model(rows, str(model), 8)
    before = files(model)
    assert 1 < len(before) <= 8
    patch = spark.createDataFrame([(1, 1, "new"), (1, 1, "more"), (1, 9, "added"), (77, 0, "other")], "doc_id long, page_no long, text string")
    want = {(d, p): [f"{d}-{p}"] for d in range(40) for p in range(5)} | {(1, 1): ["more", "new"], (1, 9): ["added"], (77, 0): ["other"]}
    for _ in range(2):  # a patch put on twice changes nothing more
        paging.write_patch(patch, str(model))
        got = {}
        for r in paging.read_model(spark, str(model)).collect():
            got.setdefault((r.doc_id, r.page_no), []).append(r.text)
        assert {k: sorted(v) for k, v in got.items()} == want
    after = files(model)
    assert len(after) <= 8 and len(set(before.items()) & set(after.items())) >= len(before) - 2
    paging.write_patch(patch.where("false"), str(model))
    assert files(model) == after
    paging.write_report(rows, f"{tmp_path}/report")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/report").count() == 200
