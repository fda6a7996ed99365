"""The hot folder: arrivals against a plain walk, and a stream through restart, change and return."""

import os
import random
import time

from pyspark.sql import functions as F

from quire.streaming import hotfolder as H


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Seen:
    """Arrivals over plain values, a sweep at a time."""

    def __init__(self):
        self.known = {}

    def sweep(self, number, files, written=None):
        from pyspark.sql import Row

        rows = [(p, s, t) for p, (s, t) in files.items()] + [(p, None, None) for p in self.known if p not in files]
        out = []
        for path, size, at in rows:
            arrivals = H.Arrivals()
            arrivals.known = self.known.setdefault(path, Value())
            row = Row(path=path, size=size, time=at, sweep=number, written=(written or {}).get(path))
            out += [r.path for r in arrivals.handleInputRows((path,), iter([row]), None)]
        self.known = {p: v for p, v in self.known.items() if v.exists()}
        return sorted(out)


def test_arrivals():
    s = Seen()
    assert s.sweep(1, {"a": (5, 1), "b": (0, 1), "c": (7, 1), "old": (3, 1)}, {"old": 2}) == []
    assert s.sweep(2, {"a": (5, 1), "b": (0, 1), "c": (9, 2), "old": (3, 1)}) == ["a"]
    assert s.sweep(3, {"a": (5, 1), "c": (9, 2)}) == ["c"]
    assert s.sweep(4, {"a": (6, 3), "c": (9, 2), "old": (3, 1)}) == []
    assert s.sweep(5, {"a": (6, 3), "c": (9, 2), "old": (3, 1)}) == ["a", "old"]
    assert s.sweep(6, {"a": (6, 3), "c": (9, 2), "old": (3, 1)}) == []


def test_arrivals_equal_a_walk():
    rng = random.Random(4)
    s, history, done = Seen(), [], {}
    for n in range(1, 60):
        files = dict(history[-1]) if history else {}
        for p in "abcdef":
            files.pop(p, None) if rng.random() < 0.15 else files.update({p: (rng.choice([0, 1, 2]), rng.choice([1, 2]))}) if rng.random() < 0.3 else None
        done = {p: v for p, v in done.items() if p in files}
        want = sorted(p for p, v in files.items() if history and history[-1].get(p) == v and done.get(p) != v and v[0])
        done |= {p: files[p] for p in want}
        assert s.sweep(n, files) == want
        history.append(files)


def test_sweeps_are_written_before_they_are_told(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/x.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/y.txt").write_bytes(b"no")
    source = H.Sweeps({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    rows, end = source.read(source.initialOffset())
    first = list(rows)
    assert [(r[0].removeprefix("file://"), r[1], r[3]) for r in first] == [(str(tmp_path / "in/sub/x.pdf"), 4, 1)]
    (tmp_path / "in/sub/x.pdf").unlink()
    # told again, the first sweep is what it was
    assert list(source.readBetweenOffsets({"sweep": 0}, end)) == first and list(source.read({"sweep": 0})[0]) == first
    rows, end = source.read(end)
    assert [(r[1], r[3]) for r in rows] == [(None, 2)] and end == {"sweep": 2}
    assert list(source.read(end)[0]) == []


def until(test, seconds=120):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.3)
    return test()


def test_stream_through_restart_change_and_return(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    (source / "sub").mkdir(parents=True)
    (source / "sub/x.pdf").write_bytes(b"%PDF")
    (source / "old.pdf").write_bytes(b"%PDF")
    outputs = spark.createDataFrame([(f"file://{source}/old.pdf", int(time.time() * 1000) + 60_000)], "path string, time long")
    seen, listener = [], H.Progress()
    given = spark.conf.get(H.PROVIDER)
    spark.streams.addListener(listener)
    start = lambda: H.watch(spark, f"file://{source}", f"file://{state}", lambda rows, n: seen.extend(os.path.basename(r.path) for r in rows.collect()), every=0.5, outputs=outputs)
    query = start()
    try:
        assert spark.conf.get(H.PROVIDER) == given
        assert until(lambda: seen == ["x.pdf"])
        sweeps = len(list((state / "listings").iterdir()))
        query.stop()
        query = start()
        # a restarted stream knows what is done
        assert until(lambda: query.lastProgress is not None and query.lastProgress["batchId"] > 6) and seen == ["x.pdf"] and sweeps
        (source / "sub/x.pdf").write_bytes(b"%PDF more")
        assert until(lambda: seen == ["x.pdf", "x.pdf"])
        (source / "sub/x.pdf").rename(tmp_path / "kept")
        swept = max(int(p.stem) for p in (state / "listings").glob("*.json"))
        assert until(lambda: max(int(p.stem) for p in (state / "listings").glob("*.json")) > swept + 1)
        (tmp_path / "kept").rename(source / "sub/x.pdf")
        assert until(lambda: seen == ["x.pdf"] * 3)
        time.sleep(3)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    # old.pdf has an output that is newer
    assert seen == ["x.pdf"] * 3 and query.exception() is None and listener.batches


def test_moving(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    for n in ("x.pdf", "a/y.pdf"):
        (tmp_path / "in" / n).write_bytes(n.encode())
    ready = spark.createDataFrame([(f"file://{tmp_path}/in/{n}",) for n in ("x.pdf", "a/y.pdf", "gone.pdf")], "path string")
    got = {os.path.basename(r.path): (r.moved, r.said is None) for r in H.moved(ready, f"file://{tmp_path}/in", f"file://{tmp_path}/done").collect()}
    assert got == {"x.pdf": (True, True), "y.pdf": (True, True), "gone.pdf": (False, False)}
    assert (tmp_path / "done/a/y.pdf").read_bytes() == b"a/y.pdf" and not (tmp_path / "in/x.pdf").exists()
    assert H.moved(ready.where(F.lit(False)), "file:///a", "file:///b").count() == 0
