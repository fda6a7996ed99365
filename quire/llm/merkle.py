"""A Merkle manifest of a table: one tree a group of rows, one tree over the groups' roots, and a proof for every row.

Rows are dealt by range of (group, key) and stand in order within a partition, so a partition holds runs of consecutive
leaves; how many stand before it follows from one count a partition.  Each run goes over a *mountain range*: a stack of open
runs of digests, one a level, on which the eighth digest of a run carries one node up.  A node that a partition completes is
recorded there and then.  What it cannot complete are the digests at its two edges, at most seven a side and level; those of
all partitions are merged level by level in a table of their own (the spine), whose size follows the number of partitions.
A short last run is hashed as it is, without padding.

For proofs every partition asks the spine for the runs at its own edges and above, and has the rest itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

FANOUT = 8
#: 2 ** SHIFT is FANOUT
SHIFT = 3
#: Leaves of one row of the segment table.
SEGMENT = 8192
#: Rows that ask for one run of the spine are dealt to so many tasks.
SALTS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def node_hash(digests: bytes) -> bytes:
    """The node of a run, as hexadecimal text, of its digests' hexadecimal text."""
    return hashlib.sha256(digests).hexdigest().encode()


def counts(total: int) -> list[int]:
    """Nodes of a tree of so many leaves on every level, up to the single one."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


class Mountain:
    """A stack of open runs over consecutive leaves, the first of which has number `start` of `total`.

    `nodes[k]` are the digests of level k that it has seen or made, `first[k]` the number of the first of them; `edges` are
    those that belong to runs which reach beyond its leaves (level, number, digest), and the root where it has made that.
    """

    def __init__(self, start: int, total: int):
        self.counts = counts(total)
        self.first = [start] + [-1] * (len(self.counts) - 1)
        self.nodes: list[list[bytes]] = [[] for _ in self.counts]
        self.open: list[list[bytes]] = [[] for _ in self.counts]
        self.edges: list[tuple[int, int, bytes]] = []

    def push(self, index: int, digest: bytes) -> None:
        level = 0
        while True:
            if self.first[level] < 0:
                self.first[level] = index
            self.nodes[level].append(digest)
            if self.counts[level] == 1:
                self.edges.append((level, 0, digest))
                return
            run = self.open[level]
            run.append(digest)
            if index % FANOUT < FANOUT - 1 and index + 1 < self.counts[level]:
                return
            whole = len(run) == index % FANOUT + 1
            if not whole:
                self.edges += [(level, index + 1 - len(run) + i, d) for i, d in enumerate(run)]
                run.clear()
                return
            digest = node_hash(b"".join(run))
            run.clear()
            level, index = level + 1, index // FANOUT

    def close(self) -> None:
        """Open runs go on in the next partition."""
        for level, run in enumerate(self.open):
            after = self.first[level] + len(self.nodes[level])
            self.edges += [(level, after - len(run) + i, d) for i, d in enumerate(run)]

    def run(self, level: int, number: int) -> bytes | None:
        """Digests of a whole run, if all of them are here."""
        a = number * FANOUT - self.first[level]
        b = min((number + 1) * FANOUT, self.counts[level]) - self.first[level]
        return b"".join(self.nodes[level][a:b]) if self.first[level] >= 0 and a >= 0 and b <= len(self.nodes[level]) else None


def mountain_of(row: dict) -> Mountain:
    out, leaves = Mountain(row["start"], row["total"]), row["leaves"].hex().encode()
    for i in range(row["n"]):
        out.push(row["start"] + i, leaves[64 * i : 64 * i + 64])
    out.close()
    return out


class Paths:
    """Siblings, level by level, of every leaf of a segment."""

    def __init__(self, row: dict):
        self.mountain = mountain_of(row)
        self.given = {(x["level"], x["run"]): "".join(x["nodes"]).encode() for x in row["runs"] or ()}
        self.height = len(self.mountain.counts) - 1
        self.known: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}

    def sides(self, level: int, index: int) -> list[tuple[bytes, bytes]]:
        """(left, right) siblings from this node up to the root."""
        if level == self.height:
            return []
        run = index // FANOUT
        own = self.mountain.run(level, run)
        if own is None:
            own = self.given[level, run]
        at = 64 * (index % FANOUT)
        above = self.known.get((level + 1, run))
        if above is None:
            above = self.known[level + 1, run] = self.sides(level + 1, run)
        return [(own[:at], own[at + 64 :]), *above]


# ---------------------------------------------------------------- the tables


class Forest(NamedTuple):
    """Segments of leaves with their places, the spine, and the root of each group."""

    segments: DataFrame
    places: DataFrame
    spine: DataFrame
    roots: DataFrame


def group_key(col: Column) -> Column:
    """A text that sorts as the group does, null first, and is never null."""
    return F.when(col.isNull(), "").otherwise(F.concat(F.lit("="), col))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    group, n = None, 0
    ids: list[pa.Array] = []
    leaves: list[bytes] = []
    altered: list[bytes] = []

    def flush() -> pa.RecordBatch:
        nonlocal seq, n
        own = pa.concat_arrays(ids)
        out = {"block_id": pa.array([(part << 32) + seq]), "part": pa.array([part], pa.int32()), "grp": [group], "n": pa.array([n]), "ids": pa.array([own.to_pylist()], pa.list_(pa.int64())), "leaves": pa.array([b"".join(leaves)], pa.binary()), "altered": pa.array([b"".join(altered)], pa.binary())}
        seq, n = seq + 1, 0
        for x in (ids, leaves, altered):
            x.clear()
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        groups, at = batch.column("grp").to_pylist(), 0
        while at < batch.num_rows:
            if n and (groups[at] != group or n >= SEGMENT):
                yield flush()
            group, to = groups[at], at
            while to < batch.num_rows and groups[to] == group and n + to - at < SEGMENT:
                to += 1
            ids.append(batch.column("id").slice(at, to - at))
            leaves += batch.column("leaf").slice(at, to - at).to_pylist()
            altered += batch.column("altered").slice(at, to - at).to_pylist()
            n, at = n + to - at, to
    if n:
        yield flush()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            m = mountain_of(row)
            level, index, node = zip(*m.edges)
            yield pa.RecordBatch.from_pydict({"grp": [row["grp"]] * len(level), "level": pa.array(level, pa.int32()), "idx": pa.array(index, pa.int64()), "count": pa.array([m.counts[x] for x in level], pa.int64()), "node": [x.decode() for x in node]})


SPINE = "grp string, level int, idx long, count long, node string"


def forest(rows: DataFrame, keys: list[str]) -> Forest:
    """The trees over rows (grp, keys, id, leaf, altered, row_no); leaves of a group stand by keys, then by leaf and row_no.

    `rows` must be a written table: row_no tells equal rows apart, so that any number of them can be dealt to several tasks.
    """
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("grp", *keys, "leaf", "row_no")]
    dealt = rows.repartitionByRange(B.partitions(spark), *order).sortWithinPartitions(*order).select("grp", "id", "leaf", "altered")
    segments = B.written(dealt.mapInArrow(B.tidy(_pack), "block_id long, part int, grp string, n long, ids array<long>, leaves binary, altered binary"), "segments")
    meta = segments.select("block_id", "part", "grp", "n")
    # one sum a partition and group, then one a segment of a partition
    parts = meta.groupBy("grp", "part").agg(F.sum("n").alias("own"))
    all_, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("grp", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(all_).alias("total"))
    inside = Window.partitionBy("grp", "part").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    places = meta.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["grp", "part"])
    places = B.written(places.select("block_id", "grp", "n", (F.col("base") + F.col("inner")).alias("start"), "total"), "places")
    edges = B.written(segments.select("block_id", "leaves").join(places, "block_id").mapInArrow(B.tidy(_edges), SPINE), "edges")
    height = len(counts(places.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0])) - 1
    spine = merged = edges
    for level in range(height):
        here = edges.where(F.col("level") == level)
        here = (here if merged is edges else here.unionByName(merged)).where("count > 1")
        # a run has FANOUT members at most
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"])
        up = here.groupBy("grp", F.shiftright("idx", SHIFT).alias("idx")).agg(run.alias("run"), F.first("count").alias("count"))
        up = up.select("grp", F.lit(level + 1).alias("level"), "idx", F.expr(f"(count + {FANOUT - 1}) div {FANOUT}").alias("count"), F.sha2(F.array_join("run", ""), 256).alias("node"))
        merged = B.written(up, "spine")
        spine = spine.unionByName(merged)
    return Forest(segments, places, spine, spine.where("count = 1").select("grp", F.col("node").alias("root")))


def replies(trees: Forest) -> DataFrame:
    """(block_id, grp, start, total, runs): the runs of the spine that the segments' proofs need, at most two a level."""
    height = F.expr(f"size(filter(sequence(0, 20), k -> shiftleft(1L, {SHIFT} * k) < total))")
    levels = F.when(height > 0, F.sequence(F.lit(0), height - 1))
    asked = F.expr(f"array_distinct(flatten(transform(levels, k -> array(struct(k AS level, shiftright(start, {SHIFT} * (k + 1)) AS run), struct(k AS level, shiftright(start + n - 1, {SHIFT} * (k + 1)) AS run)))))")
    needs = trees.places.withColumn("levels", levels).select("block_id", "grp", F.explode(asked).alias("a")).select("block_id", "grp", "a.level", "a.run", F.pmod("block_id", F.lit(SALTS)).alias("salt"))
    runs = trees.spine.where("count > 1").groupBy("grp", "level", F.shiftright("idx", SHIFT).alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"]).alias("nodes"))
    runs = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    given = needs.join(runs, ["grp", "level", "run", "salt"]).groupBy("block_id").agg(F.collect_list(F.struct("level", "run", "nodes")).alias("runs"))
    return trees.places.join(given, "block_id", "left")


def node_records(trees: Forest) -> DataFrame:
    """(grp, level, idx, node): every node of every tree, leaves included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                m = mountain_of(row)
                for level, own in enumerate(m.nodes):
                    if own:
                        yield pa.RecordBatch.from_pydict({"grp": [row["grp"]] * len(own), "level": pa.array([level] * len(own), pa.int32()), "idx": pa.array(range(m.first[level], m.first[level] + len(own)), pa.int64()), "node": [x.decode() for x in own]})

    local = trees.segments.select("block_id", "leaves").join(trees.places, "block_id").mapInArrow(B.tidy(run), "grp string, level int, idx long, node string")
    return local.unionByName(trees.spine.select("grp", "level", "idx", "node")).distinct()


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            paths = Paths(row)
            for j, no in enumerate(row["ids"]):
                yield pa.RecordBatch.from_pydict({"id": [no], "sides": pa.array([[{"left": a.decode(), "right": b.decode()} for a, b in paths.sides(0, row["start"] + j)]], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            paths, n = Paths(row), row["n"]
            top = [(x["left"].encode(), x["right"].encode()) for x in row["sides"]]
            leaves, altered = row["leaves"].hex(), row["altered"].hex()
            proof, folded = [], []
            for j in range(n):
                sides = paths.sides(0, row["start"] + j) + top
                proof.append(sha(b"".join([x for pair in sides for x in pair])).hexdigest())
                h = altered[64 * j : 64 * j + 64]
                for left, right in sides:
                    h = sha(left + h.encode() + right).hexdigest()
                folded.append(h)
            out = {"doc_id": pa.array(row["ids"], pa.int64()), "leaf": [leaves[64 * j : 64 * j + 64] for j in range(n)], "subroot": [row["subroot"]] * n, "root": [row["root"]] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == row["root"] for x in folded]}
            yield pa.RecordBatch.from_pydict(out)


# ---------------------------------------------------------------- documents


def field(name: str | Column) -> Column:
    """A value for a leaf: `-` if null, else its UTF-8 byte count, a colon, the value."""
    text = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(grp, id, leaf, altered, row_no) of every row; altered is the leaf after tampering, or the leaf."""
    leaf = lambda text: F.unhex(F.sha2(F.concat(*(field(c) for c in FIELDS[:-1]), field(text)), 256))
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(*FIELDS).withColumns({"leaf": leaf("text"), "row_no": F.monotonically_increasing_id()})
    altered = F.coalesce(F.when(touched, leaf(F.translate("text", _UPPER, _UPPER.lower()))), F.col("leaf"))
    return rows.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("id"), "leaf", altered.alias("altered"), "row_no")


def manifest(docs: DataFrame) -> tuple[Forest, Forest]:
    """The trees of the languages, and the tree over their roots, as tables in the shared folder."""
    trees = forest(B.written(leaf_rows(docs), "leaves"), ["id"])
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.monotonically_increasing_id().alias("id"), F.unhex("root").alias("leaf"))
    tops = B.written(tops.withColumns({"altered": F.col("leaf"), "row_no": F.col("id")}), "tops")
    return trees, forest(tops, ["key"])._replace(roots=tops)


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    Null fields count as `-`.  A null doc_id stands before all others and is not tampered with; rows that share a doc_id
    stand by their leaves, and equal rows have leaves of their own.  Empty texts and columns beyond the five make no
    difference.  An empty table gives no rows.
    """
    trees, over = manifest(docs)
    paths = replies(over).join(over.segments.select("block_id", "ids", "leaves"), "block_id").mapInArrow(B.tidy(_group_paths), "id long, sides array<struct<left string, right string>>")
    named = paths.join(over.roots.select("id", F.col("key").alias("grp"), F.lower(F.hex("leaf")).alias("subroot")), "id").drop("id")
    top = over.spine.where("count = 1").first()
    asked = replies(trees).join(named.withColumn("root", F.lit(top and top.node)), "grp")
    given = trees.segments.select("block_id", "ids", "leaves", "altered").join(asked, "block_id")
    return given.mapInArrow(B.tidy(_proofs), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
