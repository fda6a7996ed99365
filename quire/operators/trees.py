"""Trees in pre-order: a node's descendants are the numbers after its own up to `last`, so questions about subtrees are
questions about intervals, whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.shared import written

#: Doublings of the ancestors' reach; 2 ** ROUNDS levels are more than any tree has, so beyond them there is a circle.
ROUNDS = 20


def numbered(nodes: DataFrame) -> DataFrame:
    """doc_id, node, pre, last, depth, path of every node, siblings in the order of their names.

    A node whose parent is not there is a root; a circle of parents raises.  Each round doubles how far up a node sees, so
    depth 50 takes six joins; the numbers are written and serve all later queries.
    """
    known = nodes.select("doc_id", F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = nodes.select("doc_id", "node", "parent").join(known, ["doc_id", "parent"], "left")
    rows = rows.select("doc_id", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.array("node").alias("path"))
    for _ in range(ROUNDS):
        rows = written(rows, "paths")
        if not rows.where("up is not null").limit(1).collect():
            break
        above = rows.select("doc_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        rows = rows.join(above, ["doc_id", "up"], "left").select("doc_id", "node", F.col("next").alias("up"), F.concat(F.coalesce("more", F.array().cast("array<bigint>")), "path").alias("path"))
    else:
        raise ValueError("the parents go in a circle")
    pre = F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1
    rows = written(rows.select("doc_id", "node", pre.cast("long").alias("pre"), (F.size("path") - 1).cast("long").alias("depth"), "path"), "pre")
    last = rows.select("doc_id", F.explode("path").alias("node"), "pre").groupBy("doc_id", "node").agg(F.max("pre").alias("last"))
    return written(rows.join(last, ["doc_id", "node"]).select("doc_id", "node", "pre", "last", "depth", "path"), "numbers")


def below(rows: DataFrame, flag: Column) -> Column:
    """Is the node below one with the flag, or has it itself?  Intervals of a tree lie within or beside one another, so of those
    that began before the one that ends last tells.  rows: numbers joined with what the flag asks for."""
    order = W.partitionBy("doc_id").orderBy("pre")
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(order) >= F.col("pre"), F.lit(False))


def shown(numbers: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node of the nodes that are not in the subtree of a hidden one.  nodes: doc_id, node, hidden."""
    rows = numbers.join(nodes.select("doc_id", "node", "hidden"), ["doc_id", "node"])
    return rows.withColumn("gone", below(rows, F.col("hidden"))).where("not gone").select("doc_id", "node")


def owners(numbers: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node, owner: the nearest node at or above that is not inline; a tree's root owns itself.  nodes: doc_id, node, inline."""
    up = numbers.select("doc_id", "node", F.posexplode("path").alias("at", "above"))
    plain = nodes.where("not inline").select("doc_id", F.col("node").alias("above"))
    own = up.join(plain, ["doc_id", "above"]).groupBy("doc_id", "node").agg(F.max_by("above", "at").alias("owner"))
    return numbers.select("doc_id", "node", "path").join(own, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce("owner", F.col("path")[0]).alias("owner"))


def node_texts(numbers: DataFrame, nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, node, text: what a node and its inline descendants, of any depth, refer to, by page and place.

    nodes: doc_id, node, inline, ref_page, ref.  blocks: doc_id, page_no, ord, text.
    """
    rows = owners(numbers, nodes).join(nodes.select("doc_id", "node", "ref_page", "ref"), ["doc_id", "node"])
    found = rows.join(blocks.select("doc_id", F.col("ord").alias("ref"), F.col("page_no").alias("ref_page"), "text"), ["doc_id", "ref_page", "ref"])
    out = found.groupBy("doc_id", F.col("owner").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ref_page", "ref", "text"))).alias("t"))
    return out.select("doc_id", "node", T.collapse(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("text"))


def subtree_sums(numbers: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """doc_id, node, total: the sum of a value over a node and all below it, as a difference of two prefix sums."""
    order = W.partitionBy("doc_id").orderBy("pre")
    rows = numbers.join(nodes.select("doc_id", "node", F.coalesce(value, F.lit(0)).alias("v")), ["doc_id", "node"])
    rows = rows.select("doc_id", "node", "pre", "last", "v", F.sum("v").over(order).alias("upto"))
    ends = rows.select("doc_id", F.col("pre").alias("last"), F.col("upto").alias("end"))
    return rows.join(ends, ["doc_id", "last"]).select("doc_id", "node", (F.col("end") - F.col("upto") + F.col("v")).alias("total"))
