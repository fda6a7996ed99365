"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node that can be reached, for every node with a link.

    Each round hangs every node under its smallest neighbour if that is smaller, follows the hook once, and contracts
    the links; rounds grow with the logarithm of the nodes.
    """
    edges = B.written(links.select("a", "b").where("a <> b").distinct(), "edges")
    roots = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("up")).select("at", F.least("at", "up").alias("up"))
        hook = B.written(hook, "hook")
        over = hook.select(F.col("at").alias("up"), F.col("up").alias("top"))
        hook = B.written(hook.join(over, "up").select("at", F.col("top").alias("up")), "hook")
        roots = moved(roots, hook)
        for side in ("a", "b"):
            edges = edges.join(hook.select(F.col("at").alias(side), F.col("up").alias("_up")), side, "left").withColumn(side, F.coalesce("_up", side)).drop("_up")
        edges = B.written(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return B.written(roots, "roots")


def moved(roots: DataFrame, hook: DataFrame) -> DataFrame:
    """roots (node, root) after root `at` has become `up`."""
    return roots.join(hook.select(F.col("at").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links: only the links between roots are contracted."""
    if roots is None:
        return components(links)
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias("_root")), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    more = components(links.select("a", "b"))
    known = moved(roots, more.select(F.col("node").alias("at"), F.col("root").alias("up")))
    return B.written(known.union(more.join(roots, "node", "left_anti")), "roots")
