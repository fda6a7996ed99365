"""Pages and the order of what is on them: paint spans and flows, siblings, runs under a root, crops, patches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.shared import written


def paint_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, page_no, block, span, z0, z1, n, flow: contiguous paint spans of blocks; spans of one block share a flow.

    nodes: doc_id, page_no, z, block (null: decoration).  A decoration between two nodes of one block rides in its span.
    """
    order = W.partitionBy("doc_id", "page_no").orderBy("z")
    before = F.last("block", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("block", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = nodes.withColumn("own", F.when(before == after, before)).where("own is not null")
    fresh = F.when(F.lag("own").over(order) == F.col("own"), 0).otherwise(1)
    # a gap of nodes that belong to no block parts spans as well
    rows = rows.withColumn("fresh", F.greatest(fresh, (F.col("z") != F.lag("z", 1, -(1 << 40)).over(order) + F.col("step")).cast("int"))).withColumn("span", F.sum("fresh").over(order))
    spans = rows.groupBy("doc_id", "page_no", F.col("own").alias("block"), "span").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("n"))
    parts = F.count("*").over(W.partitionBy("doc_id", "page_no", "block"))
    return spans.withColumn("flow", F.when(parts >= 2, F.col("block"))).drop("span")


def sibling_places(siblings: DataFrame) -> DataFrame:
    """doc_id, parent, node, place: by the order an element carries, else by its own index; ties by index."""
    order = W.partitionBy("doc_id", "parent").orderBy(F.coalesce("given", "idx"), "idx")
    return siblings.select("doc_id", "parent", "node", (F.row_number().over(order) - 1).cast("long").alias("place"))


def cropped(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, x0, y0, x1, y1, rotation: the crop window cut to the media box (all of it where the window is empty), quarter turns added up."""
    x0, y0 = F.greatest("x0", "c_x0"), F.greatest("y0", "c_y0")
    x1, y1 = F.least("x1", "c_x1"), F.least("y1", "c_y1")
    fine = F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))
    side = lambda cut, whole: F.when(fine, cut).otherwise(F.col(whole)).alias(whole)
    return pages.select("doc_id", "page_no", side(x0, "x0"), side(y0, "y0"), side(x1, "x1"), side(y1, "y1"), F.pmod(F.col("rotation") + 90 * F.col("turns"), F.lit(360)).alias("rotation"))


def guarded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows of groups that hold at most so many; larger groups are skipped as a whole."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") <= most).drop("_n")


def patched(pages: DataFrame, zones: DataFrame) -> DataFrame:
    """The rows of pages that a zone names."""
    return pages.join(zones.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")


#: Buckets of a written model: files that a patch may have to write anew hold 1 / BUCKETS of the documents.
BUCKETS = 64


def write_model(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes rows (doc_id, page_no, ...) in buckets of documents, a file each, and how many buckets there are."""
    spark = rows.sparkSession
    own = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    own.repartition(buckets, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
    # Spark's readers pass names with a leading underscore over
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_buckets")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_patch(rows: DataFrame, path: str) -> None:
    """Puts rows in the place of the pages (doc_id, page_no) that they name; pages that are not there are added.

    Only buckets of documents that the patch names are read and written anew, one file each, whatever the pages.  The new
    buckets are written beside the model first, so a patch that fails on the way leaves all as it was.
    """
    spark = rows.sparkSession
    buckets = spark.read.parquet(f"{path.rstrip('/')}/_buckets").first()["buckets"]
    patch = written(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "patch")
    # as many numbers as there are buckets at most
    touched = [r.bucket for r in patch.select("bucket").distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(patch.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
    new = written(old.select(*rows.columns, "bucket").unionByName(patch.select(*rows.columns, "bucket")), "patched")
    new.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A table as CSV with a head line."""
    rows.write.option("header", "true").mode("overwrite").csv(path)
