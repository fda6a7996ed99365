"""Files: what they hold, folders of them, and the members of containers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a container and of pictures; everything else is taken for a PDF.
MAGIC = (("504B0304", "container"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
#: Bytes that a member, and a container, may inflate to.
MOST_MEMBER, MOST_CONTAINER = 256 << 20, 1 << 30


def kind(content: Column) -> Column:
    """What a file is by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("application/pdf")
    for magic, name in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(magic)), name).otherwise(out)
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "").otherwise(out)


def folder(spark: SparkSession, path: str, done: str = "Done", outputs: tuple[str, ...] = (".md", ".html", ".ocd")) -> DataFrame:
    """path, content and the rest of all PDF files below a folder, by path; the folder of finished files and outputs are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    own = ~F.contains("path", F.lit(f"/{done}/"))
    for end in outputs:
        own = own & ~F.endswith(F.lower("path"), F.lit(f"{end}.pdf"))
    return files.where(own).orderBy("path")


def members(containers: DataFrame, most_member: int = MOST_MEMBER, most_container: int = MOST_CONTAINER) -> DataFrame:
    """path, name, content of every member of zip containers (path, content).

    Bytes are counted while they are inflated; a member or container beyond its limit ends the query with its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                total = 0
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        with z.open(info) as f:
                            raw = f.read(most_member + 1)
                        total += len(raw)
                        if len(raw) > most_member or total > most_container:
                            raise ValueError(f"{path}: member {info.filename} inflates beyond the limit")
                        yield pa.RecordBatch.from_pydict({"path": [path], "name": [info.filename], "content": pa.array([raw], pa.binary())})

    return containers.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def ordered_pages(pages: DataFrame, spine: DataFrame) -> DataFrame:
    """doc_id, name, page_no: pages in the order of the spine, then those it does not name, by name: none is lost.

    spine: doc_id, name, place.
    """
    from pyspark.sql import Window as W

    first = spine.groupBy("doc_id", "name").agg(F.min("place").alias("place"))
    rows = pages.join(first, ["doc_id", "name"], "left")
    order = W.partitionBy("doc_id").orderBy(F.col("place").asc_nulls_last(), "name")
    return rows.select("doc_id", "name", (F.row_number().over(order) - 1).cast("long").alias("page_no"))


def dangling(refs: DataFrame, targets: DataFrame, *key: str) -> DataFrame:
    """Refs whose target is not there."""
    return refs.join(targets.select(*key), list(key), "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has (as often as it has more), with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
