"""One call over targets and options: convert(docs, target, options).

A conversion is a graph of stages.  A stage's key is a hash of its name, of the values of the options that it reads, and of the
keys of the stages that it stands on, down to the content of the documents; what a stage gave is a table under its key.  So a
changed option runs only what depends on it, and a second conversion of the same documents runs nothing at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pageset, sinks, spans, tables
from quire.options import Options
from quire.plans import model
from quire.sources.shared import work_dir

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """What a stage stands on, the options it reads, and what it does with the tables of those stages."""

    needs: tuple[str, ...]
    reads: tuple[str, ...]
    run: Callable[[Tables, Options], DataFrame]


def _blocks(t: Tables, o: Options) -> DataFrame:
    return model.blocks(t["documents"])


def _runs(t: Tables, o: Options) -> DataFrame:
    return model.lettered(t["documents"])


def _cut(t: Tables, o: Options) -> DataFrame:
    """Texts of the blocks that zones alter; a block without a letter left is null."""
    every = t["documents"].select("doc_id").distinct().withColumn("spec", F.lit(o["zones"]))
    left = spans.cut_runs(t["runs"], pageset.zones(every)).withColumn("left", F.array_join(F.transform("spans", lambda s: F.substring("text", s["a"] + 1, s["b"] - s["a"])), ""))
    order = F.array_sort(F.collect_list(F.struct("run", "line", "left")))
    said = F.trim(F.regexp_replace(F.array_join(F.transform("r", lambda x: x["left"]), " "), " +", " "))
    rows = left.groupBy("doc_id", "ord").agg(order.alias("r"), F.sum("n_dropped").alias("n")).where("n > 0")
    return rows.select("doc_id", "ord", F.when(said != "", said).alias("left"))


def _read(t: Tables, o: Options) -> DataFrame:
    """The blocks that are read out: without what zones cut, on the pages that are asked for, in their order."""
    b = t["blocks"]
    if o["zones"]:
        b = b.join(t["cut"].withColumn("cut", F.lit(True)), ["doc_id", "ord"], "left")
        b = b.where("cut is null or left is not null").withColumn("text", F.coalesce("left", "text")).drop("left", "cut")
    if o["pages"]:
        n = t["blocks"].groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages")).withColumn("spec", F.lit(o["pages"]))
        slots = pageset.slots(n)
        # a document without such pages is left out; a set that is none at all is refused
        if not slots.where("error = 'not a page'").isEmpty():
            raise ValueError(f"pages: {o['pages']!r} is no page set")
        places = slots.where("page_no is not null").select("doc_id", "page_no", "slot")
        rows = b.drop("slot").join(places, ["doc_id", "page_no"]).withColumn("from", F.col("ord"))
        return rows.withColumns({"ord": F.col("slot") * model.BLOCKS_A_PAGE + F.col("from") % model.BLOCKS_A_PAGE, "page_no": F.col("slot")})
    return b.withColumn("from", F.col("ord"))


def _types(t: Tables, o: Options) -> DataFrame:
    """Types and levels: headings by size, by the heading test, or none."""
    rows = model.with_types(t["read"])
    if o["headings"] != "size":
        plain = F.when(F.col("type") == "HEADING", "PARAGRAPH").otherwise(F.col("type"))
        rows = rows.withColumn("type", plain)
    if o["headings"] == "auto":
        # a heading is short, larger than the body of its document, and does not end a sentence
        body = rows.groupBy("doc_id", "size").agg(F.sum("n_chars").alias("n")).groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
        fine = (F.col("size") > F.col("body")) & (F.col("n_chars") <= 200) & ~F.col("text").rlike("[.!?…]\\s*$") & (F.col("text") != "")
        rows = rows.join(body, "doc_id").withColumn("type", F.when(fine, "HEADING").otherwise(F.col("type"))).drop("body")
    return rows if o["tables"] else rows.withColumn("type", F.when(F.col("type") == "TABLE", "PARAGRAPH").otherwise(F.col("type")))


def _tables(t: Tables, o: Options) -> DataFrame:
    return tables.written_out(model.cells(t["documents"]))


def _typed(t: Tables, o: Options) -> DataFrame:
    own = t["tables"].select("doc_id", F.col("tbl").alias("from"), "otsl", F.col("markdown").alias("table_markdown"), F.col("html").alias("table_html"))
    # a table that zones have cut is told as text
    rows = t["types"].join(own, ["doc_id", "from"], "left")
    if o["zones"]:
        rows = rows.join(t["cut"].select("doc_id", F.col("ord").alias("from"), F.lit(True).alias("cut")), ["doc_id", "from"], "left")
        rows = rows.withColumn("type", F.when((F.col("type") == "TABLE") & F.col("cut"), "PARAGRAPH").otherwise(F.col("type"))).drop("cut")
    return rows


def _units(t: Tables, o: Options) -> DataFrame:
    heading = F.col("type") == "HEADING"
    weight = F.when(heading, 0).when(F.col("type") == "FIGURE", o["min_chapter"]).otherwise(F.length("text")).cast("long")
    return sinks.chapters(t["types"].select("doc_id", "ord", F.when(heading, F.col("level")).alias("level"), weight.alias("weight")), o["min_chapter"])


STAGES: dict[str, Stage] = {
    "blocks": Stage(("documents",), (), _blocks),
    "runs": Stage(("documents",), (), _runs),
    "cut": Stage(("documents", "runs"), ("zones",), _cut),
    "read": Stage(("blocks", "cut"), ("pages", "zones"), _read),
    "types": Stage(("read",), ("headings", "tables"), _types),
    "tables": Stage(("documents",), (), _tables),
    "typed": Stage(("types", "tables", "cut"), ("zones",), _typed),
    "md": Stage(("typed",), (), lambda t, o: sinks.markdown(t["typed"])),
    "html": Stage(("typed",), (), lambda t, o: sinks.html(t["typed"])),
    "doctags": Stage(("typed",), ("grid",), lambda t, o: sinks.doctags(t["typed"], o["grid"])),
    "stages": Stage(("typed",), (), lambda t, o: sinks.page_json(t["typed"])),
    "book": Stage(("types",), ("min_chapter",), _units),
    "text": Stage(("read",), (), lambda t, o: sinks.assembled(t["read"].where("text <> ''"), "ord", "text", "text", "\n")),
    "toc": Stage(("types",), (), lambda t, o: t["types"].where("type = 'HEADING'").select("doc_id", "ord", "level", "page_no", F.col("text").alias("title"))),
}
TARGETS = ("md", "html", "doctags", "stages", "book", "text", "toc")


def content_key(docs: DataFrame) -> str:
    """A hash of the rows, whatever their order: their number and two sums of their hashes."""
    names = sorted(docs.columns)
    low, high = F.xxhash64(*names), F.xxhash64(F.lit(7), *reversed(names))
    total = docs.agg(F.count("*").alias("n"), F.sum(low.cast("decimal(38,0)")).alias("a"), F.sum(high.cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(json.dumps([names, total.n, str(total.a), str(total.b)]).encode()).hexdigest()


@dataclass
class Converter:
    """Conversions of documents (doc_id, text, source, lang, n_chars) that share what their stages gave, in one folder."""

    spark: SparkSession
    folder: str
    #: Names of the stages that were run, in order.
    ran: list[str] = field(default_factory=list)

    def key(self, stage: str, root: str, options: Options) -> str:
        if stage == "documents":
            return root
        s = STAGES[stage]
        parts = [stage, {n: options[n] for n in s.reads}, [self.key(n, root, options) for n in s.needs]]
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    def table(self, stage: str, docs: DataFrame, root: str, options: Options) -> DataFrame:
        if stage == "documents":
            return docs
        place = f"{self.folder.rstrip('/')}/{stage}-{self.key(stage, root, options)[:32]}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            own = {n: self.table(n, docs, root, options) for n in STAGES[stage].needs}
            STAGES[stage].run(own, options).write.mode("overwrite").parquet(place)
            self.ran.append(stage)
        return self.spark.read.parquet(place)

    def convert(self, docs: DataFrame, target: str, options: dict[str, object] | None = None, from_request: bool = False) -> DataFrame:
        if target not in TARGETS:
            raise ValueError(f"{target}: none of {', '.join(TARGETS)}")
        return self.table(target, docs, content_key(docs), Options.of(options or {}, from_request))


def convert(docs: DataFrame, target: str, options: dict[str, object] | None = None, folder: str | None = None, from_request: bool = False) -> DataFrame:
    """The documents in a target, a row each (book: a row a chapter; toc: a row a heading; stages: a row a page).

    options are named in quire.options and given sparsely; what they do not name has its default.  With a folder, stages that
    were run there for the same documents and options are not run again.
    """
    spark = docs.sparkSession
    return Converter(spark, folder or f"{work_dir(spark)}/conversion").convert(docs, target, options, from_request)
