"""Read-out, search, vocabulary, redaction and page sets over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T


def page_text(lines: DataFrame) -> DataFrame:
    """Text of each page, its lines in reading order."""
    own = lines.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return own.select("doc_id", "page_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("page_text"))


def search(lines: DataFrame, needle: str) -> DataFrame:
    """Lines that hold a folded needle, with its first place and a snippet."""
    at = F.instr(T.fold(F.col("line")), needle)
    return lines.select("doc_id", "page_no", "line_no", at.cast("long").alias("hit"), T.snippet(F.col("line"), at).alias("snippet")).where("hit > 0")


def vocabulary(lines: DataFrame) -> DataFrame:
    """Distinct whole words and hyphen compounds, lower case."""
    words = F.regexp_extract_all(F.lower("line"), F.lit("[\\p{L}]+(?:-[\\p{L}]+)*"), 0)
    return lines.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).distinct().select("doc_id", "word", F.contains("word", F.lit("-")).alias("is_compound"))


def word_runs(line, line_no, y, size):
    """The words of a line as runs: word_no, word, x, y, size, z; a word stands where its letters do."""
    words = F.split(line, " ", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word_no:bigint,word:string,x:double,y:double,size:double,z:bigint>>").alias("out"))

    def step(acc, w):
        no = F.size(acc["out"]).cast("long")
        run = F.struct(no.alias("word_no"), w.alias("word"), (72.0 + 5.0 * acc["at"]).alias("x"), y.alias("y"), size.alias("size"), (line_no * 100 + no).alias("z"))
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.concat(acc["out"], F.array(run)).alias("out"))

    return F.filter(F.aggregate(words, start, step, lambda acc: acc["out"]), lambda r: r["word"] != "")


def page_runs(lines: DataFrame, every: int = 97) -> DataFrame:
    """doc_id, page_no, line_no, runs, boxes: the runs of each line, and the opaque boxes of its page.

    Boxes lie over some words, by number, and are painted after them.  One exchange: lines by page, as texts; runs are made after
    it, and before it for the lines that have a box only.
    """
    runs = word_runs(F.col("line"), F.col("line_no"), F.col("y"), F.col("size"))
    covered = F.filter(runs, lambda r: F.pmod(F.col("doc_id") * 31 + r["word_no"] + F.col("line_no"), F.lit(every)) == 0)
    box = F.transform(covered, lambda r: F.struct(r["x"].alias("x0"), (r["x"] + 5.0 * F.length(r["word"])).alias("x1"), (r["y"] - 0.2 * r["size"]).alias("y0"), (r["y"] + 0.8 * r["size"]).alias("y1"), (r["z"] + 0.5).alias("z")))
    # the number of the first word that a box would cover
    first = F.pmod(-(F.col("doc_id") * 31 + F.col("line_no")), F.lit(every))
    rows = lines.select("doc_id", "page_no", "line_no", "line", "y", "size", F.when(first < F.size(F.split("line", " ", -1)), box).alias("own"))
    boxes = F.flatten(F.collect_list("own").over(W.partitionBy("doc_id", "page_no")))
    return rows.select("doc_id", "page_no", "line_no", "line", "y", "size", boxes.alias("boxes")).select("doc_id", "page_no", "line_no", runs.alias("runs"), "boxes")


def hidden(run, boxes):
    """Is a run under an opaque box?  Its anchor (a quarter of the size in, 0.35 up) lies in the box, painted below it."""
    ax, ay = run["x"] + 0.25 * run["size"], run["y"] + 0.35 * run["size"]
    return F.exists(boxes, lambda b: (ax >= b["x0"]) & (ax <= b["x1"]) & (ay >= b["y0"]) & (ay <= b["y1"]) & (run["z"] < b["z"]))


def hidden_words(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, word_no, word of the runs under a box (pages as page_runs gives them)."""
    rows = pages.where(F.size("boxes") > 0).select("doc_id", "page_no", "line_no", F.explode(F.filter("runs", lambda r: hidden(r, F.col("boxes")))).alias("r"))
    return rows.select("doc_id", "page_no", "line_no", "r.word_no", "r.word")


def redacted(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, runs: what remains once hidden words are cut out."""
    return pages.withColumn("runs", F.when(F.size("boxes") == 0, F.col("runs")).otherwise(F.filter("runs", lambda r: ~hidden(r, F.col("boxes"))))).drop("boxes")


def page_set(lines: DataFrame, slots: list[int]) -> DataFrame:
    """Pages chosen by 0-based number in a new order; repeats are copies: doc_id, new_page, page_no, n_lines."""
    spark = lines.sparkSession
    plan = spark.sql("SELECT posexplode(array(" + ", ".join(f"{s}L" for s in slots) + ")) AS (new_page, page_no)")
    held = lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"))
    return held.join(F.broadcast(plan), "page_no").select("doc_id", F.col("new_page").cast("long").alias("new_page"), "page_no", "n_lines")


def markdown(lines: DataFrame) -> DataFrame:
    """One Markdown text a document: the title as a heading, list items, paragraphs."""
    paras = lines.groupBy("doc_id", "para_no").agg(F.sort_array(F.collect_list(F.struct("part", "line"))).alias("l"), F.max("size").alias("size"))
    whole = T.collapse(F.array_join(F.transform("l", lambda x: x["line"]), " "))
    block = F.when(F.col("size") > 10, F.concat(F.lit("# "), whole)).when(T.is_list_item(whole), F.concat(F.lit("- "), T.strip_marker(whole))).otherwise(whole)
    rows = paras.select("doc_id", "para_no", block.alias("block")).where("block <> ''")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "block"))), lambda x: x["block"]), "\n\n").alias("markdown"))
