"""Word tables of recognised pages, metadata, and JSON members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ocr_words(rows: DataFrame) -> DataFrame:
    """doc_id, no, text, x, y, w, h, conf, line from rows (doc_id, no, row) of a recogniser's tab-separated table.

    Words are rows of level 5 with twelve cells and text; confidence is a share, -1 where there is none; lines are
    numbered as they come.  A malformed row is left out.
    """
    def word(c: Column) -> Column:
        number = lambda i: c[i].try_cast("double")
        cells = F.struct(F.trim(F.regexp_replace(c[11], "^\\s+|\\s+$", "")).alias("text"), number(6).alias("x"), number(7).alias("y"), number(8).alias("w"), number(9).alias("h"), number(10).alias("conf"), F.array_join(F.slice(c, 2, 4), ".").alias("key"))
        return F.when((F.size(c) >= 12) & (F.get(c, F.lit(0)) == "5"), cells)

    fine = lambda x: (x["text"] != "") & x["x"].isNotNull() & x["y"].isNotNull() & x["w"].isNotNull() & x["h"].isNotNull() & x["conf"].isNotNull()
    # a row is split once; a filter on columns of a projection would be pushed below it and split the row for each of them
    found = F.filter(F.transform(F.array(F.split("row", "\t", -1)), word), fine)
    words = rows.select("doc_id", "no", F.explode_outer(found).alias("f")).where("f is not null").select("doc_id", "no", "f.*")
    # dealt once: both windows lie within documents
    words = words.repartition("doc_id")
    first = F.min("no").over(W.partitionBy("doc_id", "key"))
    words = words.withColumn("first", first)
    line = F.dense_rank().over(W.partitionBy("doc_id").orderBy("first")) - 1
    return words.select("doc_id", "no", "text", "x", "y", "w", "h", F.when(F.col("conf") < 0, -1.0).otherwise(F.col("conf") / 100).alias("conf"), line.cast("long").alias("line"))


def ocr_pages(words: DataFrame, doubt: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_words, n_doubtful, text: words by blanks, lines by line ends; no confidence is no doubt."""
    lines = words.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("no", "text"))).alias("w"), F.count("*").alias("n"), F.count(F.when((F.col("conf") >= 0) & (F.col("conf") < doubt), 1)).alias("d"))
    lines = lines.withColumn("said", F.array_join(F.transform("w", lambda x: x["text"]), " "))
    pages = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "said"))).alias("l"), F.count("*").alias("n_lines"), F.sum("n").alias("n_words"), F.sum("d").alias("n_doubtful"))
    return pages.select("doc_id", "n_lines", "n_words", "n_doubtful", F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("text"))


def first_said(*candidates: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def xmp(packet: Column) -> dict[str, Column]:
    """title, creators and language of an RDF packet; the language of a title's alternatives does not matter."""
    one = lambda path: F.xpath_string(packet, F.lit(path))
    any_ = lambda name: f"//*[local-name()='{name}']"
    title = first_said(one(any_("title") + "//*[local-name()='li']"), one(any_("title")), one(any_("Title")))
    creators = F.filter(F.xpath(packet, F.lit(any_("creator") + "//*[local-name()='li']/text()")), lambda x: F.trim(x) != "")
    return {"title": title, "creators": F.array_join(F.transform(creators, lambda x: F.trim(x)), "; "), "language": first_said(one(any_("language") + "//*[local-name()='li']"), one(any_("language")))}


def json_path(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as a/b, null where there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(json), "$." + path.replace("/", "."), kind)
