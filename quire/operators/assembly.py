"""Text assembled from runs: words split at line ends, blanks lost at margins, node texts, read-aloud groups, matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

_LETTER = "\\p{L}\\p{Nd}"


def written_words(runs: DataFrame) -> DataFrame:
    """doc_id, word: whole words and compounds of a document, lower case; a word that ends a run on a hyphen says nothing."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"[{_LETTER}][{_LETTER}-]*"), 0)
    return runs.select("doc_id", F.explode(found).alias("word")).where(~F.endswith("word", F.lit("-"))).distinct()


def joined_hyphens(runs: DataFrame, drop: float = 0.5) -> DataFrame:
    """doc_id, run, word, kept: what becomes of each run-final hyphen that splits a word over a lower line.

    runs: doc_id, run (reading order), text, y (middle, downwards), size.  The document decides: it writes the compound
    and never the word, or the reverse; else a hyphen stays unless the next run goes on in lower case.
    """
    order = W.partitionBy("doc_id").orderBy("run")
    rows = runs.withColumns({"next": F.ltrim(F.lead("text").over(order)), "fall": F.lead("y").over(order) - F.col("y"), "em": F.greatest("size", F.lead("size").over(order))})
    # few runs have a hyphen at all
    left, right = F.when(F.contains("text", F.lit("-")), F.regexp_extract("text", f"([{_LETTER}]+)-$", 1)), F.regexp_extract("next", f"^([{_LETTER}]+)", 1)
    rows = rows.withColumns({"left": left, "right": right}).where((F.col("left") != "") & (F.col("right") != "") & (F.col("fall") > drop * F.col("em")))
    rows = rows.select("doc_id", "run", "left", "right", F.lower(F.concat("left", F.lit("-"), "right")).alias("compound"), F.lower(F.concat("left", "right")).alias("whole"))
    words = written_words(runs)
    has = lambda name: words.select("doc_id", F.col("word").alias(name), F.lit(True).alias(f"has_{name}"))
    rows = rows.join(has("compound"), ["doc_id", "compound"], "left").join(has("whole"), ["doc_id", "whole"], "left")
    compound, whole = F.coalesce("has_compound", F.lit(False)), F.coalesce("has_whole", F.lit(False))
    kept = F.when(compound != whole, compound).otherwise(~F.col("right").rlike("^\\p{Ll}"))
    return rows.withColumn("kept", kept).select("doc_id", "run", F.concat("left", F.when(F.col("kept"), "-").otherwise(""), "right").alias("word"), "kept")


def spaced(runs: DataFrame, slack: float = 0.01) -> DataFrame:
    """doc_id, run, text: a blank before a run that starts left of the one before it, in scripts that part words with blanks."""
    order = W.partitionBy("doc_id").orderBy("run")
    rows = runs.withColumns({"p_text": F.lag("text").over(order), "p_x0": F.lag("x0").over(order)})
    bare = ~F.col("p_text").rlike("\\s$") & ~F.col("text").rlike("^\\s") & (F.col("text") != "") & (F.col("p_text") != "") & ~F.endswith("p_text", F.lit("-"))
    back = bare & T.is_ltr_words(F.col("text")) & T.is_ltr_words(F.col("p_text")) & (F.col("x0") <= F.col("p_x0") + slack)
    return rows.select("doc_id", "run", F.concat(F.when(F.coalesce(back, F.lit(False)), " ").otherwise(""), "text").alias("text"))


def utterances(blocks: DataFrame, room: int = 400) -> DataFrame:
    """doc_id, utterance, start, n_blocks, n_chars: blocks read aloud in groups that begin every `room` letters, furniture left out."""
    order = W.partitionBy("doc_id").orderBy("ord")
    rows = blocks.where(~F.col("running") & (F.col("text") != "")).withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("utterance", F.expr(f"before div {room}"))
    return rows.groupBy("doc_id", "utterance").agg(F.min("before").alias("start"), F.count("*").alias("n_blocks"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def pattern_counts(blocks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, page_no, one column a pattern: its matches in the page's blocks."""
    return blocks.groupBy("doc_id", "page_no").agg(*(F.sum(T.count_matches(F.col("text"), p)).alias(name) for name, p in patterns.items()))
