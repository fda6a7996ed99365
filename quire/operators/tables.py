"""Tables: cells with spans placed on a grid, and the grid as tokens, as a Markdown table and as HTML.

cells: doc_id, tbl, row, col (their order), text, head ('column', 'row', 'both' or ''), col_span, row_span.  A table is as wide
as its widest row of cells with their spans; a cell goes to the first place of its row that no span from above has taken, and
cells beyond the width are dropped from the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

TABLE = ["doc_id", "tbl"]
_SPOT = "struct<r:int,c:int,i:int,how:string>"


def ordered(cells: DataFrame) -> DataFrame:
    """The cells with r, the number of their row among the table's rows that have cells, spans of one at least, and no null."""
    own = cells.withColumns({"col_span": F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)).cast("int"), "row_span": F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)).cast("int"), "text": F.coalesce("text", F.lit("")), "head": F.coalesce("head", F.lit(""))})
    return own.withColumn("r", (F.dense_rank().over(W.partitionBy(*TABLE).orderBy("row")) - 1).cast("int"))


def placed(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, r, c, how, text, head: the grid.  how is own, left, up or both (what a span goes on from), or empty.

    A fold over a table's cells holds what spans have taken of the rows to come.
    """
    rows = ordered(cells)
    one = rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("r", "col", "col_span", "row_span"))).alias("cells"), (F.max("r") + 1).alias("h"))
    width = rows.groupBy(*TABLE, "r").agg(F.sum("col_span").alias("n")).groupBy(*TABLE).agg(F.max("n").cast("int").alias("w"))
    one = one.join(width, TABLE)
    none = F.array().cast(f"array<{_SPOT}>")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("r"), F.lit(0).alias("c"), none.alias("busy"), none.alias("out"))

    def step(acc: Column, cell: Column) -> Column:
        busy = F.filter(acc["busy"], lambda b: b["r"] >= cell["r"])
        at = F.when(cell["r"] == acc["r"], acc["c"]).otherwise(0)
        free = F.when(at < F.col("w"), F.get(F.filter(F.sequence(at, F.col("w") - 1), lambda c: ~F.exists(busy, lambda b: (b["r"] == cell["r"]) & (b["c"] == c))), F.lit(0)))
        low = F.least(cell["row_span"], F.col("h") - cell["r"])
        wide = F.least(cell["col_span"], F.col("w") - free)
        spot = lambda j, k: F.struct((cell["r"] + j).alias("r"), (free + k).alias("c"), acc["i"].alias("i"), F.when((j > 0) & (k > 0), "both").when(j > 0, "up").when(k > 0, "left").otherwise("own").alias("how"))
        spots = F.flatten(F.transform(F.sequence(F.lit(0), low - 1), lambda j: F.transform(F.sequence(F.lit(0), wide - 1), lambda k: spot(j, k))))
        spots = F.when(free.isNull(), none).otherwise(spots)
        later = F.filter(spots, lambda s: s["r"] > cell["r"])
        return F.struct((acc["i"] + 1).alias("i"), cell["r"].alias("r"), F.coalesce(free + cell["col_span"], F.col("w")).alias("c"), F.concat(busy, later).alias("busy"), F.concat(acc["out"], spots).alias("out"))

    folded = one.select(*TABLE, "h", "w", F.aggregate("cells", start, step, lambda acc: acc["out"]).alias("out"))
    # where spans overlap, the later cell holds the spot
    spots = folded.select(*TABLE, F.explode("out").alias("s")).groupBy(*TABLE, "s.r", "s.c").agg(F.max(F.struct("s.i", "s.how")).alias("s")).select(*TABLE, "r", "c", "s.i", "s.how")
    every = folded.select(*TABLE, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r")).select(*TABLE, "r", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c"))
    said = rows.withColumn("i", (F.row_number().over(W.partitionBy(*TABLE).orderBy("r", "col", "col_span", "row_span")) - 1).cast("int")).select(*TABLE, "i", "text", "head")
    grid = every.join(spots, [*TABLE, "r", "c"], "left").join(said, [*TABLE, "i"], "left")
    return grid.select(*TABLE, "r", "c", F.coalesce("how", F.lit("empty")).alias("how"), F.when(F.col("how") == "own", F.col("text")).otherwise("").alias("text"), F.when(F.col("how") == "own", F.col("head")).otherwise("").alias("head"))


def tagless(text: Column) -> Column:
    """A text in which no tag can begin."""
    return F.trim(F.replace(F.replace(text, F.lit("<"), F.lit("‹")), F.lit(">"), F.lit("›")))


def otsl(grid: DataFrame) -> DataFrame:
    """doc_id, tbl, otsl: a token a grid place, a line a row: cells, empty ones, heads of columns and rows, and what spans go on from."""
    said = tagless(F.col("text"))
    head = F.when(F.col("head").isin("column", "both"), "<ched>").when(F.col("head") == "row", "<rhed>").otherwise("<fcel>")
    token = F.when(F.col("how") == "left", "<lcel>").when(F.col("how") == "up", "<ucel>").when(F.col("how") == "both", "<xcel>").when(said == "", "<ecel>").otherwise(F.concat(head, said))
    lines = grid.groupBy(*TABLE, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", token.alias("t")))), lambda x: x["t"]), "").alias("line"))
    return lines.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: F.concat(x["line"], F.lit("<nl>\n"))), "").alias("otsl"))


def pipes(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, markdown: rows between pipes, empty cells after one that spans columns, the first row as the head."""
    rows = ordered(cells)
    cell = F.trim(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    own = F.concat(F.array(cell), F.array_repeat(F.lit(""), F.col("col_span") - 1))
    lines = rows.groupBy(*TABLE, "r").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("col", "col_span", own.alias("x")))), lambda x: x["x"])).alias("x"))
    lines = lines.withColumn("w", F.max(F.size("x")).over(W.partitionBy(*TABLE)))
    line = F.concat(F.lit("| "), F.array_join(F.concat("x", F.array_repeat(F.lit(""), F.col("w") - F.size("x"))), " | "), F.lit(" |"), F.when(F.col("r") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("w")))).otherwise(""))
    return lines.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("markdown"))


def html(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, html: rows of td and th cells with their spans, and what a head is the head of."""
    rows = ordered(cells)
    tag = F.when(F.col("head") != "", "th").otherwise("td")
    number = lambda name, said: F.when(F.col(name) > 1, F.concat(F.lit(f' {said}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    scope = F.when(F.col("head") == "column", ' scope="col"').when(F.col("head") == "row", ' scope="row"').otherwise("")
    cell = F.concat(F.lit("<"), tag, number("col_span", "colspan"), number("row_span", "rowspan"), scope, F.lit(">"), T.escape_xml(F.col("text")), F.lit("</"), tag, F.lit(">\n"))
    lines = rows.groupBy(*TABLE, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "col_span", "row_span", cell.alias("x")))), lambda x: x["x"]), "").alias("line"))
    return lines.groupBy(*TABLE).agg(F.concat(F.lit("<table>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: F.concat(F.lit("<tr>\n"), x["line"], F.lit("</tr>\n"))), ""), F.lit("</table>\n")).alias("html"))


def written_out(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, otsl, markdown, html of every table."""
    return otsl(placed(cells)).join(pipes(cells), TABLE).join(html(cells), TABLE)
