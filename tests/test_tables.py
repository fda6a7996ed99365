"""Tables on a grid against a plain placement, and the three ways they are written."""

import random

from quire.operators import sinks as K
from quire.operators import tables as B

CELLS = "doc_id long, tbl long, row int, col int, text string, head string, col_span int, row_span int"


def grid(rows):
    width, height = max(sum(max(1, c[2] or 1) for c in r) for r in rows), len(rows)
    out = [[None] * width for _ in rows]
    for i, row in enumerate(rows):
        j = 0
        for text, head, cs, rs in row:
            while j < width and out[i][j] is not None:
                j += 1
            if j >= width:
                break
            cs, rs = max(1, cs or 1), max(1, rs or 1)
            for a in range(min(rs, height - i)):
                for b in range(min(cs, width - j)):
                    out[i + a][j + b] = "xcel" if a and b else "ucel" if a else "lcel" if b else f"{'fcel' if not head else 'rhed' if head == 'row' else 'ched'}>{text}" if text else "ecel"
            j += cs
    return "".join("".join(("<" + (x or "ecel")) + ("" if ">" in (x or "") else ">") for x in line) + "<nl>\n" for line in out)


def test_tokens_equal_a_plain_placement(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(120):
        own = [[(rng.choice(["", "a", "bc"]), rng.choice(["", "", "column", "row", "both"]), rng.choice([1, 1, 1, 2, 3, 0, None]), rng.choice([1, 1, 1, 2, 4, None])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        rows += [(t // 3, t % 3, 10 * i, j, *c) for i, r in enumerate(own) for j, c in enumerate(r)]
        want[t // 3, t % 3] = grid(own)
    cells = spark.createDataFrame(rows, CELLS).repartition(3)
    got = {(r.doc_id, r.tbl): r.otsl for r in B.otsl(B.placed(cells)).collect()}
    assert got == want
    assert B.written_out(cells).count() == 120 and B.written_out(cells.where("false")).count() == 0


TABLE = [(1, 5, 0, 0, "A|x", "both", 2, 1), (1, 5, 0, 1, "<B>", "column", 1, 2), (1, 5, 1, 0, "1\n2", "row", 1, 1), (1, 5, 1, 1, None, None, None, None), (1, 5, 3, 0, "end & all", "", 1, 1)]


def test_one_table_three_ways(spark):
    r = B.written_out(spark.createDataFrame(TABLE, CELLS)).collect()[0]
    assert r.otsl == "<ched>A|x<lcel><ched>‹B›<nl>\n<rhed>1\n2<ecel><ucel><nl>\n<fcel>end & all<ecel><ecel><nl>\n"
    assert r.markdown == "| A\\|x |  | <B> |\n| --- | --- | --- |\n| 1 2 |  |  |\n| end & all |  |  |"
    assert r.html == '<table>\n<tr>\n<th colspan="2">A|x</th>\n<th rowspan="2" scope="col">&lt;B&gt;</th>\n</tr>\n<tr>\n<th scope="row">1\n2</th>\n<td></td>\n</tr>\n<tr>\n<td>end &amp; all</td>\n</tr>\n</table>\n'


def test_tables_in_the_sinks(spark):
    blocks = [(1, 4, "PARAGRAPH", "before"), (1, 5, "TABLE", "x"), (1, 6, "CAPTION", "Table 1"), (1, 7, "TABLE", "no cells"), (1, 8, "CAPTION", "t"), (1, 9, "CAPTION", "alone")]
    rows = spark.createDataFrame([(d, o, 0, 0, 0, 1000, 500, k, 1, t) for d, o, k, t in blocks], "doc_id long, ord long, page_no long, x0 long, y0 long, x1 long, y1 long, type string, level long, text string")
    own = K.with_tables(rows, B.written_out(spark.createDataFrame(TABLE, CELLS)))
    loc = "<loc_0><loc_0><loc_500><loc_250>"
    tokens = "<ched>A|x<lcel><ched>‹B›<nl>\n<rhed>1\n2<ecel><ucel><nl>\n<fcel>end & all<ecel><ecel><nl>\n"
    assert K.doctags(own).first().doctags == f"<doctag>\n<text>{loc}before</text>\n<otsl>{loc}\n{tokens}<caption>{loc}Table 1</caption>\n</otsl>\n<otsl>{loc}\n<caption>{loc}t</caption>\n</otsl>\n<text>{loc}alone</text>\n</doctag>\n"
    assert K.markdown(own).first().markdown == "before\n\n| A\\|x |  | <B> |\n| --- | --- | --- |\n| 1 2 |  |  |\n| end & all |  |  |\n\n*Table 1*\n\n*t*\n\n*alone*"
    assert K.html(own).first().html.startswith("<p>before</p>\n<table>\n<tr>\n<th colspan=\"2\">") and "<table>\n</table>\n" in K.html(own).first().html
