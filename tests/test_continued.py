"""Paragraphs over page breaks against a walk that holds labels in a queue."""

import random

from quire.operators import structure as S

BLOCKS = "doc_id long, ord long, page_no long, size long, x0 long, x1 long, y0 long, y1 long, n_chars long, interrupts boolean"
MEASURES = "doc_id long, ord long, n_lines long, own long, wrapped long, end long, lead long"


def runs_on(a, b):
    column = max(a["own"], b["own"])
    measure = column if a["own"] * 100 < column * S.RAGGED else a["own"]
    if a["n_lines"] < 2 or a["end"] < max(min(measure * S.FULL / 100, a["wrapped"]), measure * S.RAGGED / 100):
        return False
    return (b["n_lines"] < 2 or b["lead"] * 100 <= S.INDENT * max(1, b["size"])) and abs(a["size"] - b["size"]) * 2 <= 1


def over(a, b):
    column = max(a["own"], b["own"])
    return runs_on(a, b) and (abs(b["x0"] - a["x0"]) * 100 <= S.SLACK * column or abs(b["x1"] - b["x0"] - a["x1"] + a["x0"]) * 100 <= S.SLACK * column)


def beside(a, b):
    column = max(a["own"], b["own"])
    return runs_on(a, b) and b["x0"] * 100 >= a["x1"] * 100 - S.SLACK * column and b["x0"] - a["x1"] < column and b["y0"] < a["y1"]


def walk(blocks):
    """Paragraphs as lists of blocks, in the order in which they begin; a heading is one of its own."""
    out, last, carry, held = [], None, None, []
    for b in blocks:
        fresh_page = last is not None and b["page_no"] != last["page_no"]
        open_ = bool(last) and not last["interrupts"] and out[-1][-1] is last
        if fresh_page:
            carry, held = (out[-1] if open_ else None), []
        if carry is not None and (b["interrupts"] or carry[-1]["page_no"] != b["page_no"] - 1):
            carry = None
        if b["interrupts"]:
            out.append([b])
        elif carry is not None and not fresh_page and over(carry[-1], b):
            carry.append(b)
            carry = None
        elif open_ and (fresh_page and b["page_no"] == last["page_no"] + 1 and over(last, b) or not fresh_page and beside(last, b)):
            out[-1].append(b)
            carry = None
        else:
            out.append([b])
            if carry is not None and b["n_lines"] < S.COLUMN_LINES and b["n_chars"] < S.LABEL_LETTERS:
                held.append(b)
            else:
                carry = None
        last = b
    return {(x["doc_id"], x["ord"]): i + 1 for i, p in enumerate(out) for x in p}


def made(rng, d, n):
    out, page = [], 0
    for o in range(n):
        page += rng.choice([0, 0, 1, 1, 1, 2]) if o and rng.random() < 0.55 else 0
        short, left = rng.random() < 0.45, rng.choice([0, 0, 0, 420])
        lines = rng.choice([1, 2, 3]) if short else rng.choice([2, 4, 6])
        out.append({"doc_id": d, "ord": o, "page_no": page, "size": rng.choice([10, 10, 10, 10, 12]), "x0": left, "x1": left + (150 if short else 400), "y0": rng.choice([0, 50]), "y1": rng.choice([40, 90]), "n_chars": 40 if short else 400, "interrupts": rng.random() < 0.06, "n_lines": lines, "own": 150 if short else 400, "wrapped": rng.choice([390, 330]) if lines > 1 else None, "end": rng.choice([400, 395, 340, 100]), "lead": rng.choice([0, 0, 0, 20]) if lines > 1 else None})
    return out


def frames(spark, rows):
    pick = lambda ddl: spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)
    return pick(BLOCKS).repartition(3), pick(MEASURES)


def test_a_label_is_held(spark):
    base = {"doc_id": 1, "size": 10, "x0": 0, "x1": 400, "y0": 0, "y1": 90, "n_chars": 400, "interrupts": False, "n_lines": 4, "own": 400, "wrapped": 390, "end": 398, "lead": 0}
    label = {"x0": 500, "x1": 600, "n_chars": 20, "n_lines": 1, "own": 100, "wrapped": None, "end": 100, "lead": None}
    rows = [base | {"ord": 0, "page_no": 0}, base | label | {"ord": 1, "page_no": 1}, base | label | {"ord": 2, "page_no": 1}, base | {"ord": 3, "page_no": 1}, base | {"ord": 4, "page_no": 2}]
    got = {r.ord: r.para for r in S.continued(*frames(spark, rows)).collect()}
    # the sequel joins past two labels; what follows it on the next page begins anew
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 4}
    rows[2] |= {"interrupts": True}
    assert {r.ord: r.para for r in S.continued(*frames(spark, rows)).collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4}


def test_continued_equals_the_walk(spark):
    rng = random.Random(5)
    rows, want, held = [], {}, 0
    for d in range(400):
        own = made(rng, d, rng.randint(1, 40))
        rows += own
        numbers = walk(own)
        want |= numbers
        paras = [numbers[d, b["ord"]] for b in own]
        held += sum(b < a for a, b in zip(paras, paras[1:]))
    got = {(r.doc_id, r.ord): r.para for r in S.continued(*frames(spark, rows)).collect()}
    assert got == want and held > 30
    assert S.continued(*(f.where("false") for f in frames(spark, rows[:1]))).count() == 0
