"""Figure regions against the same rules walked page by page, and each rule on both its sides."""

import random

import pytest

from quire.operators import figures as G

PIECES = "doc_id long, page_no long, id long, picture boolean, x0 long, y0 long, x1 long, y1 long"
TEXTS = "doc_id long, page_no long, ord long, n_lines long, n_chars long, heading boolean, x0 long, y0 long, x1 long, y1 long"
LINES = "doc_id long, page_no long, ord long, x0 long, y0 long, x1 long, y1 long"


def union(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def near(a, b, room=G.GAP):
    return all(a[v] - room <= b[v + 2] and b[v] - room <= a[v + 2] for v in (0, 1))


def shares(a, b):
    return all(max(a[v], b[v]) < min(a[v + 2], b[v + 2]) for v in (0, 1))


def within(a, b):
    return a[0] <= b[0] < b[2] <= a[2] and a[1] <= b[1] < b[3] <= a[3]


def grown(parts, body, close):
    """Rounds of parts {(glue, id): box} that name each other; returns what joined what."""
    log = []
    while True:
        wish = {}
        for (g, i), a in parts.items():
            for (h, j), b in parts.items():
                u = union(a, b)
                if (g, i) != (h, j) and not (g and h) and (not close or near(a, b)) and not any(shares(u, t) for t in body):
                    wish[g, i] = min(wish.get((g, i), (area(u), h, j)), (area(u), h, j))
        pairs = [(k, w[1:]) for k, w in wish.items() if wish.get(w[1:], (0, 0, 0))[1:] == k and (k[0] or not w[1] and k[1] > w[2])]
        if not pairs:
            return log
        for k, to in pairs:
            parts[to] = union(parts[to], parts.pop(k))
            log.append((k, to[1]))


def walk(pieces, texts, lines):
    drawn = [p[4:] for p in pieces]
    body, heads, labels = [], [], {}
    for t in texts:
        box, long = t[6:], t[4] >= G.LABEL
        under = [d for d in drawn if not within(d, box) and shares(d, box)]
        on = [any(d[0] <= r[3] + (x + 0.5) * (r[5] - r[3]) / 8 <= d[2] and d[1] <= (r[4] + r[6]) / 2 <= d[3] for d in under) for r in lines if r[2] == t[2] for x in range(8)]
        if long and (t[3] >= G.COLUMN or not (under and on and 2 * sum(on) >= len(on))):
            body.append(box)
        elif t[5]:
            heads.append(box)
        else:
            labels[t[2]] = box
    parts, members = {}, {}
    for p in pieces:
        box = p[4:]
        if not p[3]:
            parts[True, p[2]] = box
        elif not (any(within(box, t) for t in body) or any(within(box, t) for t in heads) and not any(within(box, t) for t in labels.values())):
            parts[False, p[2]] = box
            members["picture", p[2]] = {p[2]}

    def note(log):
        for (glue, i), to in log:
            for k, v in members.items():
                if not glue and i in v:
                    members[k] = v - {i} | {to}
            if glue:
                members["glue", i] = {to}

    while True:
        note(grown(parts, body, True))
        sets = {}
        for o, r in sorted(labels.items()):
            rs = sorted(i for (g, i), b in parts.items() if not g and near(b, r))
            u = r
            for i in rs:
                u = union(u, parts[False, i])
            if len(rs) >= 2 and not any(shares(u, t) for t in body):
                sets[o] = (rs, u)
        chosen = {o: s for o, s in sets.items() if all(o == min(q for q, (other, _) in sets.items() if r in other) for r in s[0])}
        if not chosen:
            break
        for o, (rs, u) in chosen.items():
            for i in rs[1:]:
                del parts[False, i]
                note([((False, i), rs[0])])
            parts[False, rs[0]] = u
            members["label", o] = {rs[0]}
            del labels[o]
    parts = {k: v for k, v in parts.items() if not k[0]}
    note(grown(parts, body, False))
    for o, r in labels.items():
        small = (r[0] + G.HUG, r[1] + G.HUG, r[2] - G.HUG, r[3] - G.HUG)
        for (_, i), b in parts.items():
            if small[0] < small[2] and small[1] < small[3] and shares(small, b):
                members["label", o] = members.get(("label", o), set()) | {i}
    labelled = {i for (k, _), v in members.items() if k == "label" for i in v}
    crumbs = sorted(i for (_, i), b in parts.items() if area(b) < G.CRUMB * 1_000_000 and i not in labelled)
    if len(crumbs) >= G.SCATTER:
        for i in crumbs[1:]:
            parts[False, crumbs[0]] = union(parts[False, crumbs[0]], parts.pop((False, i)))
            note([((False, i), crumbs[0])])
    return {i: b for (_, i), b in parts.items()}, {(k, i, r) for (k, i), v in members.items() for r in v}


def both(spark, pages):
    """Regions and members of pages (pieces, texts, lines) as the tables give them."""
    rows = [[], [], []]
    for n, page in enumerate(pages):
        for k in range(3):
            rows[k] += [(n // 2, n % 2, *r[2:]) for r in page[k]]
    boxes, members = G.regions(*(spark.createDataFrame(r, s).repartition(2) for r, s in zip(rows, (PIECES, TEXTS, LINES))))
    out = [({}, set()) for _ in pages]
    for r in boxes.collect():
        out[2 * r.doc_id + r.page_no][0][r.region] = (r.x0, r.y0, r.x1, r.y1)
    for r in members.collect():
        out[2 * r.doc_id + r.page_no][1].add((r.kind, r.id, r.region))
    return out


def picture(i, *box):
    return (0, 0, i, True, *box)


def loose(i, *box):
    return (0, 0, i, False, *box)


def text(o, n_lines, n_chars, *box, heading=False):
    return (0, 0, o, n_lines, n_chars, heading, *box)


def line(o, *box):
    return (0, 0, o, *box)


A, B = picture(1, 100, 100, 200, 200), picture(2, 300, 100, 400, 200)
WALL = text(9, 6, 900, 230, 0, 270, 1000)
CASES = {
    "near": ([A, picture(2, 212, 100, 300, 200), WALL[:0] or loose(50, 900, 900, 910, 910)], [], []),
    "a wall keeps apart": ([A, B], [WALL], []),
    "short text is no wall": ([A, B], [text(9, 6, 99, 230, 0, 270, 1000)], []),
    "three lines on the drawing are no body": ([A, B, loose(5, 90, 90, 160, 210)], [text(9, 3, 200, 150, 120, 350, 180)], [line(9, 150, 120, 350, 140)]),
    "four lines are": ([A, B], [text(9, 4, 200, 150, 120, 350, 180)], [line(9, 150, 120, 350, 140)]),
    "a frame of body": ([picture(1, 0, 0, 500, 500), picture(2, 600, 0, 700, 100)], [text(9, 5, 400, 10, 10, 490, 490)], []),
    "a frame of a heading": ([A], [text(9, 1, 20, 110, 110, 190, 130, heading=True)], []),
    "with a label it is none": ([A], [text(9, 1, 20, 110, 110, 190, 130, heading=True), text(8, 1, 5, 120, 150, 150, 170)], []),
    "a label overlaps": ([A, WALL[:0] or picture(3, 500, 500, 600, 600)], [WALL, text(8, 1, 9, 190, 150, 220, 170)], []),
    "a caption stands beside": ([A], [WALL, text(8, 1, 9, 197, 150, 230, 170)], []),
    "four crumbs": ([picture(i, 10, 100 * i, 40, 100 * i + 30) for i in range(1, 5)], [text(20 + i, 5, 200, 0, 100 * i + 40, 90, 100 * i + 90) for i in range(1, 5)], []),
    "five crumbs are one": ([picture(i, 10, 100 * i, 40, 100 * i + 30) for i in range(1, 6)], [text(20 + i, 5, 200, 0, 100 * i + 40, 90, 100 * i + 90) for i in range(1, 6)], []),
    "loose pieces alone are none": ([loose(1, 0, 0, 10, 10), loose(2, 5, 5, 20, 20)], [], []),
}


def test_rules(spark):
    names, pages = list(CASES), list(CASES.values())
    got = dict(zip(names, both(spark, pages)))
    for n, page in CASES.items():
        assert got[n] == walk(*page), n
    regions = {n: sorted(g[0]) for n, g in got.items()}
    assert regions == {
        "near": [1], "a wall keeps apart": [1, 2], "short text is no wall": [1], "three lines on the drawing are no body": [1], "four lines are": [1, 2], "a frame of body": [2], "a frame of a heading": [], "with a label it is none": [1],
        "a label overlaps": [1, 3], "a caption stands beside": [1], "four crumbs": [1, 2, 3, 4], "five crumbs are one": [1], "loose pieces alone are none": [],
    }
    assert ("label", 8, 1) in got["a label overlaps"][1] and ("label", 8, 1) not in got["a caption stands beside"][1]


def page_of(rng):
    box = lambda w, h: (lambda x, y: (x, y, x + rng.randint(2, w), y + rng.randint(2, h)))(rng.randint(0, 900), rng.randint(0, 900))
    pieces = [(0, 0, i, rng.random() < 0.6, *box(120, 120)) for i in range(rng.randint(0, 14))]
    texts, lines = [], []
    for o in range(rng.randint(0, 8)):
        b = box(250, 60)
        n = rng.randint(1, 6)
        texts.append((0, 0, o, n, rng.choice([5, 40, 99, 100, 300]), rng.random() < 0.2, *b))
        lines += [(0, 0, o, b[0], b[1] + k * 10, max(b[0] + 1, b[2] - rng.randint(0, 80)), b[1] + k * 10 + 8) for k in range(n)]
    return pieces, texts, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    pages = [page_of(rng) for _ in range(60)]
    for got, page in zip(both(spark, pages), pages):
        assert got == walk(*page)
