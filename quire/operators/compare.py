"""Texts compared: the hunks by which one becomes the other, each under the heading above it.

Words that occur once on both sides of a stretch are its anchors; the longest run of anchors that stand in the same order cuts it
into smaller stretches, which have anchors of their own.  Memory is linear in the words, and no pair is too long.  Where a
stretch has no such word, up to WORK pairs of places are aligned word by word, and a larger one is one hunk.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: equal words that two hunks may have between them and be one.
BRIDGE = 3
#: Pairs of places up to which a stretch without anchors is aligned.
WORK = 250_000
#: Words up to which plain loops are faster than arrays.
FEW = 256


def anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of words that occur once in each, the most that stand in one order on both sides."""

    def once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, first, n = np.unique(x, return_index=True, return_counts=True)
        return word[n == 1], first[n == 1]

    if len(a) + len(b) <= FEW:
        x, y = a.tolist(), b.tolist()
        n, m, place = Counter(x), Counter(y), {w: j for j, w in enumerate(y)}
        left = [i for i, w in enumerate(x) if n[w] == 1 and m[w] == 1]
        right = [place[x[i]] for i in left]
    else:
        (u, p), (v, q) = once(a), once(b)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        order = np.argsort(p[i])
        left, right = p[i][order].tolist(), q[j][order].tolist()
    # the ends of increasing runs by length, and what came before each place
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, y in enumerate(right):
        n = bisect_left(ends, y)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [y], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append((left[k], right[k]))
        k = before[k]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal words by the fewest deletions and insertions: the furthest reach of each diagonal, one change more a round."""
    n, m = len(a), len(b)
    reach, rounds = {1: 0}, []
    for d in range(n + m + 1):
        rounds.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    out, x, y = [], n, m
    for d in range(len(rounds) - 1, -1, -1):
        own, k = rounds[d], x - y
        up = k == -d or k != d and own[k - 1] < own[k + 1]
        px = own[k + 1] if up else own[k - 1]
        py = px - (k + 1 if up else k - 1)
        start = px if up else px + 1
        out += [(i, i - k) for i in range(x - 1, start - 1, -1)] if d else [(i, i) for i in range(x - 1, -1, -1)]
        x, y = px, py
    return out[::-1]


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first words of two stretches, as long as each other, are equal."""
    if not len(a) or a[0] != b[0]:
        return 0
    differ = a != b
    first = int(differ.argmax())
    return first if differ[first] else len(a)


def stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of every stretch that differs, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = min(a1 - a0, b1 - b0)
        head = alike(a[a0 : a0 + n], b[b0 : b0 + n])
        a0, b0, n = a0 + head, b0 + head, n - head
        tail = alike(a[a1 - n : a1][::-1], b[b1 - n : b1][::-1])
        a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            if a0 < a1 or b0 < b1:
                out.append((a0, a1, b0, b1))
            continue
        found = anchors(a[a0:a1], b[b0:b1])
        small = not found and (a1 - a0) * (b1 - b0) <= WORK
        if small:
            found = aligned(a[a0:a1].tolist(), b[b0:b1].tolist())
        if not found:
            out.append((a0, a1, b0, b1))
            continue
        edge, parts = (a0, b0), []
        for i, j in [*found, (a1 - a0, b1 - b0)]:
            parts.append((edge[0], a0 + i, edge[1], b0 + j))
            edge = (a0 + i + 1, b0 + j + 1)
        parts = [p for p in parts if p[0] < p[1] or p[2] < p[3]]
        if small:
            out += parts[::-1]
        else:
            todo += parts
            continue
    return sorted(out)


def hunks(a: list[str], b: list[str], bridge: int = BRIDGE) -> list[tuple[str, int, int, int, int]]:
    """(kind, from, to, from, to) in words; up to `bridge` equal words between two hunks belong to one."""
    number: dict[str, int] = {}
    ids = lambda x: np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x))
    merged: list[tuple[int, int, int, int]] = []
    for s in stretches(ids(a), ids(b)):
        if merged and s[0] - merged[-1][1] <= bridge:
            merged[-1] = (merged[-1][0], s[1], merged[-1][2], s[3])
        else:
            merged.append(s)
    return [("delete" if s[2] == s[3] else "insert" if s[0] == s[1] else "replace", *s) for s in merged]


HUNK = "doc_id long, hunk long, kind string, a0 long, a1 long, b0 long, b1 long, was string, becomes string"


def compare(pairs: DataFrame) -> DataFrame:
    """doc_id, hunk, kind, a0, a1, b0, b1, was, becomes from texts (doc_id, a, b); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, a, b = (batch.column(c)[i].as_py() for c in ("doc_id", "a", "b"))
                a, b = (a or "").split(), (b or "").split()
                rows = [(doc, n, *h, " ".join(a[h[1] : h[2]]), " ".join(b[h[3] : h[4]])) for n, h in enumerate(hunks(a, b))]
                for at in range(0, len(rows), 4096):
                    cols = list(zip(*rows[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 7, 8) else pa.int64()) for k, c in enumerate(cols)], [x.split(" ")[0] for x in HUNK.split(", ")])

    return pairs.select("doc_id", "a", "b").mapInArrow(run, HUNK)


def sections(hunk_rows: DataFrame, headings: DataFrame) -> DataFrame:
    """The hunks with `section`, the last heading that begins at or before them; null above the first.

    headings: doc_id, at (its first word), title.  One pass over both in order.
    """
    own = F.struct(*(c for c in hunk_rows.columns if c != "doc_id"))
    # the hunks go along as they are: asked for twice, every pair would be compared twice
    both = hunk_rows.select("doc_id", F.col("a0").alias("at"), own.alias("h"), F.lit(None).cast("string").alias("title"))
    both = both.unionByName(headings.select("doc_id", "at", F.lit(None).cast(both.schema["h"].dataType).alias("h"), "title"))
    order = W.partitionBy("doc_id").orderBy("at", F.col("h").isNotNull().cast("int")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("section", F.last("title", ignorenulls=True).over(order)).where("h is not null").select("doc_id", "h.*", "section")


def markdown_headings(texts: DataFrame) -> DataFrame:
    """doc_id, at, title of the lines of a Markdown text (doc_id, text) that begin with one to six signs."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    words = F.size(F.filter(F.split("line", "\\s+"), lambda w: w != ""))
    order = W.partitionBy("doc_id").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(words).over(order), F.lit(0)).cast("long"))
    return rows.where(F.col("line").rlike("^#{1,6} ")).select("doc_id", "at", F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))
