"""Edit distances of many pairs of texts at a time, for tasks.

A column of the distance table is kept as two sets of bits, where it rises and where it falls (Myers), and the columns of
many pairs lie side by side in one long number, so a step of all pairs is a dozen operations on two numbers.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: about how many bits are side by side.
BITS = 1 << 17


def _codes(texts: list[str]) -> np.ndarray:
    """Code points plus one, a row a text; what is beyond a text is 0."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([[len(t)] for t in texts])
    # small numbers are compared faster
    out = np.zeros((len(texts), -8 * (-(int(lengths.max()) + 1) // 8)), np.min_scalar_type(int(flat.max(initial=0)) + 1))
    out[np.arange(out.shape[1]) < lengths] = flat + 1
    return out


def _side_by_side(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The distances of pairs whose first text is the longer one and not empty."""
    # a lane holds a pair's first text and a bit at least for what an addition carries
    a, b = _codes([a for a, _ in pairs]), _codes([b for _, b in pairs])
    (n, lane), ends = a.shape, np.array([len(b) for _, b in pairs])
    size = n * lane // 8
    number = lambda bits: int.from_bytes(np.packbits(bits.reshape(-1), bitorder="little").tobytes(), "little")
    bits_of = lambda x, at: np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8).reshape(n, lane // 8)[at], axis=1, bitorder="little")
    used = a > 0
    whole, first = number(used), number(np.arange(lane) < np.ones((n, 1)))
    rises, falls = whole, 0
    out = np.where(ends == 0, used.sum(axis=1), 0)
    stops = set(ends.tolist())
    for j in range(int(ends.max())):
        same = number(a == b[:, j : j + 1])
        low = same | falls
        flat = (((same & rises) + rises) ^ rises) | same
        up, down = (falls | (whole & ~(flat | rises))), rises & flat
        up, down = ((up << 1) | first) & whole, (down << 1) & whole
        rises, falls = down | (whole & ~(low | up)), up & low
        if j + 1 in stops:
            at = np.flatnonzero(ends == j + 1)
            out[at] = j + 1 + bits_of(rises, at).sum(axis=1, dtype=np.int64) - bits_of(falls, at).sum(axis=1, dtype=np.int64)
    return out


def distances(left: list[str | None], right: list[str | None]) -> list[int | None]:
    """The edit distance of each pair, in code points; null where a text is null."""
    out: list[int | None] = [None if a is None or b is None else 0 for a, b in zip(left, right)]
    todo = [(i, a, b) if len(a) >= len(b) else (i, b, a) for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None and a != b]
    todo.sort(key=lambda x: (len(x[1]), len(x[2])))
    at = 0
    while at < len(todo):
        end, n = at + 1, len(todo)
        while end < n and (end + 1 - at) * (len(todo[end][1]) + 8) <= BITS:
            end += 1
        part = todo[at:end]
        for (i, _, _), d in zip(part, _side_by_side([x[1:] for x in part]).tolist()):
            out[i] = d
        at = end
    return out
