"""Token counts from compiled finite-state transducers.

The split into pretokens is a transducer of ten states over classes of code points, with a bit for "a pretoken starts
here" and one for "it started one place before" on each transition.  A text is cut into chunks; each chunk gives a map
from the state before it to the state after it, for all chunks at once; the maps compose in a parallel prefix scan, and
then every chunk emits its bits from its known state.

The merges inside a pretoken are a second transducer, over bytes, compiled as it is needed: a state holds the longest
suffix that can still grow into a token, with the last token and the relative count at each place in it, and each
transition is annotated with the change of the number of tokens.  It restarts with every pretoken.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LIMIT = 512
CHUNK = 64
#: Pretokens and states that a worker remembers.
REMEMBERED, STATES = 500_000, 300_000

# ---------------------------------------------------------------- split into pretokens

BLANK, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E, END = range(12)
#: States: before anything, in letters, numbers, others, after a blank, after other white space, after a quote that
#: starts a pretoken, after 'r, 'v and 'l.
S0, SL, SN, SO, SB, SW, SQ, SR, SV, SLL = range(10)
HERE, BEFORE = 16, 32


def transitions() -> np.ndarray:
    """table[class * 16 + state]: next state, and the bits HERE and BEFORE."""
    table = np.zeros(12 * 16, np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    run = {LETTER: SL, STMD: SL, R: SL, V: SL, L: SL, E: SL, NUMBER: SN, OTHER: SO, QUOTE: SO}

    def plain(state: int, c: int) -> int:
        """A step without contractions in flight."""
        if c == END:
            return S0
        if c in (BLANK, WHITE):
            to = SB if c == BLANK else SW
            return to if state in (SB, SW) else to | HERE
        if state == SB:
            return run[c] | BEFORE
        if state == SW:
            return (SQ if c == QUOTE else run[c]) | BEFORE | HERE
        if run[c] == state:
            return state
        return (SQ if c == QUOTE else run[c]) | HERE

    for c in range(12):
        for state in range(10):
            if state in (S0, SL, SN, SO, SB, SW):
                out = plain(state, c)
            elif state == SQ:
                out = {STMD: S0, R: SR, V: SV, L: SLL}.get(c)
                out = plain(SO, c) if out is None else out
            elif (state, c) in ((SR, E), (SV, E), (SLL, L)):
                out = S0
            else:  # no contraction: the letter after the quote started a pretoken
                out = plain(SL, c)
                out |= BEFORE
            table[c * 16 + state] = out
    return table


TABLE = transitions()
_NEXT = TABLE & 15


#: The code points with the property White_Space, besides the blank.
WHITE_SPACE = (*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, letters and numbers as the library knows them: they join what stands before them."""
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.full(0x110000, OTHER, np.uint8)
    split = ByteLevel(add_prefix_space=False)
    # planes 4 to 13, 15 and 16 hold no letters
    asked = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000), np.arange(0xE0000, 0xE1000)])
    for c, before in ((LETTER, "a"), (NUMBER, "1")):
        for at in range(0, len(asked), 1 << 14):
            own = asked[at : at + (1 << 14)]
            text = "".join(f"\n{before}{chr(x)}" for x in own)
            starts = np.zeros(len(text) + 1, bool)
            starts[[s for _, (s, _) in split.pre_tokenize_str(text)]] = True
            out[own[~starts[2 : len(text) : 3]]] = c
    out[list(WHITE_SPACE)] = WHITE
    out[0x20], out[ord("'")] = BLANK, QUOTE
    for ch in "stmd":
        out[ord(ch)] = STMD
    out[ord("r")], out[ord("v")], out[ord("l")], out[ord("e")] = R, V, L, E
    return out


def starts_of(code: np.ndarray) -> np.ndarray:
    """Where pretokens start in a row of classes; END stands after each text."""
    n = len(code)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = code
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp) * 16
    # state maps of all chunks, from each of the ten states
    maps = np.repeat(np.arange(10, dtype=np.uint8)[:, None], chunks, 1)
    for step in steps:
        maps = _NEXT[step + maps]
    # parallel prefix scan: maps[:, i] becomes the map of chunks 0 to i
    width = 1
    while width < chunks:
        earlier = maps[:, :-width]
        maps[:, width:] = np.take_along_axis(maps[:, width:], earlier.astype(np.intp), 0)
        width *= 2
    state = np.concatenate([[S0], maps[S0, :-1]]).astype(np.uint8)
    bits = np.empty((CHUNK, chunks), np.uint8)
    for j, step in enumerate(steps):
        out = TABLE[step + state]
        bits[j] = out
        state = out & 15
    flat = np.ascontiguousarray(bits.T).reshape(-1)[: n + 1]
    at = (flat & HERE) > 0
    at[:-1] |= (flat[1:] & BEFORE) > 0
    return at[:n]


# ---------------------------------------------------------------- tokens of a pretoken


class Merger:
    """Counts the tokens of a byte-level BPE with a transducer that is compiled state by state."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        as_bytes = lambda s: bytes(back[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        self.vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:i] for t in self.vocab for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: suffix, then for each place in it, from before its first byte on: last token, count less the current count.
        first = (b"", ((None, 0),))
        self.states = [first]
        self.number = {first: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> list[bytes]:
        """Tokens by the merges themselves."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fit(self, a: bytes | None, b: bytes) -> bool:
        """Whether token b can follow token a: merging both together gives a and b again."""
        if a is None:
            return self.merge(b) == [b] if (a, b) not in self.fits else self.fits[a, b]
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = self.merge(a + b) == [a, b]
        return self.fits[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state with a byte: next state, and by how much the number of tokens changes."""
        suffix, past = self.states[state]
        grown = suffix + bytes([byte])
        for at in range(len(grown)):
            token = grown[at:]
            if past[at] is not None and token in self.vocab and self.fit(past[at][0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = past[at][1] + 1
        cut = next((i for i in range(len(grown)) if grown[i:] in self.prefixes), len(grown))
        # places from which no token can grow any more are forgotten, so that states fall together
        now = (*((past[i][0], past[i][1] - change) if i >= cut and grown[i:] in self.prefixes else None for i in range(len(grown))), (token, 0))
        key = (grown[cut:], now[cut:])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = (to, change)
        return to, change

    def count(self, pretoken: str) -> int:
        state = total = 0
        for byte in pretoken.encode():
            step = self.steps[state].get(byte)
            if step is None:
                step = self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def count_all(self, pretokens: list[str]) -> list[int]:
        known = self.counts
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.states) > STATES:
            self.reset()
        for t in set(pretokens).difference(known):
            known[t] = self.count(t)
        return list(map(known.__getitem__, pretokens))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


_mergers: dict[str, Merger] = {}


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of each text; special strings inside a text are one token each."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    merger = _mergers[path]
    extra = np.zeros(len(texts), np.int64)
    cut: list[str] = []
    of: list[int] = []
    for i, t in enumerate(texts):
        own = [t]
        for s in merger.special:
            if s in t:
                own = [y for x in own for y in x.split(s)]
        extra[i] = len(own) - 1
        cut += own
        of += [i] * len(own)
    size = np.array([len(t) for t in cut], np.int64)
    whole = "\n".join(cut) + "\n" if cut else ""
    code = classes()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum(size + 1) - 1
    code[ends] = END
    at = starts_of(code)
    starts = np.flatnonzero(at)
    stop = np.append(starts[1:], len(code))
    doc = np.searchsorted(ends, starts)
    stop = np.minimum(stop, ends[doc]) if len(starts) else stop
    n = merger.count_all([whole[a:b] for a, b in zip(starts.tolist(), stop.tolist())])
    total = np.bincount(doc, weights=n, minlength=len(cut)).astype(np.int64) if len(starts) else np.zeros(len(cut), np.int64)
    return extra + np.bincount(np.array(of, np.int64), weights=total, minlength=len(texts)).astype(np.int64) if cut else extra


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null and empty texts have no bytes and no tokens; repeated rows are counted alike; an empty table gives no rows.
    Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches, 1 << 20):
            own = data.tobytes()
            n = count_tokens([own[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], path)
            yield pa.RecordBatch.from_arrays([B.id_array(B.ids_of(batch)), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(B.tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
