"""Every overlap that the verifier's rule admits is reached by a seed: all patterns of replaced and cut-off words."""

from itertools import combinations

import numpy as np
import pytest

from quire.llm import decontam


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def leaked(item, texts):
    return {x[0] for x in decontam.Benchmark(np.array([7]), *arrays([item])).leaks(*arrays(texts))}


@pytest.mark.parametrize("n", range(1, decontam.STRETCH + 1))
def test_every_admitted_pattern_is_found(n):
    words = [f"w{i}" for i in range(n)]
    most = n - -(-decontam.EQUAL_PERCENT * n // 100)
    changed = lambda at: ["no" if i in at else x for i, x in enumerate(words)]
    patterns = [set(c) for k in range(most + 1) for c in combinations(range(n), k)]
    texts = [" ".join(["before", *changed(p), "after"]) for p in patterns]
    # the text begins or ends inside the item: words cut off count as unequal
    texts += [" ".join(words[a : n - b]) for a in range(most + 1) for b in range(most + 1 - a)]
    texts += [" ".join(changed({i})[a : n - 1 + a]) for a in (0, 1) for i in range(n) if most == 2]
    assert leaked(" ".join(words), texts) == set(range(len(texts)))
    too_many = [" ".join(changed(set(c))) for c in combinations(range(n), most + 1)]
    assert not leaked(" ".join(words), too_many)


def test_stretches_of_longer_items_are_found():
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(["no" if i in p else words[a + i] for i in range(13)]) for a in range(8) for p in map(set, combinations(range(13), 2))]
    assert leaked(" ".join(words), texts) == set(range(len(texts)))


def test_items_of_several_lengths_share_a_part():
    items = ["a b c d", "a b c d e", "f g h i j k", " ".join(f"w{i}" for i in range(15)), "a b", ""]
    got = decontam.Benchmark(np.arange(6), *arrays(items)).leaks(*arrays(["x a b c d y", "f g no i j k", "", "w1 w2 w3", " ".join(f"w{i}" for i in range(2, 15))]))
    assert {x[:2] for x in got} == {(0, 0), (0, 1), (0, 4), (1, 2), (4, 3)}
