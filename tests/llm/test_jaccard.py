import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.graph import components
from siftwell.llm.jaccard import Ranges, SignatureTree, jaccard_components, tree_join


def shingles(text, k):
    low = (text or "").translate({65 + i: 97 + i for i in range(26)})
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and (i == j or (a and b and 100 * len(a & b) >= percent * len(a | b))):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 30, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(12))) for i in range(40)]
    odd = [None, "", "a", "A", "a b", "a  B", " ", "x y z", "X y z", "long " * 3000, "long " * 2999 + "end"]
    return rows + [(2000 + i, t) for i, t in enumerate(odd)] + [(None, "a"), (5, "quite another text"), (5, rows[5][1])]


@pytest.mark.parametrize("k,percent,block", [(3, 90, 96), (3, 90, 5), (5, 80, 8)])
def test_against_brute_force(frame, k, percent, block):
    rows = corpus(k, 150)
    got = jaccard_components(frame(rows), shingle=k, percent=percent, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, k, percent)


def test_empty(frame):
    assert jaccard_components(frame([])).count() == 0
    assert [tuple(r) for r in jaccard_components(frame([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_ranges_hold_every_pair(percent):
    r = Ranges(percent, 3000)
    for x in range(1, 2000, 7):
        y = x * 100 // percent
        a, b = r.of(np.array([x, y]))
        assert b - a in (0, 1)
        assert (x + y) * (100 - percent) // (100 + percent) <= r.differ(np.array([a]))[0] < r.classes(np.array([a]))[0]


def test_tree_join_finds_every_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(30):
        s = rng.integers(0, 1 << 63, rng.integers(3, 60), dtype=np.uint64)
        for _ in range(3):
            t = s.copy()
            t[: rng.integers(0, 4)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            sets.append(np.unique(t))
    def tree(part):
        bits = []
        for x in part:
            b = np.zeros(256, bool)
            b[(x & np.uint64(255)).astype(int)] = True
            bits.append(np.packbits(b).tobytes())
        return SignatureTree(bits, [len(x) for x in part], 16)  # folded to half

    for num in (50, 80, 90):
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))}
        seen = set()
        one = tree(sets)
        tree_join(one, one, num, True, lambda i, j: seen.add((min(i, j), max(i, j))))
        assert want <= seen and len(seen) < 0.5 * len(sets) ** 2 / 2
        seen = set()
        tree_join(tree(sets[:40]), tree(sets[40:]), num, False, lambda i, j: seen.add((i, j + 40)))
        assert {(i, j) for i, j in want if i < 40 <= j} <= seen


def test_components(spark):
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
