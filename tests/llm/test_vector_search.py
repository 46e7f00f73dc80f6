"""Exact top-k and hard negatives against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import blocks, hard_negatives as hn, topk
from siftwell.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA, same

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, score string, g int"


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def inner(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))


def brute_topk(rows, k=5):
    live = [(n, i, floors(v)) for n, (i, v, _) in enumerate(rows) if i is not None and takes_part(v)]
    out = []
    for n, i, v in live:
        if i % 50 == 0:
            best = sorted((-inner(v, w), j) for m, j, w in live if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows):
    live = [(n, i, floors(v), x) for n, (i, v, x) in enumerate(rows) if i is not None and x is not None and takes_part(v)]
    out = []
    for n, i, v, x in live:
        if i % 50 == 0:
            others = sorted((-inner(v, w), j, y) for m, j, w, y in live if m != n and len(w) == len(v))
            for ps, p, _ in [o for o in others if o[2] == x][:5]:
                fine = [(-s, j) for s, j, y in others if y != x and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
                out += [(i, p, r, j, -ps, s) for r, (s, j) in enumerate(fine, 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, x, 1, "s", 2) for i, v, x in rows], SCHEMA).repartition(parts)


def drawn(seed, n=700, dim=12, hot=0.3):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)).astype(np.float32)
    vectors[rng.random(n) < hot] = vectors[0]  # one vector in a third of all rows: ties beyond k
    return [(int(i), v.tolist(), int(x)) for i, v, x in zip(rng.permutation(n) * 5, vectors, rng.integers(0, 4, n))]


@pytest.fixture
def small_cells(monkeypatch):
    """Several blocks, piles and groups, although tables are small."""
    for name, value in (("BLOCK", 64), ("GROUP", 20), ("PILE", 2)):
        monkeypatch.setattr(blocks, name, value)


def found_topk(df, **more):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **more).collect())


def found_negatives(df):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_topk"])
def test_query(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, small_cells, seed):
    rows = drawn(seed)
    assert found_topk(frame(spark, rows)) == brute_topk(rows)
    assert found_negatives(frame(spark, rows)) == brute_negatives(rows)


def test_odd_rows(spark):
    rows = drawn(3, 60)
    rows += [(0, None, 1), (50, [], 1), (100, [1.0, None] * 6, 1), (150, [float("nan")] * 12, 1), (200, [float("inf")] * 12, 1), (None, rows[0][1], 1)]
    rows += [(250, [0.0] * 12, None), (250, rows[1][1], 2), (250, rows[1][1], 2), (300, [1.0, 2.0], 1), (7, [2.0, 2.0], 2), (9, [1.0, 1.0], 2), (11, [2.0, 3.0], 1)]
    assert found_topk(frame(spark, rows)) == brute_topk(rows)
    assert found_negatives(frame(spark, rows)) == brute_negatives(rows)


def test_values_beyond_a_long(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [-3e38, 2.0], 2), (3, [1e10, 1.0], 1), (4, [1e9, 5.0], 2), (50, [1e12, -7.0], 1), (51, [1.0, 1.0], 2)]
    top = (1 << 63) - 1
    clamped = lambda v: [max(-top - 1, min(top, math.floor(256 * float(np.float32(x))))) for x in v]
    best = {i: sorted((-inner(clamped(v), clamped(w)), j) for j, w, _ in rows if j != i)[:5] for i, v, _ in rows if i % 50 == 0}
    assert found_topk(frame(spark, rows)) == sorted((i, r, j, -s) for i, b in best.items() for r, (s, j) in enumerate(b, 1))
    assert found_negatives(frame(spark, rows)) is not None


def test_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(5, [1.0], 1), (6, [2.0], 2)]):
        assert found_topk(frame(spark, rows)) == brute_topk(rows)
        assert found_negatives(frame(spark, rows)) == brute_negatives(rows) == []


def test_pairs_are_given_up_early():
    """Clustered vectors leave few pairs alive, and what is left is right."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(64, 3000)) * np.linspace(300, 1, 64)[:, None]).astype(np.int64)
    q = x[:, :40]
    s = q.T @ x
    least = np.sort(s, axis=1)[:, -5]
    i, j, got = topk.survivors(q, x, least, np.zeros(s.shape, bool), 5)
    assert sorted(zip(i, j, got)) == sorted((a, b, s[a, b]) for a, b in zip(*np.nonzero(s >= least[:, None])))
