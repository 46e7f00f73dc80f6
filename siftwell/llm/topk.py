"""Exact top-k by integer inner product: columnar branch and bound.

A cell adds up scores one block of components at a time, from vertical blocks, the components that carry most of the
queries' mass first. What is left of a pair can add at most the product of the norms of the components left of either
vector; pairs that cannot reach their query's k-th score so far are given up. Once few pairs survive they are
compacted to a list, and later components are read for those alone. All bounds are rounded up, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .blocks import STEP, Grid, first_of_each, fits, quantised, scores, unpacked

DIMS = 8  # components that are added at once
COMPACT = 0.25  # pairs become a list once no larger share of them is alive
_LEAST = -(1 << 63)
_OUT = "q_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def _rest(x: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Norms, rounded up, of what is left of each vector before and after each of the parts."""
    mass = np.array([(x[p] ** 2).sum(axis=0) for p in parts]).reshape(len(parts), x.shape[1])
    left = np.append(np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, x.shape[1])), axis=0)
    return np.sqrt(left) * (1 + 1e-12)


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray, skip: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of pairs that can be among a query's k best: each query's best that reach `least`.

    q, x: a column a vector; least: a score a query that its k-th best is known to reach; skip: pairs to leave out.
    """
    if not fits(q, x):
        s = scores(q, x)
        i, j = np.nonzero(~skip & (s >= least[:, None]))
        return i, j, s[i, j]
    q, x, bar = q.astype(np.float64), x.astype(np.float64), least.astype(np.float64)
    by_mass = np.argsort(-(q**2).sum(axis=1), kind="stable")
    parts = np.split(by_mass, range(DIMS, len(q), DIMS))
    q_left, x_left = _rest(q, parts), _rest(x, parts)
    s = np.where(skip, -np.inf, 0.0)
    i = j = None
    for n, p in enumerate(parts, start=1):
        if i is None:
            s += q[p].T @ x[p]
            if n == len(parts):
                break
            alive = s + (q_left[n][:, None] * x_left[n] + 1) >= bar[:, None]
            if np.count_nonzero(alive) <= COMPACT * alive.size:
                i, j = np.nonzero(alive)
                s = s[i, j]
        else:
            s += np.einsum("dp,dp->p", q[p][:, i], x[p][:, j])
            keep = s + (q_left[n][i] * x_left[n][j] + 1 if n < len(parts) else 0) >= bar[i]
            i, j, s = i[keep], j[keep], s[keep]
    if i is None:  # nearly all pairs lived: the k best of each query, at equal scores those that come first in the block
        if s.shape[1] > k:
            cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            ties = s == cut
            alive = ((s > cut) | (ties & (np.cumsum(ties, axis=1) <= k))) & (s >= bar[:, None])
        else:
            alive = s >= bar[:, None]
        i, j = np.nonzero(alive & ~skip)
        s = s[i, j]
    return i, j, s.astype(np.int64)


def _cell(k: int):
    def cell(key, blocks, asked):
        out = []
        if blocks.num_rows and asked.num_rows:
            q = unpacked(asked)
            for lo in range(0, len(q.ids), STEP):
                part = slice(lo, lo + STEP)
                n = len(q.ids[part])
                best = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, id, row
                least = np.full(n, _LEAST)
                for at in range(blocks.num_rows):
                    b = unpacked(blocks, at)
                    i, j, s = survivors(q.x[:, part], b.x, least, q.rows[part][:, None] == b.rows, k)
                    best = [np.concatenate(c) for c in zip(best, (i, s, b.ids[j], b.rows[j]))]
                    keep = first_of_each(best[0], np.lexsort((best[3], best[2], ~best[1], best[0])), k)
                    best = [c[keep] for c in best]
                    full = np.bincount(best[0], minlength=n) == k
                    last = np.full(n, _LEAST)
                    last[best[0]] = best[1]  # rows come in order, so each query's last one stands
                    least = np.where(full, last, _LEAST)
                out.append((q.rows[part][best[0]], q.ids[part][best[0]], best[3], best[2], best[1]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("q_row", "query_id", "row", "vec_id", "score"), cols)))

    return cell


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each row that `queries` marks.

    A component x counts as floor(scale * x); the score is the inner product; ties go to the smaller id. Every row but
    the query's own is a candidate. Rows without an id or vector, or with a component that is null, NaN or infinite, take
    no part; a zero vector does. Vectors meet only vectors of their length. Rows of one id are rows like others: each is a
    candidate, and each that is a query has ranks of its own. Scores beyond a long are clamped. An empty table gives
    no rows; columns of other names are not read.
    """
    grid = Grid(quantised(df, queries, id_col, vector_col, scale=scale), "topk")
    found = C.materialize(grid.meet(_cell(k), _OUT), "topk-found")
    grid.drop()
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
