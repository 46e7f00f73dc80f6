"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node. The first graph comes from random-projection trees, fitted on a sample that grows
with their depth; a task cuts what reaches a leaf further, at medians, and nodes of a part are compared with each
other. NN-descent then joins neighbours of neighbours: each node's neighbours, either way, meet with their (8-bit)
vectors, and pairs that beat a node's worst neighbour become edges, until a round changes few edges. A query walks
the graph from its nearest entry points, expanding its best unexpanded nodes by a join with the graph each step,
until its best nodes, a number that grows with the table, are all expanded. Scores are cosines of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

NEIGHBOURS = 28
REVERSE = 48
TREES = 8
LEAF = 128
CHANGED = 0.01  # rounds end when no larger share of the edges is new
BEAM = 320  # or more, see beam()
EXPAND = 32
DEPTH = 9  # of the sampled trees, until their leaves hold more than TASK nodes
TASK = 16384
TREE_SAMPLE = 16  # a leaf of the sampled trees
ENTRIES = 256  # or the square root of the nodes
BATCH = 400
_F4 = "<f4"


def _matrix(col, dim: int, dtype=_F4) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), dtype).reshape(-1, dim)


def _unit(batches):
    for b in batches:
        rows = [np.asarray(x, np.float64) for x in b.column(1).to_pylist()]
        yield pa.record_batch({"node": b.column(0), "v": pa.array([(r / np.linalg.norm(r)).astype(_F4).tobytes() for r in rows], pa.binary())})


def _grow(sample: np.ndarray, depth: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """A random-projection tree: for each level, the directions and median thresholds of its nodes."""
    of, levels = np.zeros(len(sample), np.int64), []
    for d in range(depth):
        way = rng.normal(size=(1 << d, sample.shape[1])).astype(np.float32)
        cut = np.zeros(1 << d, np.float32)
        for j in range(1 << d):
            mine = np.flatnonzero(of == j)
            if len(mine) > 1:  # the direction between two members separates clusters better than a random one
                a, b = sample[rng.choice(mine, 2, replace=False)]
                if np.abs(a - b).max() > 1e-6:
                    way[j] = a - b
            cut[j] = np.median(sample[mine] @ way[j]) if len(mine) else 0.0
        of = 2 * of + (np.einsum("ij,ij->i", sample, way[of]) > cut[of])
        levels.append((way, cut))
    return levels


def _leaves(trees, dim: int):
    def leaves(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            for t, levels in enumerate(trees):
                of = np.zeros(len(x), np.int64)
                for way, cut in levels:
                    of = 2 * of + (np.einsum("ij,ij->i", x, way[of]) > cut[of])
                yield pa.record_batch({"leaf": pa.array((np.int64(t) << 50) + of), "node": b.column(0), "v": b.column(1)})

    return leaves


def _parts(x: np.ndarray, most: int, rng) -> list[np.ndarray]:
    """The rows of x in parts of at most `most`: halves at the median of a random projection, as often as needed."""
    todo, out = [np.arange(len(x))], []
    while todo:
        mine = todo.pop()
        if len(mine) <= most:
            out.append(mine)
            continue
        a, b = x[rng.choice(mine, 2, replace=False)]
        order = np.argsort(x[mine] @ (a - b), kind="stable")
        todo += [mine[order[: len(mine) // 2]], mine[order[len(mine) // 2 :]]]
    return out


def _within(dim: int, k: int):
    """The k nearest of each node among the nodes of its part of a leaf."""

    def within(key, table):
        order = np.argsort(table.column("node").to_numpy())
        node, x = table.column("node").to_numpy()[order], _matrix(table.column("v"), dim)[order]
        out = []
        for rows in _parts(x, 4 * LEAF, np.random.default_rng(key[0].as_py())):
            s = x[rows] @ x[rows].T
            np.fill_diagonal(s, -9)
            m = min(k, len(rows) - 1)
            if m > 0:
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append((np.repeat(node[rows], m), node[rows][best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"node": pa.array(a), "other": pa.array(b), "sim": pa.array(s.astype(np.float32))})

    return within


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node; Spark keeps the k best of each task before it moves rows."""
    edges = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def _introduce(dim: int):
    """Pairs of one node's neighbours that beat the worst neighbour of either."""

    def introduce(key, table):
        at, node = table.column("at").to_numpy(), table.column("node").to_numpy()
        worst, q = table.column("worst").to_numpy(), _matrix(table.column("q"), dim, np.int8)
        order = np.argsort(at, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            x = q[rows].astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            s = x @ x.T
            np.fill_diagonal(s, -9)
            i, j = np.nonzero(s > worst[rows][:, None])
            out.append((node[rows[i]], node[rows[j]], s[i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((b, a))
        new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) if len(a) else np.zeros(0, bool)
        keep = order[new]
        return pa.table({"node": pa.array(a[keep]), "other": pa.array(b[keep]), "sim": pa.array(s[keep].astype(np.float32))})

    return introduce


def _quantised(dim: int):
    def quantise(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            q = np.round(127 * x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12)).astype(np.int8)
            yield pa.record_batch({"node": b.column(0), "q": pa.array([r.tobytes() for r in q], pa.binary())})

    return quantise


def tree_depth(n: int) -> int:
    """Levels of the sampled trees for n nodes: leaves of LEAF nodes, or else of TASK nodes at most."""
    return max(0, min(math.ceil(math.log2(max(n, 1) / LEAF)), max(DEPTH, math.ceil(math.log2(max(n, 1) / TASK)))))


def neighbour_graph(units: DataFrame, dim: int, n: int, neighbours: int = NEIGHBOURS, changed: float = CHANGED, seed: int = 7) -> DataFrame:
    """(node, v) with unit vectors of n nodes to (node, other, sim), `neighbours` edges a node."""
    spark, rng = units.sparkSession, np.random.default_rng(seed)
    depth = tree_depth(n)
    share = min(1.0, (TREE_SAMPLE << max(depth, DEPTH)) / max(n, 1))
    sample = units.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()
    sample = np.frombuffer(b"".join(sorted(bytes(r[0]) for r in sample)), _F4).reshape(-1, dim)
    trees = [_grow(sample, depth, rng) if len(sample) else [] for _ in range(TREES)]
    leaf = units.mapInArrow(_leaves(trees, dim), "leaf bigint, node bigint, v binary")
    first = leaf.groupBy("leaf").applyInArrow(_within(dim, neighbours), "node bigint, other bigint, sim float")
    graph = C.materialize(_best(first.withColumn("new", F.lit(1)), neighbours), "graph")
    q = C.materialize(units.mapInArrow(_quantised(dim), "node bigint, q binary"), "quantised")
    batches = max(C.shuffle_partitions(spark), n // BATCH + 1)
    while graph.where("new = 1").count() > changed * n * neighbours:
        old, graph = graph, graph.drop("new")
        both = graph.select(F.col("node").alias("at"), F.col("other").alias("node"), "sim").unionByName(graph.select(F.col("other").alias("at"), "node", "sim"))
        w = Window.partitionBy("at").orderBy(F.desc("sim"), "node")
        near = both.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= REVERSE).drop("rank", "sim")
        worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= neighbours, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        known = C.materialize(q.join(worst, "node", "left").select("node", "q", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst")), "known")
        meet = near.join(known, "node").withColumn("batch", F.pmod(F.xxhash64("at"), F.lit(batches)))
        found = meet.groupBy("batch").applyInArrow(_introduce(dim), "node bigint, other bigint, sim float")
        graph = C.materialize(_best(graph.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1))), neighbours), "graph")
        C.drop(old)
        C.drop(known)
    return graph.drop("new")


def _start(entries: np.ndarray, ids: np.ndarray, dim: int):
    def start(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            s = x @ entries.T
            rows = []
            for own, sims in zip(b.column(2).to_pylist(), s):
                best = np.argsort(-sims, kind="stable")[:EXPAND]
                best = best[ids[best] != own] if own is not None else best
                mine = [own] if own is not None else []
                rows.append((np.concatenate((np.array(mine, np.int64), ids[best])), np.concatenate((np.ones(len(mine)), sims[best])).astype(_F4)))
            yield pa.record_batch({
                "query": b.column(0), "qv": b.column(1), "ids": pa.array([i.tobytes() for i, _ in rows], pa.binary()), "sims": pa.array([t.tobytes() for _, t in rows], pa.binary()),
                "done": pa.array([b""] * len(x), pa.binary()), "todo": pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int64())),
            })

    return start


_STATE = "query bigint, qv binary, ids binary, sims binary, done binary, todo array<bigint>"


def beam(n: int) -> int:
    """Nodes that a walk holds: with a fixed number, recall falls as the table grows."""
    return max(BEAM, math.isqrt(2 * n))


def _step(dim: int, most: int):
    """Adds scored nodes to each query's list and names the best that are not expanded yet."""

    def step(key, state, found):
        where = found.column("of").to_numpy()
        node, v = found.column("node").to_numpy(), _matrix(found.column("v"), dim)
        order = np.argsort(where, kind="stable")
        lo = np.searchsorted(where[order], state.column("query").to_numpy())
        hi = np.searchsorted(where[order], state.column("query").to_numpy(), "right")
        cols = {c: [] for c in ("ids", "sims", "done", "todo")}
        for k, (qv, ids, sims, done, todo) in enumerate(zip(*(state.column(c).to_pylist() for c in ("qv", "ids", "sims", "done", "todo")))):
            ids, sims = np.frombuffer(ids, np.int64), np.frombuffer(sims, _F4)
            done = np.concatenate((np.frombuffer(done, np.int64), np.array(todo, np.int64)))
            rows = order[lo[k] : hi[k]]
            rows = rows[~np.isin(node[rows], ids)]
            ids = np.concatenate((ids, node[rows]))
            sims = np.concatenate((sims, v[rows] @ np.frombuffer(qv, _F4)))
            ids, at = np.unique(ids, return_index=True)
            best = np.lexsort((ids, -sims[at]))[:most]
            ids, sims = ids[best], sims[at][best]
            cols["ids"].append(ids.tobytes())
            cols["sims"].append(sims.astype(_F4).tobytes())
            cols["done"].append(done.tobytes())  # each step expands a node that is new here, so walks end
            cols["todo"].append(ids[~np.isin(ids, done)][:EXPAND].tolist())
        kind = {"todo": pa.list_(pa.int64())}
        return pa.table({"query": state.column("query"), "qv": state.column("qv"), **{c: pa.array(x, kind.get(c, pa.binary())) for c, x in cols.items()}})

    return step


def _found(batches):
    for b in batches:
        ids = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
        n = [len(x) for x in ids]
        yield pa.record_batch({"query": pa.array(np.repeat(b.column(0).to_numpy(), n)), "node": pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))})


def graph_search(queries: DataFrame, graph: DataFrame, units: DataFrame, dim: int, n: int) -> DataFrame:
    """(query, v, own) to (query, node): the nodes in each query's final beam.

    own is the node with the query's vector, null if there is none; walks start there and at the entries.
    """
    spark = units.sparkSession
    some = units.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, max(ENTRIES, math.isqrt(n)) / max(n, 1)) * (1 << 30))).collect()
    if not some:
        some = units.limit(1).collect()
    ids = np.array([r[0] for r in some], np.int64)
    entries = np.frombuffer(b"".join(bytes(r[1]) for r in some), _F4).reshape(-1, dim)
    links = C.materialize(graph.groupBy("node").agg(F.collect_list("other").alias("others")), "adjacency")
    state = C.materialize(queries.mapInArrow(_start(entries, ids, dim), _STATE), "search")
    batches = max(C.shuffle_partitions(spark), int(state.count()) // BATCH + 1)
    batch = F.pmod(F.xxhash64("query"), F.lit(batches)).alias("batch")
    while not state.where(F.size("todo") > 0).isEmpty():
        ahead = state.select("query", F.explode("todo").alias("node"))
        next_to = ahead.join(links, "node").select("query", F.explode("others").alias("node")).distinct()
        scored = next_to.join(units, "node").select("query", "node", "v", batch).toDF("of", "node", "v", "batch")
        moved = state.withColumn("batch", batch).groupBy("batch").cogroup(scored.groupBy("batch")).applyInArrow(_step(dim, beam(n)), _STATE)
        state, old = C.materialize(moved, "search"), state
        C.drop(old)
    return state.select("query", "ids").mapInArrow(_found, "query bigint, node bigint")


def _cosines(batches):
    for b in batches:
        score = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.asarray(x.as_py(), np.float64), np.asarray(y.as_py(), np.float64)
            score.append(float(np.clip(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)), -1.0, 1.0)))
        yield pa.record_batch({"query": b.column(0), "node": b.column(1), "score": pa.array(score, pa.float64())})


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of vectors that take part: an id, and finite components that are not all zero."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(x, lambda c: c != 0)
    fine = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False))
    return df.where(fine).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.alias("x"))


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """For each row of df that is_query (a Column) marks, its k nearest other rows: query_id, rank, id_col, score.

    Ranks go by cosine, ties to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows with a null id or of another length than most. Equal vectors are
    found together: each node knows its k + 1 smallest ids. Of rows that repeat an id
    the one with the least vector (compared component by component) counts. Fewer rows than
    k give fewer ranks; an empty table gives none.
    """
    C.small_batches(df.sparkSession)
    rows = C.materialize(usable(df, id_col, vec_col).groupBy("id").agg(F.min("x").alias("x")), "vectors")
    by_length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id bigint, rank int, id bigint, score double"
    if by_length is None:
        return df.sparkSession.createDataFrame([], empty).withColumnRenamed("id", id_col)
    dim = int(by_length[0])
    rows = rows.where(F.size("x") == dim)
    w = Window.partitionBy("x").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    nodes = C.materialize(few.groupBy("x").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members")), "nodes")
    n = nodes.count()
    units = C.materialize(nodes.select("node", "x").mapInArrow(_unit, "node bigint, v binary"), "units")
    asked = df.where(is_query).select(F.col(f"`{id_col}`").cast("bigint").alias("query")).distinct()
    asked = C.materialize(rows.join(asked, rows.id == asked.query).select("query", "x"), "queries")
    graph = neighbour_graph(units, dim, n)
    vectors = asked.select(F.col("query").alias("node"), "x").mapInArrow(_unit, "node bigint, v binary").withColumnRenamed("node", "query")
    owns = asked.join(nodes.select("x", "node"), "x", "left").select("query", F.col("node").alias("own"))
    starts = vectors.join(owns, "query")
    found = graph_search(starts, graph, units, dim, n)
    pairs = found.join(nodes.select("node", "x"), "node").join(asked.withColumnRenamed("x", "qx"), "query")
    scored = C.materialize(pairs.select("query", "node", "qx", "x").mapInArrow(_cosines, "query bigint, node bigint, score double"), "scores")
    each = scored.join(nodes.select("node", "members"), "node").select("query", "score", F.explode("members").alias("id")).where("id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
