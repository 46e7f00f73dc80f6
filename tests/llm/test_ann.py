import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import ann
from siftwell.llm.ann import nearest
from siftwell.llm.queries import QUERIES


def brute(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[: min(k, len(ids) - 1)]
        out[q] = [(int(ids[b]), float(s[b])) for b in best]
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32).astype(float)
    x[100:400] = x[7]  # one very common vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, score string")
    out = nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    want = brute(ids, x, range(0, 3000, 50), 5)
    assert out.groupby("query_id").size().eq(5).all() and out.query_id.nunique() == 60
    hit = 0
    for q, g in out.sort_values("rank").groupby("query_id"):
        assert g.score.tolist() == sorted(g.score, reverse=True)
        hit += len(set(g.vec_id) & {i for i, _ in want[q]})
        if 100 <= q < 400:
            assert g.vec_id.tolist() == [7, 100, 101, 102, 103] if q > 150 else True
    assert hit / 300 >= 0.9


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_on_the_table(spark, name):
    path = f"/root/testdata/{name}"
    e = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    out = QUERIES["op9_nearest_neighbours"](spark, path).toPandas()
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    hit = sum(len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in out.groupby("query_id"))
    assert hit >= 0.9 * 5 * len(want)
    score = {(q, i): s for q, rows in want.items() for i, s in rows}
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in out.itertuples() if (r.query_id, r.vec_id) in score)


def test_edges(spark):
    bad = [(0, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 2.0]), (5, [1.0]), (6, [])]
    good = [(50, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 1.0]), (7, [2.0, 0.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame(bad + good, "vec_id bigint, embedding array<double>")
    rows = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert rows == [(50, 1, 7, 1.0), (50, 2, 8, 0.0), (50, 3, 100, -1.0), (100, 1, 8, 0.0), (100, 2, 7, -1.0), (100, 3, 50, -1.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def units_of(spark, x):
    rows = [(i, bytearray((v / np.linalg.norm(v)).astype("<f4").tobytes())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "node bigint, v binary").repartition(4).cache()


def test_walks_end_only_when_all_nodes_are_expanded(spark):
    """A chain of 44 nodes along an arc: one end is 22 steps or more from the only entry."""
    n = 44
    at = np.linspace(0, 2.5, n)
    units = units_of(spark, np.stack((np.cos(at), np.sin(at)), axis=1))
    graph = spark.createDataFrame([(i, j, 0.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "node bigint, other bigint, sim float")
    ends = units.where(f"node in (0, {n - 1})").select(F.col("node").alias("query"), "v", F.lit(None).cast("bigint").alias("own"))
    found = {(r.query, r.node) for r in ann.graph_search(ends, graph, units, 2, 1 << 40).collect()}
    assert (0, 0) in found and (n - 1, n - 1) in found


def test_a_large_leaf_is_cut_by_projections(spark):
    """Nodes that reach one leaf of the sampled trees: near ones are not dealt apart at random, and parts are bounded."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16)))[rng.permutation(2000)]
    # so large an n makes the sample empty, and with it the trees: all nodes reach one leaf each time
    graph = ann.neighbour_graph(units_of(spark, x), 16, 1 << 40, 10).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    hit = sum(len(set(g.other) & set(np.argsort(-s[i])[:10])) for i, g in graph.groupby("node"))
    assert hit >= 0.8 * 20_000


def test_rounds_go_on_until_few_edges_change(spark):
    """Two trees of small leaves are a poor start, from which five rounds are too few."""
    rounds = []
    put = ann.C.materialize

    def counted(df, name, *rest):
        rounds.extend([name] * (name == "known"))
        return put(df, name, *rest)

    x = np.random.default_rng(8).normal(size=(1500, 12))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ann.C, "materialize", counted)
        m.setattr(ann, "LEAF", 8)
        m.setattr(ann, "TREES", 2)
        graph = ann.neighbour_graph(units_of(spark, x), 12, 1500, 10).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    hit = sum(len(set(g.other) & set(np.argsort(-s[i])[:10])) for i, g in graph.groupby("node"))
    assert len(rounds) > 5 and hit >= 0.9 * 15_000


def test_trees_and_walks_grow_with_the_nodes():
    assert [ann.tree_depth(n) for n in (0, 1, 128, 256, 51_282, 1 << 20, 1 << 24, 1 << 27)] == [0, 0, 0, 1, 9, 9, 10, 13]
    assert [ann.beam(n) for n in (0, 51_282, 200_000, 1 << 21)] == [320, 320, 632, 2048]
