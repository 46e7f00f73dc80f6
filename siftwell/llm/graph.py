"""Connected components of a graph of ids, by joins; no part of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """(a, b) pairs to (id, component): each id of an edge with the smallest id that it reaches.

    Every round gives each id the least of its parents, links its other parents to that one, and replaces
    parents by grandparents. Parents are smaller than their children, so this ends; tables are written each
    round, and joins meet hot parents only where Spark can split them.
    """
    pair = [F.greatest("a", "b").alias("x"), F.least("a", "b").alias("p")]
    e, done = C.materialize(edges.where("a <> b").select(*pair).distinct(), name), []
    while True:
        parents = C.materialize(e.groupBy("x").agg(F.min("p").alias("p")), name)
        other = e.select("x", "p").join(parents.withColumnRenamed("p", "m"), "x").where("p <> m").select(F.col("p").alias("x"), F.col("m").alias("p"), F.lit(True).alias("new"))
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        jumped = parents.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("new"))
        done += [e, parents]
        e = C.materialize(jumped.unionByName(other).groupBy("x", "p").agg(F.max("new").alias("new")), name)
        while done:
            C.drop(done.pop())
        if e.where("new").isEmpty():
            break
    tree = e.select(F.col("x").alias("id"), F.col("p").alias("component"))
    return tree.unionByName(tree.select(F.col("component").alias("id"), "component").distinct())
