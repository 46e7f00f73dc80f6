"""Quality of rankings against relevant items: recall, reciprocal rank, precision, nDCG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, gold: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """A row for each query with a relevant item: relevant, found, rr, precision, ndcg over ranks 1 to k."""
    hit = gold.join(ranked.where(F.col("rank") <= k).select(query, item, "rank"), [query, item], "left")
    rows = hit.groupBy(query).agg(
        F.count(F.lit(1)).alias("relevant"), F.count("rank").alias("found"), F.coalesce(F.max(F.lit(1.0) / F.col("rank")), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return rows.select(query, "relevant", "found", "rr", (F.col("found") / k).alias("precision"), (F.col("dcg") / best).alias("ndcg"))


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, query: str, item: str, k: int) -> DataFrame:
    rows = per_query(ranked, gold, query, item, k)
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("found") / F.col("relevant")), 6).alias(f"recall_at_{k}"), F.round(F.avg("rr"), 6).alias("mrr"))
