"""Answer a table of queries from an index that refresh_index keeps: the best chunks of each language for each query.

    python -m jobs.batch_search QUERIES INDEX OUT [--config FILE]

QUERIES is Parquet of (item_id, text). OUT gets (item_id, rank, chunk_id, doc_id, start_line, end_line, score, matched) in a
folder for each language; matched is how many of the query's terms the chunk has. Statistics are those of the whole
index. With `languages` set, the folders of those languages alone are written anew and others stay as they are;
otherwise all of OUT is. Running it again on the same index gives the same rows.
"""

from __future__ import annotations

import dataclasses
import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import command, refresh_index
from siftwell.functions import text as X
from siftwell.operators import index as ix
from siftwell.operators import search as se

LOG = logging.getLogger("batch_search")
RESULTS = "item_id bigint, rank int, chunk_id string, doc_id bigint, start_line int, end_line int, score double, matched bigint, lang string"


@dataclasses.dataclass(frozen=True)
class Settings:
    top_k: int = 10
    languages: tuple[str, ...] | list[str] = ()  # none: all


def asked_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, times): a term counts as often as the query has it; queries without id or text ask nothing."""
    terms = queries.where("item_id is not null and text is not null").select("item_id", F.explode(X.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def vocabulary(post: DataFrame) -> DataFrame:
    """(term, df, n): how many chunks have a term, and how often."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def answers(chunks: DataFrame, stats: DataFrame, mean_dl: float, asked: DataFrame, top_k: int, languages: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """RESULTS: the top_k chunks of positive score for each query and language; ties go to the smaller chunk id."""
    where = chunks.where(F.col("lang").isin(*languages)) if languages else chunks
    if where.where("dl is null").isEmpty():
        counted = where
    else:  # an earlier version wrote some of them
        counted = ix.with_terms(where.select("chunk_id", "lang", "text", "filepath", "symbol"))
    top = se.top_counted(counted, stats, asked, mean_dl, top_k, by="lang")
    top = top.join(where.select("chunk_id", "doc_id", "start_line", "end_line"), "chunk_id")
    return top.select("item_id", "rank", "chunk_id", "doc_id", "start_line", "end_line", "score", "matched", "lang")


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(out)


def run(spark: SparkSession, queries: str, index: str, out: str, settings: Settings = Settings()) -> None:
    """Write the answers to all queries; an index without chunks, or no queries, give an empty table."""
    asked = asked_terms(spark.read.schema("item_id bigint, text string").parquet(queries))
    post, chunks = refresh_index.postings(spark, index), refresh_index.chunks(spark, index)
    n = chunks.count()  # each has postings: those of its path
    words = vocabulary(post).persist(StorageLevel.DISK_ONLY)  # all postings are counted once
    total, mean = words.agg(F.sum("n"), F.avg(ix.raw_idf(n))).first()
    stats = ix.with_idf(words.join(asked.select("term").distinct(), "term", "left_semi"), n, F.lit(mean).cast("double")).persist(StorageLevel.DISK_ONLY)
    mode = "dynamic" if settings.languages else "static"
    try:
        found = answers(chunks, stats, total / n if n else 0.0, asked, settings.top_k, settings.languages)
        found.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("lang").parquet(out)
    finally:
        stats.unpersist()
        words.unpersist()
    told = results(spark, out).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item_id").alias("items")).collect()
    LOG.info("read queries from %s and the index in %s", queries, index)
    for r in sorted(told):
        LOG.info("%s/lang=%s holds %d rows for %d queries", out, r["lang"], r["rows"], r["items"])


if __name__ == "__main__":
    command.main("batch_search", __doc__, Settings, run, {"queries": "Parquet of (item_id, text)", "index": "folder that refresh_index writes", "out": "folder of the results"})
