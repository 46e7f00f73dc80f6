"""Files that arrive in a folder, chunked as a stream; deletions need Engine.reindex, for file streams do not see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, EngineConfig
from ..operators import chunk as ck
from ..sources import files as fs


def arriving(spark: SparkSession, root: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """New files of a tree as a stream of (filepath, content, sha, mtime)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), {len(base) + 1})")
    rows = raw.where(F.col("length") <= config.max_file_bytes).withColumn("filepath", path)
    rows = rows.where(fs.is_supported(F.col("filepath")) & ~fs.is_excluded(F.col("filepath")) & ~fs.in_git(F.col("filepath")))
    return rows.select("filepath", fs.decode("content").alias("content"), F.sha1("content").alias("sha"), F.col("modificationTime").alias("mtime"))


def chunk_stream(spark: SparkSession, root: str, out: str, checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Chunk what has arrived since the last run and append it to `out`, then stop; batches replay whole after a loss."""

    def write(batch: DataFrame, number: int) -> None:
        ck.chunk_files(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, root, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
