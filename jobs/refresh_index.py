"""Keep a lexical index of a growing feed of documents up to date, reading only files that are new.

    python -m jobs.refresh_index DOCUMENTS INDEX CHECKPOINT [--config FILE]

DOCUMENTS is a folder to which Parquet files of (doc_id, text, lang, source) are added, or one such file. A row whose path and text the
index has already is passed over; other text replaces the document; a null text takes it out. INDEX gets, for each
batch of the stream, a delta that is never changed afterwards:

    manifest/batch=N          doc_id, sha (null: taken out), status
    chunks/batch=N/lang=L     line-addressed pieces within the token budget, each with its terms, counted
    postings/batch=N/bucket=B (term, chunk_id, tf)

What a run writes is in proportion to what is new. Readers merge: of each document the last delta stands. The manifest
is written last, and deltas that it does not name are not seen; a batch that was lost is run again under its number
and overwrites what it had left, so that reruns give the same index.
"""

from __future__ import annotations

import dataclasses
import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import command
from siftwell.config import DEFAULT
from siftwell.functions import text as X
from siftwell.operators import chunk as ck
from siftwell.operators import index as ix

LOG = logging.getLogger("refresh_index")
DOCUMENTS = "doc_id bigint, text string, lang string, source string"
MANIFEST = "doc_id bigint, sha string, status string, batch bigint"
CHUNKS = "doc_id bigint, chunk_id string, filepath string, symbol string, part int, parts int, start_line int, end_line int, text string, dl bigint, entries array<struct<term:string,tf:int>>, batch bigint, lang string"
POSTINGS = "term string, chunk_id string, tf int, batch bigint, bucket int"


@dataclasses.dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 440  # budget of a chunk
    files_per_batch: int = 256  # of new files; bounds what one batch of the stream holds


def _table(spark: SparkSession, index: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{index}/{name}")


def manifest(spark: SparkSession, index: str) -> DataFrame:
    """(doc_id, sha, status, batch): the last word on each document, those that were taken out included."""
    last = F.max_by(F.struct("sha", "status", "batch"), "batch").alias("last")
    return _table(spark, index, "manifest", MANIFEST).groupBy("doc_id").agg(last).select("doc_id", "last.*")


def _standing(spark: SparkSession, index: str, name: str, schema: str, dead: DataFrame, n: int) -> DataFrame:
    """Rows of the batches that the manifest names, less those of `dead` (n rows): no join if there are none, and no shuffle of the table if there are few."""
    named = [r[0] for r in _table(spark, index, "manifest", MANIFEST).select("batch").distinct().collect()]
    rows = _table(spark, index, name, schema).where(F.col("batch").isin(*named))
    return rows.join(F.broadcast(dead) if n <= DEFAULT.broadcast_rows else dead, dead.columns, "left_anti") if n else rows


def _replaced(spark: SparkSession, index: str) -> DataFrame:
    """(doc_id, batch) of what a later batch replaced or took out."""
    last = manifest(spark, index).select("doc_id", F.col("batch").alias("last"))
    return _table(spark, index, "manifest", MANIFEST).join(last, "doc_id").where("batch < last").select("doc_id", "batch")


def chunks(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of documents as they stand; dl and entries are null in those that earlier versions of this job wrote."""
    dead = _replaced(spark, index)
    return _standing(spark, index, "chunks", CHUNKS, dead, dead.count())


def postings(spark: SparkSession, index: str) -> DataFrame:
    """The postings of the chunks that stand."""
    dead = _table(spark, index, "chunks", CHUNKS).join(_replaced(spark, index), ["doc_id", "batch"], "left_semi").select("chunk_id", "batch")
    return _standing(spark, index, "postings", POSTINGS, dead, dead.count())


def newest(rows: DataFrame) -> DataFrame:
    """(doc_id, filepath, lang, text, sha), one row a document: that of the file written last, then of greatest path and digest.

    Ids are counted first: rows of an id that is there once stand as they are, and only the others are sorted.
    """
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = rows.where("doc_id is not null").withColumn("lang", F.coalesce("lang", F.lit("none"))).withColumn("filepath", path)
    rows = rows.withColumn("sha", F.sha1(F.concat("filepath", F.lit("\n"), "text")))
    often = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = often.count()
    if not n:
        return rows.select("doc_id", "filepath", "lang", "text", "sha")
    often = F.broadcast(often) if n <= DEFAULT.broadcast_rows else often
    order = Window.partitionBy("doc_id").orderBy(F.desc("written"), F.desc("path"), F.desc_nulls_last("sha"))
    first = rows.join(often, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")
    return rows.join(often, "doc_id", "left_anti").unionByName(first).select("doc_id", "filepath", "lang", "text", "sha")


def changes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of newest(), the documents that the index does not have as they are, with status new, changed or removed."""
    was = known.select("doc_id", F.col("sha").alias("was"))
    if (n := was.count()) <= DEFAULT.broadcast_rows:  # none in a first batch; texts are then not shuffled
        was = F.broadcast(was) if n else was.limit(0)
    status = F.when(F.col("sha").isNull(), "removed").when(F.col("was").isNull(), "new").otherwise("changed")
    return rows.join(was, "doc_id", "left").where(~F.col("sha").eqNullSafe(F.col("was"))).withColumn("status", status).drop("was")


def cut(documents: DataFrame, budget: int) -> DataFrame:
    """Chunks of documents: a document is one span, cut where it exceeds the token budget; blank ones give none."""
    config = dataclasses.replace(DEFAULT, chunk_tokens=budget)
    words = documents.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    literal = {"language": "other", "doc_category": "documentation", "symbol": "block", "parent_symbol": "", "type": "block"}
    spans = words.select("filepath", *[F.lit(v).alias(k) for k, v in literal.items()], F.lit(1).alias("start_line"), X.lines(F.col("text")).alias("body"))
    doc_id = F.regexp_extract("filepath", r"([^/]+)\.txt$", 1).cast("bigint")
    return ck.bounded(spans, config, lone=True, terms=True).select(
        doc_id.alias("doc_id"), "chunk_id", "filepath", "symbol", "part", "parts", "start_line", "end_line", "text", "dl", "entries", F.element_at(F.split("filepath", "/"), 2).alias("lang")
    )


def glob(path: str) -> str:
    """The path as a pattern that matches it alone: a stream takes a pattern for a folder or a single file."""
    head, slash, name = path.rstrip("/").rpartition("/")
    return path if set(name) & set("*?[]{}") else f"{head}{slash}{{{name}}}"


def _taken(index: str, budget: int, read: list[int], adaptive: str):
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the stream's own, where adaptive execution is off; a batch is a batch job
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        known = _table(spark, index, "manifest", MANIFEST)
        if not known.where(F.col("batch") > number).isEmpty():
            raise ValueError(f"{index} holds batches after {number}: the checkpoint is not the one that it was written with")
        read.append(batch.count())
        earlier = known.where(F.col("batch") < number).join(batch.select("doc_id"), "doc_id", "left_semi")
        latest = earlier.groupBy("doc_id").agg(F.max_by("sha", "batch").alias("sha"))
        changed = changes(newest(batch), latest).persist(StorageLevel.DISK_ONLY)  # texts are read once
        at = {n: f"{index}/{n}/batch={number}" for n in ("chunks", "postings", "manifest")}
        cut(changed.where("sha is not null"), budget).write.mode("overwrite").partitionBy("lang").parquet(at["chunks"])
        made = _table(spark, index, "chunks", CHUNKS).where(F.col("batch") == number)
        ix.postings(made, unique=True).hint("rebalance", "bucket").write.mode("overwrite").option("parquet.enable.dictionary#chunk_id", "false").partitionBy("bucket").parquet(at["postings"])
        changed.select("doc_id", "sha", "status").write.mode("overwrite").parquet(at["manifest"])
        changed.unpersist()
        told = _table(spark, index, "manifest", MANIFEST).where(F.col("batch") == number).groupBy("status").count().collect()
        LOG.info("batch %d: read %d rows, %s; wrote %d chunks to %s", number, read[-1], ", ".join(f"{r['count']} {r['status']}" for r in sorted(told)) or "nothing new", made.count(), at["chunks"])

    return take


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, settings: Settings = Settings()) -> int:
    """Take what is new in `documents` into `index`, and say how many rows were read. Other columns are not read.

    Documents without an id are passed over; blank ones are in the manifest and have no chunks.
    """
    for name, schema in (("manifest", MANIFEST), ("chunks", CHUNKS), ("postings", POSTINGS)):  # so that there is a folder to read
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{index}/{name}")
    feed = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(glob(documents))
    feed = feed.select("doc_id", "text", "lang", "source", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"))
    read: list[int] = []
    query = feed.writeStream.foreachBatch(_taken(index, settings.chunk_tokens, read, spark.conf.get("spark.sql.adaptive.enabled"))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d rows of new files in %s", sum(read), documents)
    return sum(read)


if __name__ == "__main__":
    command.main("refresh_index", __doc__, Settings, run, {"documents": "folder of Parquet files", "index": "folder of the index", "checkpoint": "folder of the stream's checkpoint"})
