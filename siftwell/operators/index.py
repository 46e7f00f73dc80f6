"""The index: postings, statistics, manifests, and generations of Parquet tables with an atomic pointer."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, EngineConfig
from ..functions.terms import counted


PAGE_ROWS = 500  # of chunks: about a page of their texts


def term_bucket(term: Column, config: EngineConfig = DEFAULT) -> Column:
    """Postings are written by bucket, so that a query reads the buckets of its terms only."""
    return F.pmod(F.xxhash64(term), F.lit(config.whole_term_buckets)).cast("int")


def indexed_text(chunks: DataFrame) -> Column:
    """What the lexical index holds of a chunk: its text, path and symbol."""
    return F.concat_ws(" ", "text", "filepath", "symbol")


def postings(chunks: DataFrame, text: Column | None = None, config: EngineConfig = DEFAULT, unique: bool = False) -> DataFrame:
    """(term, chunk_id, tf, bucket).

    unique: no two chunks have one id, so that a chunk's own counts are its postings, and nothing is shuffled. Chunks
    that come with their entries (with_terms) are not counted again.
    """
    if "entries" not in chunks.columns:
        chunks = counted(chunks.select("chunk_id", (indexed_text(chunks) if text is None else text).alias("text")), F.col("text"))
    found = chunks.select("chunk_id", F.inline("entries"))
    if not unique:
        found = found.groupBy("term", "chunk_id").agg(F.sum("tf").cast("int").alias("tf"))
    return found.select("term", "chunk_id", "tf", term_bucket(F.col("term"), config).alias("bucket"))


def with_terms(chunks: DataFrame) -> DataFrame:
    """Chunks with dl, how many terms they have, and entries, an array of (term, tf): what lengths() and postings() hold of each."""
    return counted(chunks, indexed_text(chunks))


def search_keys(chunks: DataFrame) -> list[Column]:
    """What searches filter and order chunks by: filepath_lc, doc_category and tie, the order of ingestion."""
    return [F.col("filepath_lc"), F.col("doc_category"), F.concat_ws(":", "filepath", F.lpad("ord", 9, "0")).alias("tie")]


def lengths(chunks: DataFrame, text: Column | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(chunk_id, dl, keep...): terms of each chunk, chunks without any included, with what else of it is asked for."""
    rows = chunks.select("chunk_id", *keep, (indexed_text(chunks) if text is None else text).alias("__indexed"))
    out = counted(rows, F.col("__indexed"), entries=False).drop("__indexed")
    return out.select("chunk_id", "dl", *[c for c in out.columns if c not in ("chunk_id", "dl")])


def term_stats(post: DataFrame, n_chunks: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf): idf below 0 becomes epsilon times the mean of all idf, the negative ones included."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean = df.agg(F.avg(raw_idf(n_chunks)).alias("mean"))
    return with_idf(df.join(F.broadcast(mean)), n_chunks, F.col("mean"), config)  # one row joins all


def raw_idf(n_chunks: int) -> Column:
    return F.log(F.lit(n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def with_idf(counts: DataFrame, n_chunks: int, mean: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf) for (term, df), given the mean of all idf."""
    raw = raw_idf(n_chunks)
    return counts.select("term", "df", F.when(raw < 0, mean * config.bm25_epsilon).otherwise(raw).alias("idf"))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(filepath, status): new, changed, removed or unchanged between manifests (filepath, sha)."""
    a, b = previous.select("filepath", F.col("sha").alias("was")), current.select("filepath", F.col("sha").alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, "filepath", "full_outer").select("filepath", status.alias("status"))


def stale_ids(previous_ids: DataFrame, current_ids: DataFrame) -> DataFrame:
    """Ids to delete: once in the index, in no chunk now."""
    return previous_ids.select("chunk_id").distinct().join(current_ids.select("chunk_id"), "chunk_id", "left_anti")


def resumable(embedded: DataFrame, current: DataFrame) -> DataFrame:
    """Embedded ids (chunk_id, filepath, sha) that still hold: the file has the same bytes."""
    return embedded.join(current.select("filepath", "sha"), ["filepath", "sha"], "left_semi")


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where none is named, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Commits:
    """Vectors that a run has embedded and not yet published, for the next run to take up if it is lost.

    They stand in a folder named by what made them (encoder, chunker version, root, layout), so vectors of another
    maker are never read; a commit counts once it is written whole.
    """

    def __init__(self, spark: SparkSession, root: str, made_by: tuple):
        self.spark, self.root = spark, f"{root.rstrip('/')}/commits={hashlib.sha1(repr(made_by).encode()).hexdigest()[:16]}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        folders = [e.getPath().toString() for e in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        whole = [f for f in folders if self._fs.exists(self._path(f"{f}/_SUCCESS"))]
        return self.spark.read.schema(schema.COMMITS).parquet(*whole) if whole else self.spark.createDataFrame([], schema.COMMITS)

    def write(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/{uuid.uuid4().hex}")

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)


class Generations:
    """Versions of an index under one folder; CURRENT names the one that readers use.

    Works on any file system of Spark's. A version is written whole, then published by renaming the pointer.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        name = self.spark.read.text(f"{self.root}/CURRENT").first()
        return name[0] if name else None

    def read(self, table: str) -> DataFrame | None:
        name = self.current()
        if name is None:
            return None
        return self.spark.read.schema(schema.TABLES[table]).parquet(f"{self.root}/{name}/{table}")

    def stage(self) -> str:
        return f"gen={uuid.uuid4().hex[:12]}"

    def write(self, generation: str, table: str, df: DataFrame) -> None:
        """Columns that df does not have are null; postings go to files of even size, each of one bucket.

        Chunks are sorted in each file, in pages of few rows, so that a look at some ids reads the pages of those.
        """
        fields = [f.split(maxsplit=1) for f in schema.TABLES[table].split(", ")]
        rows = df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])
        if table == "chunks":
            rows = rows.sortWithinPartitions("chunk_id")
        writer = (rows.hint("rebalance", "bucket") if table == "postings" else rows).write.mode("overwrite")
        if table == "chunks":
            writer = writer.option("parquet.page.row.count.limit", str(PAGE_ROWS))
        (writer.partitionBy("bucket") if table == "postings" else writer).parquet(f"{self.root}/{generation}/{table}")

    def publish(self, generation: str, *before: str) -> None:
        """Make a version the one that readers use, after those before it."""
        jvm = self.spark.sparkContext._jvm
        temp, final = self._path(f"{self.root}/CURRENT.{generation}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(temp, True)
        out.write(bytearray("".join(f"{g}\n" for g in (*before, generation)).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        renames = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, final, renames)

    def drop(self, generation: str, table: str = "") -> None:
        """Delete a table of a version, or all of a version that was not published."""
        self._fs.delete(self._path(f"{self.root}/{generation}/{table}".rstrip("/")), True)

    def prune(self, keep: list[str]) -> None:
        """Delete versions that are not named; call when no reader can hold them."""
        for entry in self._fs.listStatus(self._path(self.root)):
            name = entry.getPath().getName()
            if name.startswith("gen=") and name not in keep:
                self._fs.delete(entry.getPath(), True)
