"""Exact lookups: symbol references, regular-expression search with paging, chunks, line ranges, health."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as X
from .chunk import numbered_lines
from .index import term_bucket

_WORDS = re.compile(X.WORD, re.ASCII)


def holding(chunks: DataFrame, postings: DataFrame, symbol: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """The chunks that may name a symbol: those whose postings hold every word of it. All are candidates if it has none.

    A hit starts and ends where words do, so the words of the symbol are whole terms of the chunk. Texts are read for
    candidates: up to `named_most` ids go to the scan as a filter, which skips pages of files that are sorted by
    chunk_id (none are read for an absent symbol); more are broadcast up to `broadcast_rows`, counted, or shuffled.
    """
    words = sorted({w.lower() for w in _WORDS.findall(symbol)})
    if not words:
        return chunks
    spark = postings.sparkSession
    if "bucket" in postings.columns:  # only these folders are read
        asked = spark.createDataFrame([(w,) for w in words], "term string").select(term_bucket(F.col("term"), config)).distinct()
        postings = postings.where(F.col("bucket").isin(*[r[0] for r in asked.collect()]))
    ids = postings.where(F.col("term").isin(*words)).select("chunk_id", "term")
    if len(words) > 1:
        ids = ids.groupBy("chunk_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(words))
    ids = ids.select("chunk_id")
    few = [r[0] for r in ids.limit(config.named_most + 1).collect()]
    if len(few) <= config.named_most:
        return chunks.where(F.col("chunk_id").isin(*few))
    return chunks.join(F.broadcast(ids) if ids.count() <= config.broadcast_rows else ids, "chunk_id", "left_semi")


def references(chunks: DataFrame, symbol: str) -> DataFrame:
    """Chunks that name a symbol, with kind (DEFINITION, call site, mention), tier and hits."""
    s = X.literal(symbol)
    hits = X.word_hits(F.col("text"), symbol)
    call = rf"(?<![A-Za-z0-9_]){s}(?![A-Za-z0-9_])\s*[(<{{]|['\"`]{s}['\"`]"
    defined = F.element_at(F.split(F.lower("symbol"), r"\."), -1) == symbol.lower()
    tier = F.when(defined, 2).when(F.col("text").rlike(call), 1).otherwise(0)
    # a plain substring test comes first: cheaper than the expression, and it drops nearly every chunk
    rows = chunks.where(F.lower("text").contains(symbol.lower())).withColumn("hits", hits.cast("bigint")).where("hits > 0")
    rows = rows.withColumn("tier", tier)
    return rows.withColumn("kind", F.when(F.col("tier") == 2, "DEFINITION").when(F.col("tier") == 1, "call site").otherwise("mention"))


def ranked_references(rows: DataFrame, limit: int, tie: list[str] | None = None) -> DataFrame:
    return rows.orderBy(F.desc("tier"), F.desc("hits"), *(tie or ["filepath", "start_line", "part"])).limit(limit)


def reference_totals(rows: DataFrame) -> DataFrame:
    """One row for references(): chunks, hits and how many chunks are definitions."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), total("hits").alias("hits"), total((F.col("tier") == 2).cast("int")).alias("definitions"))


def grep(files: DataFrame, pattern: str, file_pattern: str | None = None, path_filter: str | None = None) -> DataFrame:
    """(filepath, line_no, line) of lines that match; a pattern that is not valid raises before anything is read."""
    files.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    if path_filter:
        files = files.where(F.lower("filepath").contains(path_filter.lower()))
    if file_pattern and file_pattern != "*":
        files = files.where(glob(F.col("filepath"), file_pattern))
    return numbered_lines(files).where(F.col("line").rlike(pattern))


def glob(path: Column, pattern: str) -> Column:
    """Shell patterns * and ?; without a slash they speak of the name alone."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    target = path if "/" in pattern else F.element_at(F.split(path, "/"), -1)
    return target.rlike(f"^{body}$")


def page(matches: DataFrame, limit: int = 40, offset: int = 0) -> DataFrame:
    """One page in (filepath, line_no) order, with the total and the next offset (null on the last page)."""
    total = matches.count()
    rows = matches.orderBy("filepath", "line_no").offset(offset).limit(limit)
    following = F.lit(offset + limit if offset + limit < total else None).cast("bigint")
    return rows.select("filepath", "line_no", "line", F.lit(total).cast("bigint").alias("total"), following.alias("next_offset"))


def chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def nearby(chunks: DataFrame, chunk_id: str, limit: int = 8) -> DataFrame:
    """Ids of the same file, for a chunk id that does not exist."""
    return chunks.where(F.col("chunk_id").startswith(chunk_id.split(":")[0])).select("chunk_id").orderBy("chunk_id").limit(limit)


def file_context(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Line ranges (filepath, first, last) of files: clamped, numbered; status says which targets have no file.

    first defaults to 1 and last to first + 80; a last line before the first is the first.
    """
    first = F.greatest(F.coalesce("first", F.lit(1)), F.lit(1))
    joined = targets.join(files.select("filepath", X.lines(F.col("content")).alias("lines")), "filepath", "left")
    n = F.coalesce(F.size("lines"), F.lit(0))
    last = F.greatest(F.least(F.coalesce("last", F.col("start") + 80), F.col("n")), F.col("start"))
    rows = joined.withColumns({"start": first, "n": n}).withColumn("end", last)
    shown = F.when(F.col("start") <= F.col("n"), F.expr("slice(lines, start, end - start + 1)")).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.transform(shown, lambda x, i: F.format_string("%5d  %s", i + F.col("start"), x)), "\n")
    safe = ~F.col("filepath").startswith("/") & ~F.exists(F.split("filepath", "/"), lambda p: p == "..")
    status = F.when(F.col("filepath").isNull(), "missing path").when(~safe, "outside root").when(F.col("lines").isNull(), "not found").otherwise("ok")
    return rows.select("filepath", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("n").cast("bigint").alias("total_lines"), status.alias("status"), F.when(status == "ok", body).alias("body"))


def language_counts(chunks: DataFrame, top: int | None = None) -> DataFrame:
    out = chunks.groupBy("language").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "language")
    return out.limit(top) if top else out


def freshness(manifest: DataFrame, live: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row: changed_count, missing_count, added_count and the first changed paths."""
    rows = manifest.select("filepath", F.col("mtime").alias("then")).join(live.select("filepath", F.col("mtime").alias("now")), "filepath", "full_outer")
    late = F.col("now").cast("double") - F.col("then").cast("double") > config.stale_slack_s
    changed = F.col("then").isNotNull() & F.col("now").isNotNull() & late
    named = rows.where(changed).orderBy("filepath").limit(config.stale_report).agg(F.sort_array(F.collect_list("filepath")).alias("changed"))
    counts = rows.agg(F.count_if(changed).alias("changed_count"), F.count_if(F.col("now").isNull()).alias("missing_count"), F.count_if(F.col("then").isNull()).alias("added_count"))
    return counts.join(F.broadcast(named))  # a row each
