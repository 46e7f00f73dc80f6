"""Retrieval: BM25, dense nearest neighbours, fusion by weighted reciprocal rank, symbol boosts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, DEFAULT, QUESTION_WORDS, EngineConfig
from ..functions import text as X
from ..functions.terms import terms_of  # noqa: F401
from .index import term_bucket


_NAMES = re.compile(r"\s*([A-Za-z_$][\w$]*)(?:\s+([A-Za-z_$][\w$]*))?\s*", re.ASCII)
_TELLING = re.compile(r"_|[A-Z]|.{13}|^[^a-z]+$")


def shape_of(query: str) -> str:
    """functions.text.query_shape for one string: one or two telling names, a question, or neither."""
    names = _NAMES.fullmatch(query)
    if names and any(_TELLING.search(n) for n in names.groups() if n):
        return "identifier"
    asked = [w.lower().strip("?.,") in QUESTION_WORDS for w in query.split()]
    return "natural" if len(asked) > 3 and sum(asked) > 1 else "mixed"


def pool_size(top_k: int, chunks: int, files: int, matched: int | None, pushed_down: bool, config: EngineConfig = DEFAULT) -> int:
    """How many candidates each retriever returns: more results, larger corpora and filters applied later need more.

    matched is the number of files that the path filter leaves, None without a filter.
    """
    each = config.pool_per_result if matched is None else config.pool_per_filtered
    growth = math.sqrt(max(1.0, chunks / config.pool_reference))
    lost = 1.0 if matched is None or pushed_down or not files else max(matched / files, config.pool_selectivity)
    ceiling = min(config.pool_max, chunks)
    return max(top_k, min(ceiling, int(int(top_k * each * growth) / lost)))


def allowed(category: str = "all", path_filter: str | None = None, repository: str | None = None) -> Column:
    """The filter on chunks: plain columns, so that it reaches the scan. repository: a folder that the path starts with."""
    if category not in CATEGORIES:
        raise ValueError(f"category is one of {', '.join(CATEGORIES)}, not {category!r}")
    out = F.lit(True) if category == "all" else F.col("doc_category") == category
    if repository:
        out &= F.col("filepath_lc").startswith(repository.lower().strip("/") + "/")
    return out & F.col("filepath_lc").contains(path_filter.lower().replace("\\", "/")) if path_filter else out


def bm25_scores(post: DataFrame, stats: DataFrame, dl: DataFrame, terms: list[str], mean_dl: float, config: EngineConfig = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, score) of the chunks of dl that hold a term; a term counts as often as the query has it.

    carry: columns of dl that come along, so that a filter or an order of chunks needs no join.
    """
    spark, times = post.sparkSession, {t: terms.count(t) for t in terms}
    asked = spark.createDataFrame(list(times.items()), "term string, times int")
    hits = post.where(F.col("term").isin(*times))
    if "bucket" in post.columns:  # only these folders are read
        wanted = [r[0] for r in asked.select(term_bucket(F.col("term"), config)).distinct().collect()]
        hits = hits.where(F.col("bucket").isin(*wanted))
    idf = stats.where(F.col("term").isin(*times)).join(F.broadcast(asked), "term")
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("dl") / F.lit(mean_dl))
    part = F.col("times") * F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + norm)
    # idf has a row for each term of the query at most
    rows = hits.select("term", "chunk_id", "tf").join(F.broadcast(idf), "term").join(dl, "chunk_id")
    return rows.groupBy("chunk_id", *carry).agg(F.sum(part).alias("score"))


def bm25_many(post: DataFrame, stats: DataFrame, dl: DataFrame, asked: DataFrame, mean_dl: float, config: EngineConfig = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, chunk_id, carry..., score, matched) for a table of queries asked (item_id, term, times), as bm25_scores().

    stats holds the terms of the queries; matched is how many of a query's terms the chunk has. Joins are left to the
    optimizer, since neither side has a bound.
    """
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("dl") / F.lit(mean_dl))
    part = F.col("times") * F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + norm)
    weighted = asked.join(stats.select("term", "idf"), "term")  # the terms of the queries meet the postings once
    rows = post.select("term", "chunk_id", "tf").join(weighted, "term").join(dl, "chunk_id").groupBy("item_id", "chunk_id", *carry)
    return rows.agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))


def top_many(post: DataFrame, stats: DataFrame, dl: DataFrame, asked: DataFrame, mean_dl: float, k: int, by: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The k best of bm25_many() for each query (and each value of `by`, a column of dl that may be text): with ranks from 1.

    Scores are rounded to 9 places, only positive ones count, and ties go to the smaller chunk id. (item_id, term) and
    (term, chunk_id) are unique. Queries in blocks meet parts of the chunks, each with its postings of the block's
    terms; a part keeps the best of each query, so that what is scored is never shuffled: (item_id, chunk_id, by,
    score, matched, rank).
    """
    weighted = asked.join(stats.select("term", "idf", "df"), "term")  # the terms of the queries
    n_items, n_rows = weighted.agg(F.count_distinct("item_id"), F.count(F.lit(1))).first()
    blocks = -(-n_items // config.queries_per_block) or 1
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    terms = weighted.select("block", "term", "df").distinct()
    parts = -(-(terms.agg(F.sum("df")).first()[0] or 0) // (blocks * config.postings_per_part)) or 1
    terms = terms.select("block", "term")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part")
    hits = post.select("term", "chunk_id", F.col("tf").cast("bigint").alias("n")).join(F.broadcast(terms) if n_rows <= config.broadcast_rows else terms, "term")
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    heads = dl.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part, "chunk_id", F.lit(None).cast("string").alias("term"), F.col("dl").alias("n"), group.alias("by"))
    left = hits.select(F.col("block").alias("block"), part, "chunk_id", "term", "n", F.lit(None).cast("string").alias("by")).unionByName(heads)
    right = weighted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("block").alias("block"), "part", "item_id", F.col("term").alias("term"), F.col("times").cast("double").alias("times"), F.col("idf").cast("double").alias("idf"))
    kind = asked.schema["item_id"].dataType.simpleString()
    keys = ["block", "part"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of(mean_dl, k, config), f"item_id {kind}, {_BEST}")
    return _best_ranks(best, k, by)


def top_counted(chunks: DataFrame, stats: DataFrame, asked: DataFrame, mean_dl: float, k: int, by: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """top_many() for chunks that come with their terms: (chunk_id, dl, entries: array of (term, tf), `by`).

    The terms of the queries, counted first, go to the tasks that read the chunks, and only the best of each part of
    the chunks is shuffled; more than broadcast_rows of them go by top_many().
    """
    weighted = asked.join(stats.select("term", "idf"), "term").select("item_id", "term", F.col("times").cast("double").alias("times"), F.col("idf").cast("double").alias("idf"))
    right = weighted.limit(config.broadcast_rows + 1).toArrow()
    if len(right) > config.broadcast_rows:
        return top_many(chunks.select("chunk_id", F.inline("entries")), stats, chunks, asked, mean_dl, k, by, config)
    terms = pc.unique(right["term"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads, n_hits, n_heads = [], [], 0, 0
        for b in batches:
            entries = b.column("entries")
            flat = entries.flatten()
            term = pc.index_in(flat.field("term"), terms)
            at = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
            chunk = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(entries), 0).to_numpy())[at]
            some, chunk = np.unique(chunk, return_inverse=True)  # chunks without a term of the queries are not carried along
            held.append((chunk + n_heads, term.take(pa.array(at)).to_numpy().astype(np.int64), flat.field("tf").take(pa.array(at)).to_numpy()))
            heads.append(b.select(["chunk_id", "dl", "by"]).take(pa.array(some)))
            n_hits, n_heads = n_hits + len(at), n_heads + len(some)
            if n_hits >= config.postings_per_part:
                yield from scored(held, heads)
                held, heads, n_hits, n_heads = [], [], 0, 0
        if n_hits:
            yield from scored(held, heads)

    def scored(held: list, heads: list) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(heads)
        order = pc.sort_indices(rows["chunk_id"]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chunk, term, tf = (np.concatenate(x) for x in zip(*held))
        return _scored(rows.take(pa.array(order)), place[chunk], term, tf, right, terms, mean_dl, k, config).to_batches()

    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    kind = asked.schema["item_id"].dataType.simpleString()
    return _best_ranks(chunks.select("chunk_id", "dl", group.alias("by"), "entries").mapInArrow(best, f"item_id {kind}, {_BEST}"), k, by)


_BEST = "chunk_id string, by string, score double, matched bigint"


def _best_ranks(best: DataFrame, k: int, by: str | None) -> DataFrame:
    """The k best of what parts of the chunks gave, with ranks from 1."""
    w = Window.partitionBy("item_id", "by").orderBy(F.desc("score"), "chunk_id")
    out = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def _best_of(mean_dl: float, k: int, config: EngineConfig):
    """The kernel of top_many(): postings and lengths of some chunks, and the terms of some queries, to each query's best."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        is_head = pc.is_null(left["term"])
        heads, hits = left.filter(is_head).sort_by("chunk_id"), left.filter(pc.invert(is_head))
        ids, terms = heads["chunk_id"].combine_chunks(), pc.unique(right["term"])
        chunk, term = pc.index_in(hits["chunk_id"], ids), pc.index_in(hits["term"], terms)
        known = pc.and_(pc.is_valid(chunk), pc.is_valid(term))  # chunks that dl does not have are not scored
        chunk, term, tf = (pc.filter(x, known).to_numpy() for x in (chunk, term, hits["n"]))
        return _scored(heads.rename_columns({"n": "dl"}), chunk, term, tf, right, terms, mean_dl, k, config)

    return best


def _scored(heads: pa.Table, chunk: np.ndarray, term: np.ndarray, tf: np.ndarray, right: pa.Table, terms: pa.Array, mean_dl: float, k: int, config: EngineConfig) -> pa.Table:
    """The best chunks of each query and group. heads: (chunk_id, dl, by) in order of ids; chunk and term: places in heads and terms."""
    ids = heads["chunk_id"].combine_chunks()
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * heads["dl"].to_numpy() / (mean_dl or 1.0))
    order = np.argsort(term, kind="stable")
    chunk, term, tf = chunk[order], term[order], tf[order]
    saturated = tf * (config.bm25_k1 + 1) / (tf + norm[chunk])
    ends = np.searchsorted(term, np.arange(len(terms) + 1))
    by = pc.fill_null(pc.dictionary_encode(heads["by"], null_encoding="encode").combine_chunks().indices, -1).to_numpy(zero_copy_only=False) if len(heads) else np.zeros(0, int)
    groups = [np.flatnonzero(by == b) for b in np.unique(by)]
    items, where = right["item_id"].combine_chunks(), pc.index_in(right["term"], terms).to_numpy()
    times, idf = right["times"].to_numpy(), right["idf"].to_numpy()
    number = pc.index_in(items, (names := pc.unique(items))).to_numpy()
    rows = np.lexsort((where, number))
    cuts = np.searchsorted(number[rows], np.arange(len(names) + 1))
    found: list[tuple] = []
    for item in range(len(names)):
        mine = [r for r in rows[cuts[item] : cuts[item + 1]] if ends[where[r] + 1] > ends[where[r]]]
        if not mine:
            continue
        spans = [slice(ends[where[r]], ends[where[r] + 1]) for r in mine]
        at = np.concatenate([chunk[s] for s in spans])
        score = np.round(np.bincount(at, np.concatenate([times[r] * idf[r] * saturated[s] for r, s in zip(mine, spans)]), len(ids)), 9)
        matched = np.bincount(at, minlength=len(ids))
        for group in groups:
            good = group[score[group] > 0]
            if len(good) > k:
                least = np.partition(score[good], -k)[-k]
                above = good[score[good] > least]
                good = np.concatenate([above, good[score[good] == least][: k - len(above)]])  # ids are in order
            found.append((np.full(len(good), item), good, score[good], matched[good]))
    item, at, score, matched = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 4
    at = pa.array(at, pa.int64())
    return pa.table({
        "item_id": names.take(pa.array(item, pa.int64())), "chunk_id": ids.take(at), "by": heads["by"].combine_chunks().take(at),
        "score": pa.array(score, pa.float64()), "matched": pa.array(matched, pa.int64()),
    })


def top_lexical(scores: DataFrame, k: int, tie: str = "chunk_id") -> DataFrame:
    """The k best positive scores with ranks from 0; scores are compared to 9 places, ties go by `tie`."""
    scores = scores.where(F.col("score") > 0).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), tie).limit(k)
    return _ranked(scores, F.desc("score"), tie)


def _ranked(rows: DataFrame, order: Column, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order, tie)) - 1)  # k rows


def squared_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def top_dense(vectors: DataFrame, query: list[float], k: int, tie: str = "chunk_id") -> DataFrame:
    """The k nearest by squared distance, exact, with ranks from 0. Filter before: it never starves the result."""
    rows = vectors.withColumn("distance", F.round(squared_distance(F.col("embedding"), query), 9)).drop("embedding")
    return _ranked(rows.orderBy("distance", tie).limit(k), F.asc("distance"), tie)


def fuse(dense: DataFrame, lexical: DataFrame, weights: tuple[float, float], boosts: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(chunk_id, score, rank): weighted reciprocal ranks added up; ties keep the order of first appearance."""
    lists = [r.select("chunk_id", (F.lit(w) / (config.rrf_k + F.col("rank") + 1)).alias("part"), F.struct(F.lit(n).alias("list"), "rank").alias("seen")) for n, (r, w) in enumerate(zip((dense, lexical), weights))]
    both = lists[0].unionByName(lists[1]).groupBy("chunk_id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    if boosts is not None:
        both = both.join(boosts, "chunk_id", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    both = both.withColumn("score", F.round("score", 12))
    w = Window.orderBy(F.desc("score"), F.col("seen"))
    return both.withColumn("rank", F.row_number().over(w) - 1).drop("seen")  # two pools at most


def symbol_boosts(chunks: DataFrame, terms: list[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """(chunk_id, boost): one unit where the last part of the symbol is a term, half where they share one."""
    unit = config.symbol_boost / (config.rrf_k + 1)
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<string>")
    bare = F.element_at(F.split(F.lower("symbol"), r"\."), -1)
    boost = F.when(F.array_contains(asked, bare), unit).when(F.arrays_overlap(X.tokenize(F.col("symbol")), asked), unit / 2)
    named = chunks.where((F.col("symbol") != "") & (F.col("symbol") != "block"))
    return named.select("chunk_id", boost.alias("boost")).where("boost is not null")


def rerank(ordered: DataFrame, chunks: DataFrame, scorer, query: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Reorder the first candidates by scorer(query, [text]) -> [score], one batch of them; the rest follow."""
    head = ordered.where(F.col("rank") < config.rerank_candidates).join(chunks.select("chunk_id", F.substring("text", 1, config.rerank_chars).alias("text")), "chunk_id")

    def score(batches):
        for b in batches:
            b["again"] = [float(x) for x in scorer(query, list(b["text"]))]
            yield b[["chunk_id", "again"]]

    again = head.coalesce(1).mapInPandas(score, "chunk_id string, again double")
    both = ordered.join(again, "chunk_id", "left")
    w = Window.orderBy(F.col("again").isNull(), F.desc("again"), "rank")
    return both.withColumn("rank", F.row_number().over(w) - 1).drop("again")
