"""The engine: an index of one tree, kept up to date, and the calls that query it. Calls return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import encoders, schema
from ..config import CHUNKER_VERSION, DEFAULT, EngineConfig
from ..functions import text as X
from ..operators import chunk as ck
from ..operators import deltas as dl
from ..operators import index as ix
from ..operators import lookup as lk
from ..operators import search as se
from ..sources import files as fs


class EmptyIndex(LookupError):
    """There is no index yet."""


class NoSuchPath(LookupError):
    """No indexed path contains the filter."""


@dataclass(frozen=True)
class Reindexed:
    unchanged: int
    changed: int
    new: int
    removed: int
    chunks: int
    status: str


class Engine:
    """Index `root` into `index_dir`; both can be on any file system of Spark's."""

    def __init__(self, spark: SparkSession, root: str, index_dir: str, encoder: encoders.Encoder | None = None, config: EngineConfig = DEFAULT, structural: bool = True, reranker=None):
        self.spark, self.root, self.config, self.structural, self.reranker = spark, root, config, structural, reranker
        self.encoder = encoder or encoders.HashingEncoder()
        self.store = dl.Deltas(spark, index_dir)

    # ---- upkeep

    def files(self) -> DataFrame:
        return fs.scan(self.spark, self.root, self.config)

    def reindex(self, full: bool = False) -> Reindexed:
        """Chunk and embed what changed, publish that as a delta (or as a base, if all is new).

        A tree without indexable files publishes nothing, nor does one in which nothing changed. Another encoder,
        chunker or root rebuilds all. Vectors that a lost run had committed are taken over, where their files still hold
        the same bytes; full starts without them.
        """
        at = self.store.versions()
        known = self.store.read("meta", at).first() if at else None
        made_by = (self.encoder.name, CHUNKER_VERSION, self.root, schema.LAYOUT)
        commits = ix.Commits(self.spark, self.store.root, made_by)
        if full:
            commits.clear()
        if known is None or (known["model"], known["chunker_version"], known["root"], known["layout"]) != made_by:
            full = True
        elif any(self.store.read(t, at).count() != known["chunk_count"] for t in ("chunks", "vectors")):
            full = True  # what is stored is not what was published
        # a full run, too, tells what became of each file since
        previous = self.store.read("manifest", at) if known is not None and known["layout"] == schema.LAYOUT else self.spark.createDataFrame([], schema.MANIFEST)
        before, at = (previous, at) if not full else (previous.limit(0), [])
        delta = self.store.stage()
        self.store.write(delta, "scan", self._look(before))  # one look at the tree: what is hashed is what is chunked
        files = self.store.table(delta, "scan")
        current = files.select("filepath", "sha", "mtime")
        if current.isEmpty():
            self.store.drop(delta)
            return Reindexed(0, 0, 0, 0, 0, "empty tree: the index is as it was")
        count = {r["status"]: r["count"] for r in ix.diff(previous, current).groupBy("status").count().collect()}
        told = [count.get(s, 0) for s in ("unchanged", "changed", "new", "removed")]
        about = {"model": made_by[0], "chunker_version": made_by[1], "root": made_by[2], "git_head": fs.git_head(self.root), "git_heads": fs.git_heads(self.root)}
        if at and not any(told[1:]) and (known["git_head"], known["git_heads"]) == (about["git_head"], about["git_heads"]):
            if before.select("filepath", "mtime").exceptAll(current.select("filepath", "mtime")).isEmpty():
                self.store.drop(delta)
                return Reindexed(*told, known["chunk_count"], "updated")
        self.store.write(delta, "chunks", ck.chunk_files(files.where("content is not null"), self.config, self.structural))
        chunks = self.store.table(delta, "chunks")
        keys = chunks.select("chunk_id", *ix.search_keys(chunks))
        self.store.write(delta, "vectors", self._embedded(chunks, current, commits).join(keys, "chunk_id"))
        versions = self.store.seal(delta, at, current, about, self.config)
        self.store.publish(versions[-1], *versions[:-1])
        self.store.drop(delta, "scan")
        commits.clear()
        return Reindexed(*told, self.store.read("meta", versions).first()["chunk_count"], "rebuilt" if full else "updated")

    def _look(self, before: DataFrame) -> DataFrame:
        """All files of the tree; of those that are as before, without their content."""
        known = before.select("filepath", F.col("sha").alias("was"))
        known = F.broadcast(known) if known.count() <= self.config.broadcast_rows else known
        files = self.files().join(known, "filepath", "left")
        return files.withColumn("content", F.when(F.col("was").eqNullSafe(F.col("sha")), None).otherwise(F.col("content")))

    def prune(self) -> None:
        """Delete versions that are not part of the published index; call when no reader or run can hold them."""
        self.store.prune(self.store.versions())

    def _embedded(self, new: DataFrame, current: DataFrame, commits: ix.Commits) -> DataFrame:
        """(chunk_id, embedding) of new chunks, written commit by commit, each with the files of one part of all."""
        new = new.join(current.select("filepath", "sha"), "filepath")
        left = new.join(ix.resumable(commits.read(), current).select("chunk_id"), "chunk_id", "left_anti")
        parts = min(self.config.commits_most, -(-left.count() // self.config.commit_chunks))
        for k in range(parts):
            part = left.where(F.pmod(F.xxhash64("filepath"), F.lit(parts)) == k)
            commits.write(encoders.embed(part, self.encoder, self.config.embed_batch, ("chunk_id", "filepath", "sha")))
        return ix.resumable(commits.read(), current).select("chunk_id", "embedding").join(new.select("chunk_id"), "chunk_id", "left_semi")

    def _table(self, name: str, at: list[str] | None = None) -> DataFrame:
        out = self.store.read(name, at)
        if out is None:
            raise EmptyIndex("the index is empty: call reindex(full=True)")
        return out

    # ---- queries

    def search(self, query: str, category: str = "source_code", path_filter: str | None = None, top_k: int = 10, skeletons: bool = True, repository: str | None = None) -> DataFrame:
        """Hybrid search: dense and lexical candidates under the filters, fused by the shape of the query.

        repository: a folder below the root, as status() names them in git_heads.
        """
        where = se.allowed(category, path_filter, repository)
        at = self.store.versions()  # one state of the index, whatever is published meanwhile
        meta, chunks = self._table("meta", at).first(), self._table("chunks", at)
        matched = None
        if path_filter or repository:
            matched = self._table("manifest", at).withColumn("filepath_lc", F.lower("filepath")).where(se.allowed("all", path_filter, repository)).count()
            if not matched:
                raise NoSuchPath(f"no indexed path contains {path_filter!r}" if path_filter else f"no indexed path is in {repository!r}")
        pool = se.pool_size(top_k, meta["chunk_count"], meta["file_count"], matched, True, self.config)
        vector = [float(x) for x in self.encoder.encode([X.query_prefix(self.encoder.name) + query])[0]]
        dense = se.top_dense(self._table("vectors", at).where(where), vector, pool, "tie")
        terms = se.terms_of(query)
        if terms:
            scores = se.bm25_scores(self._table("postings", at), self._table("term_stats", at), self._table("doc_len", at).where(where), terms, meta["avg_dl"], self.config, ("tie",))
            lexical = se.top_lexical(scores, pool, "tie")
        else:
            lexical = dense.limit(0)
        shape = se.shape_of(query)
        fused = se.fuse(dense, lexical, self.config.weights[shape], se.symbol_boosts(chunks.where(where), terms, self.config), self.config)
        if self.reranker is not None:
            fused = se.rerank(fused.where(F.col("rank") < max(top_k, self.config.rerank_candidates)), chunks, self.reranker, query, self.config)
        body = F.col("skeleton" if skeletons else "text").alias("body")
        # texts are read for the hits alone
        hits = chunks.join(F.broadcast(fused.where(F.col("rank") < top_k)), "chunk_id")
        cols = ["rank", "chunk_id", "filepath", "start_line", "end_line", "language", "symbol", "parent_symbol", "part", "parts"]
        return hits.select(*cols, body, "score", F.lit(pool).alias("pool"), F.lit(shape).alias("shape")).orderBy("rank")

    def find_symbol_references(self, symbol: str, path_filter: str | None = None, category: str = "source_code", limit: int = 10, repository: str | None = None) -> DataFrame:
        rows = self._references(symbol, se.allowed(category, path_filter, repository))
        return lk.ranked_references(rows, limit).select("kind", "hits", "chunk_id", "filepath", "start_line", "end_line", "language", "symbol", "skeleton")

    def _references(self, symbol: str, where: Column) -> DataFrame:
        at = self.store.versions()
        chunks = lk.holding(self._table("chunks", at).where(where), self._table("postings", at), symbol, self.config)
        return lk.references(chunks, symbol)

    def describe_references(self, symbol: str, path_filter: str | None = None, category: str = "source_code", limit: int = 10) -> str:
        """The references as text under their totals; without any, what a look at the live tree says."""
        rows = self._references(symbol, se.allowed(category, path_filter))
        total = lk.reference_totals(rows).first()
        if not total["chunks"]:
            said = {"clean": "the live tree has none either", "stale": "the live tree has it: the index is out of date", "unverified": "the live tree could not be read"}
            return f"no references to {symbol!r}; {said[self.verify_absence(symbol, path_filter)]}"
        shown = lk.ranked_references(rows, limit).collect()
        head = f"{total['hits']} hit(s) in {total['chunks']} chunk(s), {total['definitions']} of them definitions; {len(shown)} shown"
        return "\n".join([head, *(f"[{r['kind']}] {r['filepath']}:{r['start_line']}-{r['end_line']} {r['symbol']} x{r['hits']} [ID: {r['chunk_id']}]" for r in shown)])

    def verify_absence(self, symbol: str, path_filter: str | None = None) -> str:
        """For a symbol the index does not have: `stale` if the tree has it, `unverified` if it cannot be read, else `clean`."""
        try:
            live = lk.grep(self.files(), rf"(?i)(?<![A-Za-z0-9_]){X.literal(symbol)}(?![A-Za-z0-9_])", path_filter=path_filter)
            return "clean" if live.isEmpty() else "stale"
        except PySparkException:
            return "unverified"

    def find_symbol_or_keyword(self, pattern: str, path_filter: str | None = None, file_pattern: str = "*", limit: int = 40, offset: int = 0) -> DataFrame:
        """Regular-expression search of the live tree, a page at a time."""
        return lk.page(lk.grep(self.files(), pattern, file_pattern, path_filter), limit, offset)

    def get_chunk_content(self, chunk_id: str) -> DataFrame:
        """The chunk, or else up to 8 ids of the same file in a frame of one column."""
        found = lk.chunk(self._table("chunks"), chunk_id)
        return lk.nearby(self._table("chunks"), chunk_id) if found.isEmpty() else found

    def get_file_context(self, targets: list[dict]) -> DataFrame:
        """targets: [{path, start_line, end_line}], the latter two optional."""
        rows = self.spark.createDataFrame([(t.get("path"), t.get("start_line"), t.get("end_line")) for t in targets], "filepath string, first int, last int")
        named = [t["path"] for t in targets if t.get("path")]
        return lk.file_context(fs.scan(self.spark, self.root, self.config, names=named), rows)

    def status(self) -> DataFrame:
        """One row: what the index holds and how fresh it is."""
        languages = lk.language_counts(self._table("chunks"), 10).agg(F.map_from_entries(F.collect_list(F.struct("language", "chunks"))).alias("languages"))
        fresh = lk.freshness(self._table("manifest"), fs.scan(self.spark, self.root, self.config, with_content=False), self.config)
        return self._table("meta").join(F.broadcast(languages)).join(F.broadcast(fresh))  # a row each


def render(hits: DataFrame) -> str:
    """Search hits as text."""
    out = [f"--- [{r['rank'] + 1}] [ID: {r['chunk_id']}]\n    File: {r['filepath']}:{r['start_line']}-{r['end_line']} | Lang: {r['language']} | Symbol: {r['symbol']} ---\n{r['body']}" for r in hits.collect()]
    return f"{len(out)} result(s)\n\n" + "\n\n".join(out)


def render_page(page: DataFrame) -> str:
    """A page of matching lines as text, with where to go on."""
    rows = page.collect()
    if not rows:
        return "no matches"
    more = f"; next offset {rows[0]['next_offset']}" if rows[0]["next_offset"] is not None else ""
    return "\n".join([*(f"{r['filepath']}:{r['line_no']}: {r['line']}" for r in rows), f"{len(rows)} of {rows[0]['total']} match(es){more}"])


def render_status(status: DataFrame, config: EngineConfig = DEFAULT) -> str:
    """The health of an index as text, with the settings that shape it."""
    r = status.first()
    languages = ", ".join(f"{k} {v}" for k, v in sorted((r["languages"] or {}).items(), key=lambda x: (-x[1], x[0])))
    fresh = f"{r['changed_count']} changed, {r['missing_count']} missing, {r['added_count']} added since" if r["changed_count"] or r["missing_count"] or r["added_count"] else "up to date"
    lines = [f"{r['chunk_count']} chunks of {r['file_count']} files under {r['root']}", f"built {r['built_at']} at commit {r['git_head'] or 'unknown'}", *(f"  {p} at {h}" for p, h in sorted((r["git_heads"] or {}).items())), f"encoder {r['model']}, chunker {r['chunker_version']}"]
    return "\n".join([*lines, f"languages: {languages}", f"freshness: {fresh}", f"settings: {config.chunk_tokens} tokens a chunk, RRF {config.rrf_k}, BM25 k1 {config.bm25_k1} b {config.bm25_b}"])
