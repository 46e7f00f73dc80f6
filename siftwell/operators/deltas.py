"""An index as a base and deltas: a run writes what it changed, readers merge, deltas are merged by size.

CURRENT names the base and the deltas, oldest first. A row belongs to the version that wrote it. What a later delta
replaces or removes is named by its tombs (version, chunk_id), so a chunk id that comes back is another row. Statistics
are counts that add up: a delta holds the documents of each term that it brings, less those that its tombs take.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, EngineConfig
from . import index as ix

ROWS = ("chunks", "vectors", "postings", "doc_len")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Deltas(ix.Generations):
    def versions(self) -> list[str]:
        """The published versions, oldest first; a reader that takes them once sees one state of the index."""
        pointer = self._path(f"{self.root}/CURRENT")
        return [r[0] for r in self.spark.read.text(f"{self.root}/CURRENT").collect()] if self._fs.exists(pointer) else []

    def current(self) -> str | None:
        return next(reversed(self.versions()), None)

    def prune(self, keep: list[str]) -> None:
        """Delete versions that are not named, nor published together with one that is."""
        at = self.versions()
        super().prune([*keep, *at] if set(at) & set(keep) else keep)

    def table(self, version: str, table: str) -> DataFrame:
        return self.spark.read.schema(schema.TABLES[table]).parquet(f"{self.root}/{version}/{table}")

    def read(self, table: str, versions: list[str] | None = None) -> DataFrame | None:
        """The live rows of a table: term_stats with the idf of the whole index, meta of the last version."""
        versions = self.versions() if versions is None else versions
        if not versions:
            return None
        if table == "meta":
            return self.table(versions[-1], "meta")
        if table == "manifest":
            return self._latest(versions).where("sha is not null")
        if table == "term_stats":
            meta = self.read("meta", versions).first()
            return ix.with_idf(self.counts(versions), meta["chunk_count"], F.lit(meta["mean_idf"]))
        return self.rows(table, versions)

    def rows(self, table: str, versions: list[str], only: list[str] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
        """Rows of `only` (all versions if not given) that no tomb of the versions names, with their version."""
        out = union([self.table(v, table).withColumn("version", F.lit(v)) for v in only or versions])
        if len(versions) == 1:
            return out
        dead = union([self.table(v, "tombs") for v in versions[1:]])  # a base has none
        n = union([self.table(v, "meta") for v in versions[1:]]).agg(F.sum("dead")).first()[0]
        if not n:
            return out
        return out.join(F.broadcast(dead) if n <= config.broadcast_rows else dead, ["version", "chunk_id"], "left_anti")

    def counts(self, versions: list[str]) -> DataFrame:
        """(term, df) over the versions, terms without documents left out."""
        return union([self.table(v, "term_counts") for v in versions]).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")

    def _latest(self, versions: list[str]) -> DataFrame:
        """The last entry of each file; a file that was removed has no sha."""
        if len(versions) == 1:
            return self.table(versions[0], "manifest")
        entries = union([self.table(v, "manifest").withColumn("turn", F.lit(i)) for i, v in enumerate(versions)])
        return entries.groupBy("filepath").agg(F.max_by(F.struct("sha", "mtime", "ids", "version"), "turn").alias("e")).select("filepath", "e.*")

    def seal(self, delta: str, at: list[str], current: DataFrame, about: dict, config: EngineConfig = DEFAULT) -> list[str]:
        """Complete a version whose chunks (of new and changed files) are written; give what is to be published.

        at: the versions that it follows, none if it is a base; current: (filepath, sha, mtime) of all files now.
        """
        chunks, empty = self.table(delta, "chunks"), self.spark.createDataFrame([], schema.MANIFEST)
        before = self.read("manifest", at) if at else empty
        status = ix.diff(before, current)
        left = status.where("status in ('changed', 'removed')").select("filepath")
        self.write(delta, "tombs", before.join(left, "filepath").select("version", F.explode("ids").alias("chunk_id")))
        dead = self.table(delta, "tombs")
        n_dead = dead.count()
        self.write(delta, "postings", ix.postings(chunks, config=config, unique=True))
        self.write(delta, "doc_len", ix.lengths(chunks, keep=tuple(ix.search_keys(chunks))))
        counts = self.table(delta, "postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n, dl = self.table(delta, "doc_len").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        size = n + n_dead
        if at:
            known = self.read("meta", at).first()
            n, dl = n + known["chunk_count"] - n_dead, dl + known["dl_total"]
        if n_dead:
            lost = self.rows("chunks", at, config=config).join(dead, ["version", "chunk_id"], "left_semi")
            dl -= self.rows("doc_len", at, config=config).join(dead, ["version", "chunk_id"], "left_semi").agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
            less = ix.postings(lost, config=config, unique=True).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            counts = counts.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self.write(delta, "term_counts", counts)
        mean = self.counts([*at, delta]).agg(F.avg(ix.raw_idf(n))).first()[0]
        ids_of = chunks.groupBy("filepath").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "chunk_id"))), lambda c: c["chunk_id"]).alias("ids"))
        fresh = current.join(status.where("status in ('changed', 'new')").select("filepath"), "filepath", "left_semi").join(ids_of, "filepath", "left")
        fresh = fresh.select("filepath", "sha", "mtime", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.lit(delta).alias("version"))
        held = before.select("filepath", "sha", F.col("mtime").alias("then"), "ids", "version").join(current, ["filepath", "sha"]).where("not then <=> mtime")
        gone = status.where("status = 'removed'").select("filepath")
        self.write(delta, "manifest", fresh.unionByName(held.drop("then")).unionByName(gone, allowMissingColumns=True))
        size += self.table(delta, "manifest").count()
        facts = {**about, "chunk_count": n, "file_count": current.count(), "dl_total": dl, "avg_dl": dl / n if n else 0.0, "mean_idf": mean or 0.0, "size": size, "dead": n_dead, "layout": schema.LAYOUT}
        self._about(delta, facts)
        return self._settled([*at, delta], config)

    def _about(self, version: str, facts: dict) -> None:
        fields = [f.split(maxsplit=1) for f in schema.META.split(", ") if not f.startswith("built_at")]
        row = self.spark.createDataFrame([tuple(facts.get(n) for n, _ in fields)], ", ".join(f"{n} {t}" for n, t in fields))
        self.write(version, "meta", row.withColumn("built_at", F.current_timestamp()))

    def _settled(self, versions: list[str], config: EngineConfig) -> list[str]:
        """The versions after the last ones are made one, as far as each is not much larger than all after it.

        Sizes then grow from the last to the first, so there are few versions (the logarithm of the rows), and a row is
        written again about once for each of them and not once a run.
        """
        size = dict(union([self.table(v, "meta").select(F.lit(v).alias("version"), "size") for v in versions]).collect())
        first, total = len(versions) - 1, size[versions[-1]]
        while first and size[versions[first - 1]] <= config.merge_ratio * total:
            first -= 1
            total += size[versions[first]]
        return versions if first == len(versions) - 1 else self.merge(versions, first, config)

    def merge(self, versions: list[str], first: int = 0, config: EngineConfig = DEFAULT) -> list[str]:
        """Make one version of versions[first:]; from the base on it is a base, without tombs and removed files."""
        inner, made = versions[first:], self.stage()
        for table in ROWS:
            self.write(made, table, self.rows(table, versions, inner, config))
        outside = union([self.table(v, "tombs") for v in inner]).where(~F.col("version").isin(*inner))
        self.write(made, "tombs", outside)
        self.write(made, "term_counts", self.counts(inner))
        entries = self._latest(inner).withColumn("version", F.when(F.col("version").isin(*inner), made).otherwise(F.col("version")))
        self.write(made, "manifest", entries if first else entries.where("sha is not null"))
        facts = self.table(versions[-1], "meta").first().asDict()
        dead = self.table(made, "tombs").count()
        size = dead + self.table(made, "chunks").count() + self.table(made, "manifest").count()
        self._about(made, {**facts, "size": size, "dead": dead})
        return [*versions[:first], made]
