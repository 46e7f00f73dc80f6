"""Files as DataFrames: working trees, and the adapters from tables of text."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONFIGURATION, DEFAULT, DOCUMENTATION, EXCLUDED_DIRS, EXCLUDED_NAMES, EXCLUDED_PATTERNS, LANGUAGE_OF, EngineConfig


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot; '' if the name has none or starts with its only dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def language_of(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("other"))


def category_of(ext: Column) -> Column:
    ext = F.lower(ext)
    return F.when(ext.isin(*DOCUMENTATION), "documentation").when(ext.isin(*CONFIGURATION), "config").otherwise("source_code")


def is_excluded(path: Column) -> Column:
    """Whether a path relative to the root is left out: it leaves the root, or a part, its name or the path is listed."""
    parts = F.split(path, "/")
    out = path.startswith("..") | F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) | F.element_at(parts, -1).isin(*EXCLUDED_NAMES)
    for pattern in EXCLUDED_PATTERNS:
        out = out | path.rlike(pattern)
    return out


def in_git(path: Column) -> Column:
    """Whether a folder on the path starts with .git."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: d.startswith(".git")) & path.contains("/")


def is_supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGE_OF)


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are not: the built-in decoder raises or puts marks there."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _there(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Paths of the named files that exist below the root, as the reader takes them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    inside = [n for n in dict.fromkeys(names) if n and not n.startswith("/") and ".." not in n.split("/")]
    paths = [(n, jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}")) for n in inside]
    found = [n for n, p in paths if (fs := p.getFileSystem(conf)).exists(p) and fs.getFileStatus(p).isFile()]
    return [f"{root.rstrip('/')}/" + re.sub(r"([*?\[\]{}\\])", r"\\\1", n) for n in found]


def scan(spark: SparkSession, root: str, config: EngineConfig = DEFAULT, with_content: bool = True, names: list[str] | None = None) -> DataFrame:
    """The indexable files of a tree: filepath (relative), content, sha, mtime, length.

    Size is filtered in the scan; bytes are only read if asked for. With names (relative paths), those files alone are
    looked at and no folder is listed.
    """
    load = root if names is None else _there(spark, root, names)
    if not load:
        return spark.createDataFrame([], "filepath string, content string, sha string, mtime timestamp, length bigint")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(load)
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.expr(f"substring(p, {len(base) + 1})")
    files = raw.where(F.col("length") <= config.max_file_bytes).withColumn("p", path).withColumn("filepath", rel)
    files = files.where(is_supported(F.col("filepath")) & ~is_excluded(F.col("filepath")) & ~in_git(F.col("filepath")))
    if not with_content:
        return files.select("filepath", F.col("modificationTime").alias("mtime"), "length")
    return files.select("filepath", decode("content").alias("content"), F.sha1("content").alias("sha"), F.col("modificationTime").alias("mtime"), "length")


def discover_repositories(root: str, listed: str = "") -> list[str]:
    """Repositories to index: those listed (split at : or line ends), else the root and its direct children that are."""
    if listed:
        names = [os.path.abspath(p.strip()) for p in listed.replace(":", "\n").split("\n") if p.strip()]
        return list(dict.fromkeys(p for p in names if os.path.isdir(p)))
    is_repo = lambda p: os.path.exists(os.path.join(p, ".git"))
    children = sorted(d for d in os.listdir(root) if not d.startswith(".") and d not in EXCLUDED_DIRS and os.path.isdir(os.path.join(root, d)))
    return [p for p in [root, *(os.path.join(root, d) for d in children)] if is_repo(p)]


def git_head(root: str) -> str | None:
    """The commit that a local working tree is at; None if there is none to read."""
    git = os.path.join(root.removeprefix("file://"), ".git")

    def content(name: str) -> str:
        try:
            with open(os.path.join(git, name)) as f:
                return f.read()
        except OSError:
            return ""

    head = content("HEAD").strip()
    if not head.startswith("ref: "):
        return head or None
    name = head.removeprefix("ref: ")
    packed = dict(reversed(x.split(" ", 1)) for x in content("packed-refs").splitlines() if " " in x and x[0] not in "#^")
    return content(name).strip() or packed.get(name)


def git_heads(root: str) -> dict[str, str]:
    """The commit of each repository at or directly below a local root, by its path from the root, or its name if it is the root."""
    local = root.removeprefix("file://")
    if "://" in local or not os.path.isdir(local):
        return {}
    found = {os.path.relpath(p, local): git_head(p) for p in discover_repositories(os.path.abspath(local))}
    return {(os.path.basename(os.path.abspath(local)) if p == "." else p): h for p, h in found.items() if h}


def from_documents(documents: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(path.alias("filepath"), F.coalesce("text", F.lit("")).alias("content"))


def from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("filepath"), F.coalesce("html", F.lit("")).alias("content"))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A Markdown file a conversation, a heading a turn. A conversation is the unit that has to fit in memory."""
    turn = F.struct("turn", F.concat(F.lit("# "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("body"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["body"]), "\n")
    return conversations.groupBy("conv_id").agg(body.alias("content")).select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("filepath"), "content")


def with_sha(files: DataFrame) -> DataFrame:
    return files.withColumn("sha", F.sha1("content"))
