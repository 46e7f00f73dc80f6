"""Exact dedup on DataFrame operations only, safe against groups of any size.

Equal contents are combined in each map task (partial aggregation), then by (digest, salt), then over salts;
the grouping key holds the whole normalised content at each of these stages, so equal digests of different
contents never merge. Rows then look their group up by digest alone, or by digest and content if any digest
turned out to cover several contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SALTS = 16
_SPAN = "cast(18446744073709551616 as decimal(20,0))"  # 2**64
_TOP = "cast(9223372036854775807 as decimal(20,0))"
_NO_ID = "cast(-9223372036854775808 as bigint)"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), C.SPACE + "+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None, with_columns: bool = False) -> DataFrame:
    """Group rows of equal normalised text; the longest original text, then the smallest id, stays.

    Returns id_col, keep_id, group_size, kept and text_sha256, one row per row of docs. Null and empty texts
    form one group. A null id ranks before all others. A row that repeats the kept row's id, content and
    length is that document again and shares its kept flag. with_columns: all columns of docs come along,
    less those named like a result; otherwise other columns are not read, whatever their names. An empty
    table gives an empty result. digest (SHA-256 unless given) only routes rows: any function of the
    normalised text gives the same result.
    """
    named = ["keep_id", "group_size", "kept", "text_sha256"]
    carried = [F.struct(*[F.col(f"`{c}`") for c in C.without(docs, *named).columns]).alias("row")] if with_columns else []
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(i.cast("long").alias("id"), normalised(t).alias("norm"), F.char_length(F.coalesce(t, F.lit(""))).alias("n"), *carried)
    rows = rows.withColumn("digest", digest(F.col("norm")) if digest else F.sha2("norm", 256))
    # one decimal orders a group's members, so that aggregation buffers stay fixed-width and are hashed
    rank = F.expr(f"cast(n as decimal(10,0)) * {_SPAN} + ({_TOP} - coalesce(id, {_NO_ID}))").cast("decimal(38,0)")
    salt = F.pmod(F.xxhash64("id", "n"), F.lit(salts))
    salted = rows.groupBy("digest", "norm", salt.alias("salt")).agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("size"))
    groups = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    winner = [
        F.expr(f"cast({_TOP} - (best % {_SPAN}) as bigint)").alias("keep_id"),
        F.expr(f"cast((best - (best % {_SPAN})) / {_SPAN} as int)").alias("keep_n"),
        F.col("size").alias("group_size"),
    ]
    found = C.materialize(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("size").alias("size")), "exact-groups")
    if digest is None and found.where("contents > 1").isEmpty():
        out, sha = rows.drop("norm").join(found.select("digest", *winner), "digest"), F.col("digest")
    else:  # a digest covers several contents, or is not the one asked for in the result
        out, sha = rows.join(groups.select("digest", "norm", *winner), ["digest", "norm"]), F.sha2("norm", 256)
    kept = (F.coalesce(F.col("id"), F.expr(_NO_ID)) == F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    first = [F.col("row.*")] if with_columns else [F.col("id").alias(id_col)]
    return out.select(*first, F.expr(f"nullif(keep_id, {_NO_ID})").alias("keep_id"), "group_size", kept.alias("kept"), sha.alias("text_sha256"))
