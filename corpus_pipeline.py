"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of docs, but for the last one. run() applies them to documents, writing Parquet after each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import common
from siftwell.llm.exact_dedup import exact_dedup
from siftwell.llm.jaccard import jaccard_components
from siftwell.llm.packing import pack_sequences
from siftwell.llm.quality import fit_quality, score_quality
from siftwell.llm.queries import vocabulary
from siftwell.llm.substring_dedup import substring_dedup

LEAST_QUALITY = 0.3

#: No stage order can be stated in SQL as a whole: the classifier is fitted.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, on all their rows and with all their columns.

    Null and empty texts are scored like others. Labels without a document, or null, teach nothing; without any
    label every document has score 0.5 and stays. An empty table stays empty.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.fresh(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that have one of these names renamed, and what selects the columns of docs from it."""
    taken = {n.lower() for n in names}
    new = {c: common.fresh(docs, "_" + c) for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether no id is null or on several rows."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then of smallest id.

    Null and empty texts are one group. Of rows that share the kept row's id and length the one with the least text
    stays. Columns that are named like a result of the operator keep their values.
    """
    rows, back = aside(docs, "keep_id", "group_size", "kept", "text_sha256", "row")
    kept = exact_dedup(rows, with_columns=True).where("kept")
    if not ids_name_rows(docs):  # rows that share the kept row's id and length are all marked
        one = Window.partitionBy("keep_id", "text_sha256").orderBy("text")
        rank = common.fresh(kept, "rank")
        kept = kept.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    return kept.select(*back)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that near copies connect; 5-word shingles, similarity 0.8.

    Where ids are null or repeated, rows are told apart by numbers in the order of ids, null first. Null texts and
    texts without words have no near copies and stay; columns of any name come along.
    """
    rows, key = docs, "doc_id"
    if not ids_name_rows(docs):
        order, key = ["doc_id", F.xxhash64("text")], common.fresh(docs, "row")
        sorted_rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = common.materialize(sorted_rows.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(rows, id_col=key, shingle=5, percent=80)
    gone = common.materialize(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), "near-copies")
    return common.semi_join(rows, gone, key, "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the words of passages that occur more than once; n_chars is that of the text that is left.

    Texts that lose nothing, null ones too, stay as they are; others are joined by single spaces, and are empty if
    all their words go. Columns that are named like a result of the operator keep their values.
    """
    rows, back = aside(docs, "n_words", "n_removed", "removed_spans", "kept_text")
    out = substring_dedup(rows)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return out.withColumns({"text": text, "n_chars": F.char_length(text).cast("bigint")}).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row for each piece of a document; an empty or null text is one piece, its end id."""
    return pack_sequences(docs, vocabulary("word_bpe_49k.json"), leading_space=False, end_id=1)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("substring_dedup", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
