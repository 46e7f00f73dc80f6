"""Queries op1 to op12 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again; decoded_sha256 is of what came back."""
    from .common import small_batches
    from .pieces import decode_pieces, encode_pieces

    small_batches(spark, 500)
    path, docs = vocabulary("piece_bpe_32k.model"), _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_pieces(docs, path).withColumnRenamed("doc_id", "of")
    back = decode_pieces(encoded.select(F.struct("of", "n_tokens", F.crc32("ids").alias("crc")).alias("row"), "ids"), path, "row")
    return back.select(F.col("row.of").alias("doc_id"), F.col("row.n_tokens").alias("n_tokens"), F.col("row.crc").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_table, write_token_table

    shards = write_token_table(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), leading_space=True, end_id=2)
    return read_token_table(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language, predict_language
    from .quality import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(~held_out("doc_id")))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, held_out, score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize, small_batches
    from dataclasses import replace

    from .chat import MAPPINGS, conversations_as_records, format_chat, read_chat

    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    as_named = [replace(m, roles={}) for m in MAPPINGS]  # roles of the table are read back as they are
    written = materialize(format_chat(conversations_as_records(turns.unionByName(extra), every_layout=True), mappings=as_named), "chats")
    out = read_chat(written, ["conv_id"])
    return out.select(
        "conv_id", "n_turns", F.sha2("transcript", 256).alias("turns_sha256"), F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    out = pack_sequences(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), leading_space=False, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on by one, modulo 10."""
    from .hard_negatives import hard_negatives

    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_sentencepiece, op4_token_files, op5_exact_dedup, op6_quality, op7_chat_format, op8_packing, op9_nearest_neighbours, op10_jaccard_join, op11_hard_negatives, op12_exact_topk)}

_WORDS = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e"
_INNER = "CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT)"

ORACLES = {
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, {_WHOLE} FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, {_INNER} AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3""",
    "op12_exact_topk": f"""
WITH v AS (SELECT vec_id, {_WHOLE} FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_INNER} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op1_substring_dedup": rf"""
WITH {_WORDS.strip()},
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, md5(list_aggregate(ws[p:p+34], 'string_agg', ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM rep),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE {_WORDS.strip().replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p+2], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         WHERE a.doc_id <> b.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, min(reach.b)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id""",
    "op7_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '(<)(\\*)(\||s>|/s>|<SYS>>|</SYS>>)', '\1#\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1#\2\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS len FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm ORDER BY len DESC, doc_id)""",
}
