"""The jobs as queries over the driver's tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import batch_search, refresh_index
from siftwell.operators.index import working_folder
from siftwell.queries import _TOKENS, _lines, _terms


def _indexed(spark: SparkSession, sf_dir: str, at: str) -> str:
    refresh_index.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return f"{at}/index"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the index after two runs over the same feed; the second finds nothing new."""
    at = working_folder(spark, "job1")
    for _ in range(2):
        index = _indexed(spark, sf_dir, at)
    return refresh_index.chunks(spark, index).select(
        "doc_id", "lang", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("part", "parts", "start_line", "end_line")], F.char_length("text").cast("bigint").alias("n_chars"), F.sha1("text").alias("text_sha")
    )


def job2_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to every item of benchmark, after two runs over one index."""
    at = working_folder(spark, "job2")
    index = _indexed(spark, sf_dir, at)
    for _ in range(2):
        batch_search.run(spark, f"{sf_dir}/benchmark.parquet", index, f"{at}/results")
    return batch_search.results(spark, f"{at}/results").withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (job1_refresh_index, job2_batch_search)}

_DOCS = "SELECT doc_id, coalesce(lang, 'none') AS lang, 'docs/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS filepath, text AS content FROM documents WHERE text IS NOT NULL"
_CHUNKS = f"""RECURSIVE d AS ({_DOCS}), f AS {_lines(r"SELECT filepath, content FROM d WHERE regexp_matches(content, '[^\x20\x09-\x0D]')")},
b AS (SELECT filepath, ls, regexp_replace(x, '^\\n+|\\n+$', '', 'g') AS y, CAST(greatest(200, floor(440 * greatest(1.0, length(x) / (floor(length(x) / 1.6) + 1)) * 0.95)) AS BIGINT) AS budget
      FROM (SELECT filepath, ls, array_to_string(ls, chr(10)) AS x FROM f)),
w AS (SELECT filepath, budget, n, i, substr(line, i * budget + 1, budget) AS piece FROM (SELECT filepath, budget, n, line, unnest(range(0, greatest(1, (length(line) + budget - 1) // budget))) AS i
      FROM (SELECT filepath, budget, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM b WHERE {_TOKENS.format("y")} > 440))),
g AS (SELECT filepath, budget, CAST(floor(budget * 0.12) AS BIGINT) AS carry, list(length(piece) ORDER BY n, i) AS len, list(n ORDER BY n, i) AS num, list(piece ORDER BY n, i) AS pieces FROM w GROUP BY filepath, budget),
h AS (SELECT filepath, carry, budget, len FROM g),
r AS (SELECT filepath, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z FROM h
  UNION ALL
  SELECT filepath, k + 1, CASE WHEN cut THEN k + 1 - keep ELSE s END, (CASE WHEN cut THEN coalesce(list_sum(len[k - keep + 1:k]), 0) + keep ELSE size END) + len[k + 1] + 1, CASE WHEN cut THEN s END, CASE WHEN cut THEN k END
  FROM (SELECT * REPLACE (CASE WHEN cut THEN keep ELSE 0 END AS keep) FROM (SELECT *, CASE WHEN k < s OR len[k] > carry THEN 0 WHEN k - 1 < s OR len[k] + 1 + len[k - 1] > carry THEN 1 WHEN k - 2 < s OR len[k] + len[k - 1] + 2 + len[k - 2] > carry THEN 2 ELSE 3 END AS keep
        FROM (SELECT r.filepath, k, s, size, len, carry, k >= s AND size + len[k + 1] + 1 > budget AS cut FROM r JOIN h USING (filepath) WHERE k < len(len))))),
p AS (SELECT filepath, a, z FROM r WHERE a IS NOT NULL UNION ALL SELECT r.filepath, s, k FROM r JOIN h USING (filepath) WHERE k = len(h.len)),
q AS (SELECT p.filepath, a, z, len[a:z] AS len, num[a:z] AS num, pieces[a:z] AS pieces, list_sum(len[a:z]) + z - a AS n_chars, greatest(200, CAST(floor(budget * 0.6) AS BIGINT)) AS finer FROM p JOIN g USING (filepath)),
v AS (SELECT * FROM q WHERE floor(n_chars / 1.6) + 1 > 440 AND z > a),
r2 AS (SELECT filepath, a, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t FROM v
  UNION ALL SELECT filepath, a, k + 1, CASE WHEN cut THEN k + 1 ELSE s END, CASE WHEN cut THEN 0 ELSE size END + len[k + 1] + 1, CASE WHEN cut THEN s END, CASE WHEN cut THEN k END
  FROM (SELECT r2.filepath, r2.a, k, s, size, len, k >= s AND size + len[k + 1] + 1 > finer AS cut FROM r2 JOIN v ON v.filepath = r2.filepath AND v.a = r2.a WHERE k < len(len))),
p2 AS (SELECT filepath, a, f, t FROM r2 WHERE f IS NOT NULL UNION ALL SELECT r2.filepath, r2.a, s, k FROM r2 JOIN v ON v.filepath = r2.filepath AND v.a = r2.a WHERE k = len(v.len)),
every AS (SELECT filepath, z, CAST(0 AS BIGINT) AS sub, num[1] AS start_line, num[-1] AS end_line, array_to_string(pieces, chr(10)) AS text FROM q WHERE NOT (floor(n_chars / 1.6) + 1 > 440 AND z > a)
  UNION ALL SELECT p2.filepath, v.z, p2.t, num[f], num[t], array_to_string(pieces[f:t], chr(10)) FROM p2 JOIN v ON v.filepath = p2.filepath AND v.a = p2.a),
cut AS (SELECT filepath, row_number() OVER (PARTITION BY filepath ORDER BY z, sub) AS part, count(*) OVER (PARTITION BY filepath) AS parts, start_line, end_line, text FROM every
  UNION ALL SELECT filepath, 1, 1, 1, len(ls), y FROM b WHERE {_TOKENS.format("y")} <= 440),
c AS (SELECT doc_id, lang, filepath || ':block:' || start_line || '-' || end_line || CASE WHEN parts > 1 THEN '.p' || part ELSE '' END AS chunk_id, part, parts, start_line, end_line, text, filepath FROM cut JOIN d USING (filepath))"""

ORACLES = {
    "job1_refresh_index": f"WITH {_CHUNKS} SELECT doc_id, lang, chunk_id, CAST(part AS BIGINT) AS part, CAST(parts AS BIGINT) AS parts, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(length(text) AS BIGINT) AS n_chars, sha1(text) AS text_sha FROM c",
    "job2_batch_search": f"""WITH {_CHUNKS},
tok AS (SELECT chunk_id, {_terms("concat_ws(' ', text, filepath, 'block')")} AS ts FROM c),
dl AS (SELECT chunk_id, len(ts) AS dl FROM tok),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM c) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
stats AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 9) AS score, count(*) AS matched
      FROM asked JOIN post USING (term) JOIN stats USING (term) JOIN dl USING (chunk_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
       round(score, 6) AS score, matched, lang FROM s JOIN c USING (chunk_id) WHERE score > 0 QUALIFY rank <= 10""",
}
