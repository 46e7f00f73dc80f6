"""Queries over the driver's tables for every operator of the engine, and equivalent SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .config import CONFIGURATION, DEFAULT, DOCUMENTATION, EXCLUDED_DIRS, EXCLUDED_NAMES, EXCLUDED_PATTERNS, LANGUAGE_OF, QUESTION_WORDS
from .functions import text as X
from .operators import chunk as ck
from .operators import deltas as dl
from .operators import index as ix
from .operators import lookup as lk
from .operators import markup as mk
from .operators import metrics
from .operators import search as se
from .sources import files as fs

QUERY = "the passage of thing and entry"
TERMS = se.terms_of(QUERY)
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.from_documents(table(spark, sf_dir, "documents"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document, for the retrieval queries; its first word is its symbol."""
    docs = table(spark, sf_dir, "documents")
    path = fs.from_documents(docs.limit(0)).columns and F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    symbol = F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0)
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", path.alias("filepath"), F.lower(path).alias("filepath_lc"), symbol.alias("symbol"),
        F.lit("documentation").alias("doc_category"), "lang", F.lit(1).alias("start_line"), F.lit(1).alias("part"),
    )


# ---- SQL building blocks

_LINES = "CASE WHEN content = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN ends_with(c, chr(10)) THEN c[:-2] ELSE c END, chr(10)) END"


def _lines(src: str) -> str:
    return f"(SELECT filepath, {_LINES} AS ls FROM (SELECT filepath, content, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS c FROM ({src})))"


_DOCS = "SELECT 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS filepath, coalesce(text, '') AS content FROM documents"
_PAGES = "SELECT 'pages/' || page_id || '.html' AS filepath, coalesce(html, '') AS content FROM pages"
_CHATS = "SELECT 'conversations/' || conv_id || '.md' AS filepath, string_agg('# ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id"


def _terms(x: str) -> str:
    parts = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([0-9])', '\1_\2', 'g')), '_'), lambda p: p <> '')"
    snake = "CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE []::VARCHAR[] END"
    camel = f"CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND len({parts}) > 1 THEN {parts} ELSE []::VARCHAR[] END"
    return f"flatten(list_transform(regexp_extract_all({x}, '{X.WORD}'), lambda w: list_concat([lower(w)], {snake}, {camel})))"


def _in(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_TOKENS = "CASE WHEN length({0}) < 704 THEN CAST(floor(length({0}) / 3.0) AS BIGINT) + 1 ELSE CAST(floor(length({0}) / 1.6) AS BIGINT) + 1 END"
_SHAPE = f"""CASE WHEN len(ws) BETWEEN 1 AND 2 AND list_bool_and(list_transform(ws, lambda w: regexp_full_match(w, '[A-Za-z_$][A-Za-z0-9_$]*')))
  AND list_bool_or(list_transform(ws, lambda w: contains(w, '_') OR lower(w) <> w OR NOT regexp_matches(w, '[a-z]') OR length(w) > 12)) THEN 'identifier'
  WHEN len(ws) >= 4 AND len(list_filter(ws, lambda w: regexp_replace(lower(w), '^[?.,]+|[?.,]+$', '', 'g') IN ({_in(QUESTION_WORDS)}))) >= 2 THEN 'natural' ELSE 'mixed' END"""
_CORPUS = "c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, text, lang, 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS filepath, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS symbol FROM documents)"
_INDEX = f"""{_CORPUS},
tok AS (SELECT chunk_id, {_terms("concat_ws(' ', text, filepath, symbol)")} AS ts FROM c),
dl AS (SELECT chunk_id, len(ts) AS dl FROM tok),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM c) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_LEXICAL = f"""{_INDEX},
q AS (SELECT unnest([{_in(TERMS)}]) AS term),
lex AS (SELECT chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 9) AS score
        FROM q JOIN post USING (term) JOIN stats USING (term) JOIN dl USING (chunk_id) GROUP BY chunk_id),
lexr AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM lex WHERE score > 0 QUALIFY rank < {{k}})"""
_DENSE = """e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, embedding, label FROM embeddings),
qv AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
dist AS (SELECT chunk_id, round(list_sum(list_transform(list_zip(embedding, v), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 9) AS distance FROM e, qv WHERE {where}),
denser AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) - 1 AS rank FROM dist QUALIFY rank < {k})"""


# ---- text


@query("tokenize_terms", f"SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))


@query("token_estimate", f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("text_density", "SELECT doc_id, round(greatest(1.0, length(text) / (floor(length(text) / 1.6) + 1)), 6) AS density FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.density(F.col("text")), 6).alias("density"))


@query(
    "query_shape_classify",
    f"""WITH q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT text FROM benchmark),
s AS (SELECT query, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS ws FROM q), t AS (SELECT query, {_SHAPE} AS shape FROM s)
SELECT query, shape, CAST(CASE shape WHEN 'identifier' THEN 0.7 WHEN 'natural' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS w_dense,
CAST(CASE shape WHEN 'identifier' THEN 1.4 WHEN 'natural' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS w_lexical FROM t""",
)
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_name").alias("query")).union(table(spark, d, "benchmark").select("text")).distinct()
    w = X.shape_weights(F.col("shape"))
    return q.withColumn("shape", X.query_shape(F.col("query"))).select("query", "shape", w["dense"].alias("w_dense"), w["lexical"].alias("w_lexical"))


# ---- sources

_EXT = r"lower(regexp_extract(regexp_extract(filepath, '[^/]*$'), '^.+(\.[^.]*)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{lang}'" for e, lang in LANGUAGE_OF.items()) + " ELSE 'other' END"
_PATHS = [
    "src/a.py", "src/A.PY", "web/app.min.js", "web/site.js", ".env", "conf/.env.local", "lib/x.g.dart", "lib/x.dart", "api/v1_pb2.py", "api/v1_pb.py", "api/pb.py",
    "node_modules/a/b.js", "build/x.c", "builds/x.c", "yarn.lock", "docs/readme.md", "docs/readme.rst", "style/a.scss", "h/a.h", "gradle.lockfile", "x.map", "../up.py",
    "out", "a/out/b.ts", "run.zsh", "k.kts", "noext", ".gitignore", "Makefile", "t/data.json", "t/data.yml", "t/data.toml", "p.tsx", "p.jsx", "m.swift",
]
_PATH_SQL = "(SELECT unnest([" + _in(_PATHS) + "]) AS filepath)"
_ALL_PATHS = f"(SELECT filepath FROM {_PATH_SQL} UNION ALL SELECT filepath FROM ({_DOCS}) UNION ALL SELECT filepath FROM ({_PAGES}))"


def all_paths(spark, d):
    given = spark.createDataFrame([(p,) for p in _PATHS], "filepath string")
    return given.union(doc_files(spark, d).select("filepath")).union(fs.from_pages(table(spark, d, "pages")).select("filepath"))


@query("language_category_map", f"SELECT filepath, {_LANG} AS language, CASE WHEN {_EXT} IN ({_in(DOCUMENTATION)}) THEN 'documentation' WHEN {_EXT} IN ({_in(CONFIGURATION)}) THEN 'config' ELSE 'source_code' END AS doc_category FROM {_ALL_PATHS}")
def _(spark, d):
    ext = fs.extension(F.col("filepath"))
    return all_paths(spark, d).select("filepath", fs.language_of(ext).alias("language"), fs.category_of(ext).alias("doc_category"))


@query(
    "path_exclusion",
    f"""SELECT filepath, starts_with(filepath, '..') OR list_has_any(string_split(filepath, '/'), [{_in(EXCLUDED_DIRS)}]) OR regexp_extract(filepath, '[^/]*$') IN ({_in(EXCLUDED_NAMES)})
OR {" OR ".join(f"regexp_matches(filepath, '{p}')" for p in EXCLUDED_PATTERNS)} AS excluded, {_EXT} IN ({_in(LANGUAGE_OF)}) AS supported FROM {_ALL_PATHS}""",
)
def _(spark, d):
    return all_paths(spark, d).select("filepath", fs.is_excluded(F.col("filepath")).alias("excluded"), fs.is_supported(F.col("filepath")).alias("supported"))


# ---- incremental maintenance: an earlier snapshot without source src1, with other text in src2 and lang es since removed

_NOW = f"now AS (SELECT filepath, sha1(content) AS sha, lang, source FROM (SELECT *, 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS filepath, coalesce(text, '') AS content FROM documents) WHERE lang <> 'es')"
_THEN = "was AS (SELECT filepath, CASE WHEN source = 'src2' THEN sha1(content || '.') ELSE sha1(content) END AS sha, source FROM (SELECT *, 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS filepath, coalesce(text, '') AS content FROM documents) WHERE source <> 'src1')"


def snapshots(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("lang", "source", F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filepath"), F.coalesce("text", F.lit("")).alias("content"))
    now = rows.where("lang <> 'es'").select("filepath", F.sha1("content").alias("sha"))
    was = rows.where("source <> 'src1'").select("filepath", F.sha1(F.when(F.col("source") == "src2", F.concat("content", F.lit("."))).otherwise(F.col("content"))).alias("sha"))
    return was, now


def _ids(manifest):
    return manifest.select(F.concat_ws(":", "filepath", F.substring("sha", 1, 8)).alias("chunk_id"), "filepath", "sha")


@query("content_hash_manifest", f"SELECT filepath, sha1(content) AS sha, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM ({_DOCS})")
def _(spark, d):
    return doc_files(spark, d).select("filepath", F.sha1("content").alias("sha"), F.octet_length("content").cast("bigint").alias("length"))


@query("manifest_diff", f"WITH {_NOW}, {_THEN} SELECT filepath, CASE WHEN was.sha IS NULL THEN 'new' WHEN now.sha IS NULL THEN 'removed' WHEN was.sha = now.sha THEN 'unchanged' ELSE 'changed' END AS status FROM was FULL JOIN now USING (filepath)")
def _(spark, d):
    return ix.diff(*snapshots(spark, d))


@query("manifest_diff_counts", f"WITH {_NOW}, {_THEN} SELECT CASE WHEN was.sha IS NULL THEN 'new' WHEN now.sha IS NULL THEN 'removed' WHEN was.sha = now.sha THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS files FROM was FULL JOIN now USING (filepath) GROUP BY 1")
def _(spark, d):
    return ix.diff(*snapshots(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("stale_chunk_antijoin", f"WITH {_NOW}, {_THEN} SELECT DISTINCT filepath || ':' || sha[:8] AS chunk_id FROM was WHERE filepath || ':' || sha[:8] NOT IN (SELECT filepath || ':' || sha[:8] FROM now)")
def _(spark, d):
    was, now = snapshots(spark, d)
    return ix.stale_ids(_ids(was), _ids(now))


@query("orphan_except", f"WITH {_NOW}, {_THEN} SELECT filepath || ':' || sha[:8] AS chunk_id FROM now EXCEPT SELECT filepath || ':' || sha[:8] FROM was")
def _(spark, d):
    was, now = snapshots(spark, d)
    return _ids(now).select("chunk_id").subtract(_ids(was).select("chunk_id"))


@query("resume_semijoin", f"WITH {_NOW}, {_THEN} SELECT filepath || ':' || sha[:8] AS chunk_id, filepath, sha FROM was WHERE (filepath, sha) IN (SELECT (filepath, sha) FROM now)")
def _(spark, d):
    was, now = snapshots(spark, d)
    return ix.resumable(_ids(was), now).select("chunk_id", "filepath", "sha")


# ---- chunking


@query(
    "window_chunks",
    f"""WITH f AS {_lines(_DOCS + " UNION ALL " + _PAGES)}, w AS (SELECT filepath, ls, unnest(range(0, greatest(len(ls), 1), 32)) AS i FROM f WHERE len(list_filter(ls, lambda x: trim(x, ' ') <> '')) >= 4)
SELECT filepath, i + 1 AS start_line, i + len(ls[i+1:i+40]) AS end_line FROM w WHERE (i = 0 OR i + 8 <= len(ls)) AND len(list_filter(ls[i+1:i+40], lambda x: trim(x, ' ') <> '')) > 0""",
)
def _(spark, d):
    files = doc_files(spark, d).union(fs.from_pages(table(spark, d, "pages")))
    spans = ck.window_spans(files.select("filepath", F.lit(1).alias("start_line"), X.lines(F.col("content")).alias("body")))
    return spans.select("filepath", F.col("start_line").cast("bigint").alias("start_line"), (F.col("start_line") + F.size("body") - 1).cast("bigint").alias("end_line"))


@query(
    "gap_islands",
    f"""WITH l AS (SELECT filepath, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM {_lines(_DOCS)}), r AS (SELECT *, n - row_number() OVER (PARTITION BY filepath ORDER BY n) AS g FROM l WHERE NOT contains(line, '|'))
SELECT filepath, min(n) AS start_line, max(n) AS end_line FROM r GROUP BY filepath, g""",
)
def _(spark, d):
    rows = ck.numbered_lines(doc_files(spark, d))
    return ck.gaps(rows, rows.where(F.col("line").contains("|"))).select("filepath", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query(
    "markdown_sections",
    rf"""WITH l AS (SELECT filepath, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM {_lines(_CHATS)}),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.*)$') THEN 1 ELSE 0 END) OVER (PARTITION BY filepath ORDER BY n) AS sec FROM l),
g AS (SELECT filepath, sec, min(n) AS start_line, max(n) AS end_line, min_by(line, n) AS head FROM s GROUP BY filepath, sec HAVING bool_or(trim(line, ' ') <> ''))
SELECT filepath, start_line, end_line, coalesce(nullif(regexp_replace(trim(regexp_extract(head, '^(#{{1,6}})\s+(.*)$', 2), ' '), '[^A-Za-z0-9_ .-]', '', 'g')[:60], ''), 'section') AS symbol FROM g""",
)
def _(spark, d):
    s = ck.markdown_sections(fs.from_conversations(table(spark, d, "conversations")))
    return s.select("filepath", F.col("start_line").cast("bigint").alias("start_line"), (F.col("start_line") + F.size("body") - 1).cast("bigint").alias("end_line"), "symbol")


def for_pages(spark, d, rows: list[tuple], kinds: str) -> DataFrame:
    """The rows, given by hand, once for each page, with its id."""
    names = [x.split()[0] for x in kinds.split(", ")]
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]).cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in kinds.split(', '))}>>")
    return table(spark, d, "pages").select("page_id", F.explode(made).alias("r")).select("page_id", "r.*")


_SQL_FILE = """-- schema
CREATE TABLE users_$n (
  id int
);

ALTER TABLE users_$n ADD COLUMN x int;
create or replace function public.touch(a int)
insert into log values (1);
CREATE POLICY "read own rows" ON users
  USING (true);
GRANT SELECT ON users TO web;
drop table if exists old;
DO $$ begin end $$;
"""


@query(
    "sql_ddl_resplit",
    rf"""WITH f AS (SELECT page_id, string_split(replace('{_SQL_FILE.rstrip(chr(10))}', '$n', CAST(page_id AS VARCHAR)), chr(10)) AS ls FROM pages),
l AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM f),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^\s*(CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|GRANT|REVOKE|COMMENT|DO)\b') AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS g FROM l),
t AS (SELECT page_id, min(n) AS start_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS body FROM s GROUP BY page_id, g)
SELECT page_id, start_line, n_lines, coalesce(nullif(coalesce(nullif(regexp_extract(body, '(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|FUNCTION|PROCEDURE|VIEW|TRIGGER|POLICY|INDEX|EXTENSION)(?:\s+IF\s+NOT\s+EXISTS)?\s+(?:"([^"]+)"|([A-Za-z0-9_.]+))', 1), ''),
  regexp_extract(body, '(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|FUNCTION|PROCEDURE|VIEW|TRIGGER|POLICY|INDEX|EXTENSION)(?:\s+IF\s+NOT\s+EXISTS)?\s+(?:"([^"]+)"|([A-Za-z0-9_.]+))', 2)), ''),
  replace(regexp_extract(body, '(?im)^\s*(ALTER|INSERT|GRANT|DROP)\s+\w+\s+(["A-Za-z0-9_.]+)', 2), '"', '')) AS symbol FROM t""",
)
def _(spark, d):
    files = for_pages(spark, d, [(_SQL_FILE,)], "content string").select(F.col("page_id").cast("string").alias("filepath"), F.replace("content", F.lit("$n"), F.col("page_id").cast("string")).alias("content"))
    return ck.sql_statements(files).select(F.col("filepath").cast("bigint").alias("page_id"), F.col("start_line").cast("bigint").alias("start_line"), F.size("body").cast("bigint").alias("n_lines"), "symbol")


_DECLARED = {
    "export default async function fetchAll(a) {": "fetchAll", "class Foo extends Bar {": "Foo", "def run(self):": "run", "  suspend fun load(): Int = 1": "load",
    "func (s *Server) Serve(w Writer) {": "Serve", "pub async unsafe fn poll(x: &mut X) {": "poll", "public protocol Shape {": "Shape", "int main(int argc) {": "main",
    "if (x) {": "", "return foo(bar);": "", "plain words of text": "", "const else = 1\nlet value = 2": "value",
}


@query("fallback_symbol", "SELECT page_id, t.* FROM pages, (VALUES " + ", ".join(f"({n}, '{v}')" for n, v in enumerate(_DECLARED.values())) + ") t(item, symbol)")
def _(spark, d):
    rows = for_pages(spark, d, list(enumerate(_DECLARED)), "item int, text string")
    return rows.select("page_id", "item", ck.declared_symbol(F.col("text")).alias("symbol"))


_SPLIT = f"""WITH RECURSIVE f AS {_lines(_DOCS)},
t AS (SELECT filepath, ls, array_to_string(ls, chr(10)) AS x FROM f),
b AS (SELECT filepath, ls, regexp_replace(x, '^\\n+|\\n+$', '', 'g') AS y, CAST(greatest(200, floor(440 * greatest(1.0, length(x) / (floor(length(x) / 1.6) + 1)) * 0.95)) AS BIGINT) AS budget FROM t),
big AS (SELECT * FROM b WHERE {_TOKENS.format("y")} > 440),
w AS (SELECT filepath, budget, n, i, substr(line, i * budget + 1, budget) AS piece FROM (SELECT filepath, budget, n, line, unnest(range(0, greatest(1, (length(line) + budget - 1) // budget))) AS i
      FROM (SELECT filepath, budget, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM big))),
g AS (SELECT filepath, budget, CAST(floor(budget * 0.12) AS BIGINT) AS carry, list(length(piece) ORDER BY n, i) AS len, list(n ORDER BY n, i) AS num FROM w GROUP BY filepath, budget),
r AS (SELECT filepath, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z FROM g
  UNION ALL
  SELECT filepath, k + 1, CASE WHEN cut THEN k + 1 - keep ELSE s END, (CASE WHEN cut THEN CASE keep WHEN 0 THEN 0 WHEN 1 THEN len[k] + 1 WHEN 2 THEN len[k] + len[k-1] + 2 ELSE len[k] + len[k-1] + len[k-2] + 3 END ELSE size END) + len[k+1] + 1,
         CASE WHEN cut THEN s END, CASE WHEN cut THEN k END
  FROM (SELECT *, CASE WHEN k < s OR len[k] > carry THEN 0 WHEN k - 1 < s OR len[k] + 1 + len[k-1] > carry THEN 1 WHEN k - 2 < s OR len[k] + len[k-1] + 2 + len[k-2] > carry THEN 2 ELSE 3 END AS keep
        FROM (SELECT r.filepath, k, s, size, len, carry, k >= s AND size + len[k+1] + 1 > budget AS cut FROM r JOIN g USING (filepath) WHERE k < len(len)))),
p AS (SELECT filepath, a, z FROM r WHERE a IS NOT NULL UNION ALL SELECT r.filepath, s, k FROM r JOIN g USING (filepath) WHERE k = len(g.len)),
q AS (SELECT p.filepath, a, z, len[a:z] AS len, num[a:z] AS num, list_sum(len[a:z]) + z - a AS n_chars, greatest(200, CAST(floor(budget * 0.6) AS BIGINT)) AS finer FROM p JOIN g USING (filepath)),
v AS (SELECT * FROM q WHERE floor(n_chars / 1.6) + 1 > 440 AND z > a),
r2 AS (SELECT filepath, a, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t FROM v
  UNION ALL SELECT filepath, a, k + 1, CASE WHEN cut THEN k + 1 ELSE s END, CASE WHEN cut THEN 0 ELSE size END + len[k+1] + 1, CASE WHEN cut THEN s END, CASE WHEN cut THEN k END
  FROM (SELECT r2.filepath, r2.a, k, s, size, len, k >= s AND size + len[k+1] + 1 > finer AS cut FROM r2 JOIN v ON v.filepath = r2.filepath AND v.a = r2.a WHERE k < len(len))),
p2 AS (SELECT filepath, a, f, t FROM r2 WHERE f IS NOT NULL UNION ALL SELECT r2.filepath, r2.a, s, k FROM r2 JOIN v ON v.filepath = r2.filepath AND v.a = r2.a WHERE k = len(v.len)),
every AS (SELECT filepath, z, CAST(0 AS BIGINT) AS sub, num[1] AS start_line, num[-1] AS end_line, n_chars FROM q WHERE NOT (floor(n_chars / 1.6) + 1 > 440 AND z > a)
  UNION ALL SELECT p2.filepath, v.z, p2.t, num[f], num[t], list_sum(len[f:t]) + t - f FROM p2 JOIN v ON v.filepath = p2.filepath AND v.a = p2.a),
o AS (SELECT filepath, start_line, end_line, n_chars, row_number() OVER (PARTITION BY filepath ORDER BY z, sub) AS part, count(*) OVER (PARTITION BY filepath) AS parts FROM every)
SELECT filepath, part, parts, start_line, end_line, CAST(n_chars AS BIGINT) AS n_chars FROM o
UNION ALL SELECT filepath, 1, 1, 1, len(ls), length(y) FROM b WHERE {_TOKENS.format("y")} <= 440"""


@query("split_oversized", _SPLIT)
def _(spark, d):
    spans = doc_files(spark, d).select("filepath", F.lit("other").alias("language"), F.lit("documentation").alias("doc_category"), F.lit("block").alias("symbol"), F.lit("").alias("parent_symbol"), F.lit("block").alias("type"), F.lit(1).alias("start_line"), X.lines(F.col("content")).alias("body"))
    out = ck.bounded(spans)
    return out.select("filepath", *[F.col(c).cast("bigint").alias(c) for c in ("part", "parts", "start_line", "end_line")], F.char_length("text").cast("bigint").alias("n_chars"))


@query("skeleton_signature")
def _(spark, d):
    return ck.chunk_files(doc_files(spark, d)).select("chunk_id", F.char_length("skeleton").alias("n_chars"))


# written by hand, and stored once for each page
UNIT_FILES = {
    "a.py": "import os\n\n@cache\ndef one(a):\n    return a\n\nclass Two:\n    def three(self):\n        pass\n\nx = 1\n",
    "b.py": "def (",
    "c.js": "x",
    "d.ts": "import x from 'y';\n// function no() {\nexport const f = (a) => {\n  return '}';\n};\nexport interface Shape {\n  side: number;\n}\n",
    "e.go": "package p\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Get() interface{} {\n\treturn t.a\n}\n",
    "f.rs": "use a::b;\nimpl<T> Walk for Tree<T> {\n    fn go(&'a self) {}\n}\npub fn free() -> i32 { 1 }\n",
    "g.java": "class A {\n  int f() { return 1; }\n}\n",
    "h.kt": "fun one(a: Int) = a +\n  1\n\ndata class P(val x: Int)\n",
    "i.dart": "int twice(int a) =>\n    2 * a;\n\nvoid main() {\n  print(twice(2));\n}\n",
    "j.c": "int g(int a);\nstatic int *g2(int a)\n{\n  if (a) { return 0; }\n  return 0;\n}\nstruct s {\n  int b;\n};\n",
}


@query(
    "structural_units",
    """SELECT page_id || '/' || filepath AS filepath, type, symbol, '' AS parent_symbol, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM pages, (VALUES
    ('j.c', 'declaration', 'g', 1, 1), ('a.py', 'decorated_definition', 'one', 3, 5), ('a.py', 'class_definition', 'Two', 7, 9),
    ('d.ts', 'lexical_declaration', 'f', 3, 5), ('d.ts', 'interface_declaration', 'Shape', 6, 8),
    ('e.go', 'type_declaration', 'T', 3, 5), ('e.go', 'method_declaration', 'Get', 7, 9),
    ('f.rs', 'impl_item', 'Walk', 2, 4), ('f.rs', 'function_item', 'free', 5, 5), ('g.java', 'class_declaration', 'A', 1, 3),
    ('h.kt', 'function_declaration', 'one', 1, 2), ('h.kt', 'class_declaration', 'P', 4, 4),
    ('i.dart', 'function_signature', 'twice', 1, 2), ('i.dart', 'function_signature', 'main', 4, 6),
    ('j.c', 'function_definition', 'g2', 2, 6), ('j.c', 'struct_specifier', 's', 7, 9)) AS t(filepath, type, symbol, start_line, end_line)""",
)
def _(spark, d):
    files = for_pages(spark, d, list(UNIT_FILES.items()), "filepath string, content string")
    return ck.structural_units(files.withColumn("filepath", F.concat_ws("/", F.col("page_id").cast("string"), "filepath")))


# source files that stand for rows of pages, in seven languages; $n is the page's number, $k the lines of a body
_FILES = [
    ("js", "// $p {{{\nconst re_$n = /[{(]/;\nfunction f_$n(a) {\n", "  a += 1;  // }\n", "  return `}`;\n}\n"),
    ("c", "static long\nf_$n(int a)\n{\n", "  a += '}';\n", "  return a;\n}\n"),
    ("kt", "fun <T> List<T>.f_$n(): T {\n", '  go("${a("}")} {")\n', "  return this[0]\n}\n"),
    ("py", "@cache\ndef f_$n(a):\n", "    a += 1  # (\n", "    return a\n\nx = [\n  1]\n"),
    ("css", "/* $p { */\n.c_$n > p {\n", "  margin: 0;\n", "}\n"),
    ("json", '{\n  "k_$n": [\n', '    "}",\n', "    1\n  ]\n}\n"),
    ("yaml", "# $p\nk_$n:\n", "- a: |\n    b: c\n", "- end\n"),
]
_FILE_UNITS = [  # language, kind, symbol before and behind the number, first line, last line
    ("js", "lexical_declaration", "re_", "", "2", "2"), ("js", "function_declaration", "f_", "", "3", "5 + k"), ("c", "function_definition", "f_", "", "1", "5 + k"), ("kt", "function_declaration", "f_", "", "1", "3 + k"),
    ("py", "decorated_definition", "f_", "", "1", "3 + k"), ("css", "rule_set", ".c_", " > p", "2", "3 + k"), ("json", "pair", "k_", "", "2", "4 + k"), ("yaml", "document", None, None, "2", "3 + 2 * k"),
]


def page_sources(spark, d) -> DataFrame:
    """A source file for each page; its language goes by the page's number."""
    number, kind = F.col("page_id").cast("string"), F.col("page_id") % len(_FILES)
    path = content = F.lit(None).cast("string")
    for n, (ext, head, line, tail) in enumerate(_FILES):
        text = F.concat(F.lit(head), F.repeat(F.lit(line), (F.col("page_id") % 5).cast("int")), F.lit(tail))
        text = F.replace(F.replace(text, F.lit("$n"), number), F.lit("$p"), F.col("url"))
        path, content = F.when(kind == n, F.concat(F.lit("made/"), number, F.lit(f".{ext}"))).otherwise(path), F.when(kind == n, text).otherwise(content)
    return table(spark, d, "pages").select(path.alias("filepath"), content.alias("content"))


def _file_units() -> str:
    exts = [x[0] for x in _FILES]
    rows = [
        f"""SELECT 'made/' || n || '.{ext}' AS filepath, '{kind}' AS type, {"''" if a is None else f"'{a}' || n || '{b}'"} AS symbol, '' AS parent_symbol, CAST({first} AS INTEGER) AS start_line, CAST({last} AS INTEGER) AS end_line
FROM p WHERE kind = {exts.index(ext)}"""
        for ext, kind, a, b, first, last in _FILE_UNITS
    ]
    return f"WITH p AS (SELECT CAST(page_id AS VARCHAR) AS n, page_id % 5 AS k, page_id % {len(exts)} AS kind FROM pages) " + " UNION ALL ".join(rows)


@query("source_units", _file_units())
def _(spark, d):
    return ck.structural_units(page_sources(spark, d))


_TAGS = mk.TAG.replace("'", "''")
_BOUND, _NEXT, _VOID = (f"[{_in(x)}]" for x in (mk.BOUNDS, mk.ENDS_AT_NEXT, mk.VOID))


@query(
    "page_elements",
    rf"""WITH RECURSIVE pieces AS (SELECT page_id, html, regexp_extract_all(html, '{_TAGS}') AS said, regexp_split_to_array(html, '{_TAGS}') AS gaps FROM pages WHERE html IS NOT NULL),
placed AS (SELECT page_id, said[k] AS said, k, list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(said[:k-1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(said) + 1)) AS k FROM pieces)),
tags AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS k, CAST(s AS BIGINT) AS s, CAST(s + length(said) AS BIGINT) AS e, lower(regexp_extract(said, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag, starts_with(said, '</') AS shuts, ends_with(said, '/>') AS alone
         FROM placed WHERE NOT starts_with(said, '<!--')),
walk AS (SELECT page_id, CAST(0 AS BIGINT) AS k, []::STRUCT(k BIGINT, tag VARCHAR)[] AS open, []::STRUCT(k BIGINT, e BIGINT)[] AS closed, CAST(NULL AS BIGINT) AS depth FROM pieces
  UNION ALL
  SELECT page_id, k, CASE WHEN shuts OR alone OR tag IN ({_in((*mk.VOID, "script", "style"))}) THEN open[:keep] ELSE list_append(open[:keep], {{'k': k, 'tag': tag}}) END,
         list_transform(open[keep + 1:], lambda x: {{'k': x.k, 'e': CASE WHEN shuts AND x.k = open[keep + 1].k THEN e ELSE s END}}), CASE WHEN NOT shuts THEN keep END
  FROM (SELECT *, CASE WHEN above IS NOT NULL AND above > 0 AND (shuts OR tag IN ({_in(mk.ENDS_AT_NEXT)}) AND (bound IS NULL OR bound > above)) THEN len(open) - above ELSE len(open) END AS keep
        FROM (SELECT walk.page_id, t.k, t.s, t.e, t.tag, t.shuts, t.alone, walk.open, list_position(list_reverse(list_transform(walk.open, lambda x: x.tag)), t.tag) AS above,
                     list_min(list_filter(list_transform(range(1, len(walk.open) + 1), lambda i: CASE WHEN walk.open[len(walk.open) - i + 1].tag <> t.tag AND list_contains({_BOUND}, walk.open[len(walk.open) - i + 1].tag) THEN i END), lambda i: i IS NOT NULL)) AS bound
              FROM walk JOIN tags t ON t.page_id = walk.page_id AND t.k = walk.k + 1))),
ends AS (SELECT page_id, c.k AS k, c.e AS e FROM (SELECT page_id, unnest(closed) AS c FROM walk)),
begun AS (SELECT walk.page_id, walk.k, tag, depth, s, e, alone OR tag IN ({_in((*mk.VOID, "script", "style"))}) AS whole FROM walk JOIN tags USING (page_id, k) WHERE depth IS NOT NULL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY begun.k) - 1 AS nth, tag, CAST(depth AS BIGINT) AS depth, s AS start, CASE WHEN whole THEN begun.e ELSE coalesce(ends.e, length(html)) END AS "end"
FROM begun LEFT JOIN ends USING (page_id, k) JOIN pieces USING (page_id)""",
)
def _(spark, d):
    pages = table(spark, d, "pages")
    found = ck.html_elements(pages.select(F.col("page_id").cast("string").alias("filepath"), F.col("html").alias("content")))
    return found.withColumnRenamed("filepath", "page_id").withColumn("page_id", F.col("page_id").cast("bigint"))


@query("chunk_invariants", "SELECT CAST(0 AS BIGINT) AS over_budget, CAST(0 AS BIGINT) AS bad_ranges, CAST(0 AS BIGINT) AS duplicate_ids")
def _(spark, d):
    files = doc_files(spark, d).union(fs.from_pages(table(spark, d, "pages"))).union(fs.from_conversations(table(spark, d, "conversations")))
    return ck.invariants(ck.chunk_files(files), files).drop("chunks")


@query("chunk_token_budget", "SELECT CAST(0 AS BIGINT) AS over_budget, CAST(0 AS BIGINT) AS bad_ranges, CAST(0 AS BIGINT) AS duplicate_ids")
def _(spark, d):
    """As chunk_invariants, with chunks cut and then counted by a tokenizer, tokens around them included."""
    import public_tokenizers

    exact = replace(DEFAULT, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    files = doc_files(spark, d).union(fs.from_pages(table(spark, d, "pages"))).union(fs.from_conversations(table(spark, d, "conversations")))
    return ck.invariants(ck.chunk_files(files, exact, structural=True), files, exact).drop("chunks")


# ---- lexical and dense retrieval


_STORED: dict[tuple[str, str, str], tuple] = {}


def stored(spark, d, name, build):
    """What build(folder) gives, made once a session and folder of tables, and anew when the documents' files change."""
    key = (spark.sparkContext.applicationId, d, name)
    listed = spark.read.format("binaryFile").load(f"{d}/documents.parquet")  # no bytes are read
    stamp = listed.agg(F.hash(F.sort_array(F.collect_list(F.struct("path", "modificationTime", "length"))))).first()[0]
    if key not in _STORED or _STORED[key][0] != stamp:
        if key in _STORED:
            _STORED.pop(key)[1].prune([])
        _STORED[key] = (stamp, *build(ix.working_folder(spark, f"siftwell-{name}")))
    return _STORED[key][1:]


def index(spark, d):
    """Chunks, and the tables of a stored index of them."""
    c = doc_chunks(spark, d)

    def build(folder):
        store = ix.Generations(spark, folder)
        made = store.stage()
        once = c.groupBy("chunk_id").count().where("count > 1").isEmpty()
        store.write(made, "postings", ix.postings(c, unique=once))
        post = spark.read.parquet(f"{store.root}/{made}/postings")
        if once:
            sizes = ix.lengths(c)
        else:
            own = post.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))  # a chunk without terms has no postings
            sizes = c.select("chunk_id").join(own, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        store.write(made, "doc_len", sizes)
        n, mean = spark.read.parquet(f"{store.root}/{made}/doc_len").agg(F.count(F.lit(1)), F.avg("dl")).first()
        store.write(made, "term_stats", ix.term_stats(post, n))
        store.publish(made)
        return store, mean

    store, mean = stored(spark, d, "index", build)
    return c, store.read("postings"), store.read("doc_len").select("chunk_id", "dl"), store.read("term_stats"), mean


def delta_index(spark, d, config=DEFAULT):
    """An index of the earlier snapshot of the documents, and the later one as a delta to it."""

    def build(folder):
        store = dl.Deltas(spark, folder)
        c = doc_chunks(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
        old = F.when(F.col("filepath").contains("/src2/"), F.concat("text", F.lit("."))).otherwise(F.col("text"))
        for rows in (c.where(~F.col("filepath").contains("/src1/")).withColumn("text", old), c.where("lang <> 'es'")):
            at, made = store.versions(), store.stage()
            store.write(made, "scan", rows.select("filepath", F.sha1("text").alias("sha")))  # texts are hashed once
            current = store.table(made, "scan").select("filepath", "sha", "mtime")
            fresh = rows if not at else rows.join(ix.diff(store.read("manifest", at), current).where("status in ('new', 'changed')"), "filepath", "left_semi")
            store.write(made, "chunks", fresh.withColumn("ord", F.lit(0)))
            store.write(made, "vectors", spark.createDataFrame([], schema.VECTORS))  # the documents have none
            versions = store.seal(made, at, current, {}, config)
            store.drop(made, "scan")
            store.publish(versions[-1], *versions[:-1])
        return (store,)

    return stored(spark, d, f"delta-{config.merge_ratio}", build)[0]


# What stands after the delta is the later snapshot, however it came to be.
_AFTER = _INDEX.replace("FROM documents)", "FROM documents WHERE lang <> 'es')")


@query("delta_live_chunks", f"WITH {_NOW} SELECT filepath, sha, 1 AS chunks FROM now")
def _(spark, d):
    store = delta_index(spark, d)
    chunks = store.read("chunks").groupBy("filepath").agg(F.count(F.lit(1)).alias("chunks"))
    return store.read("manifest").select("filepath", "sha").join(chunks, "filepath", "left")


@query("delta_term_stats", f"WITH {_AFTER} SELECT term, df, round(idf, 6) AS idf FROM stats")
def _(spark, d):
    return delta_index(spark, d, replace(DEFAULT, merge_ratio=0.0)).read("term_stats").select("term", "df", F.round("idf", 6).alias("idf"))


@query("delta_bm25_topk", "WITH " + _LEXICAL.format(k=20).replace(_INDEX, _AFTER) + " SELECT chunk_id, round(score, 6) AS score, rank FROM lexr")
def _(spark, d):
    store = delta_index(spark, d, replace(DEFAULT, merge_ratio=0.0))
    mean = store.read("meta").first()["avg_dl"]
    top = se.top_lexical(se.bm25_scores(store.read("postings"), store.read("term_stats"), store.read("doc_len"), TERMS, mean), 20)
    return top.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("bm25_postings", f"WITH {_INDEX} SELECT term, chunk_id, tf FROM post")
def _(spark, d):
    return ix.postings(doc_chunks(spark, d)).select("term", "chunk_id", F.col("tf").cast("bigint").alias("tf"))


@query("bm25_term_stats", f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM stats")
def _(spark, d):
    return index(spark, d)[3].select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_doc_lengths", f"WITH {_INDEX} SELECT chunk_id, dl FROM dl")
def _(spark, d):
    return ix.lengths(doc_chunks(spark, d))


def lexical(spark, d, k):
    _, post, dl, stats, mean = index(spark, d)
    return se.top_lexical(se.bm25_scores(post, stats, dl, TERMS, mean), k)


@query("bm25_topk", f"WITH {_LEXICAL.format(k=20)} SELECT chunk_id, round(score, 6) AS score, rank FROM lexr")
def _(spark, d):
    return lexical(spark, d, 20).select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense(spark, d, k, where=None):
    e = table(spark, d, "embeddings")
    v = e.orderBy("vec_id").select("embedding").first()[0]
    rows = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    return se.top_dense(rows if where is None else rows.where(where), v, k)


@query("knn_topk", f"WITH {_DENSE.format(where='true', k=20)} SELECT chunk_id, round(distance, 6) AS distance, rank FROM denser")
def _(spark, d):
    return dense(spark, d, 20).select("chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("knn_filtered", f"WITH {_DENSE.format(where='label = 3', k=20)} SELECT chunk_id, round(distance, 6) AS distance, rank FROM denser")
def _(spark, d):
    return dense(spark, d, 20, F.col("label") == 3).select("chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


_FUSED = """f AS (SELECT chunk_id, sum({wd} * d + {wl} * l) AS s, min(o) AS o FROM (SELECT chunk_id, 1.0 / (60 + rank + 1) AS d, 0 AS l, rank AS o FROM denser UNION ALL SELECT chunk_id, 0, 1.0 / (60 + rank + 1), 1000000 + rank FROM lexr) GROUP BY chunk_id),
fr AS (SELECT chunk_id, round(s{boost}, 12) AS score, row_number() OVER (ORDER BY round(s{boost}, 12) DESC, o) - 1 AS rank FROM f{join})"""


def _fuse_sql(wd, wl, boost="", join=""):
    return "WITH " + _LEXICAL.format(k=40) + ", " + _DENSE.format(where="true", k=40) + ", " + _FUSED.format(wd=f"CAST({wd} AS DOUBLE)", wl=f"CAST({wl} AS DOUBLE)", boost=boost, join=join)


@query("rrf_textbook", _fuse_sql(1.0, 1.0) + " SELECT chunk_id, round(score, 9) AS score, rank FROM fr")
def _(spark, d):
    return se.fuse(dense(spark, d, 40), lexical(spark, d, 40), (1.0, 1.0)).select("chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("rrf_fuse", _fuse_sql(1.3, 0.8) + " SELECT chunk_id, round(score, 9) AS score, rank FROM fr")
def _(spark, d):
    return se.fuse(dense(spark, d, 40), lexical(spark, d, 40), DEFAULT.weights_natural).select("chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_BOOST = f"(SELECT chunk_id, CASE WHEN lower(symbol) IN ({_in(TERMS)}) THEN 0.6 / 61 WHEN list_has_any({_terms('symbol')}, [{_in(TERMS)}]) THEN 0.3 / 61 END AS boost FROM c WHERE symbol <> '' AND symbol <> 'block')"


@query("symbol_boost", f"WITH {_CORPUS} SELECT chunk_id, round(CAST(boost AS DOUBLE), 9) AS boost FROM {_BOOST} WHERE boost IS NOT NULL")
def _(spark, d):
    return se.symbol_boosts(doc_chunks(spark, d), TERMS).select("chunk_id", F.round("boost", 9).alias("boost"))




@query(
    "candidate_pool_size",
    f"""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT *, unnest([5, 50, 600]) AS top_k FROM g)
SELECT source, top_k, greatest(top_k, least(least(500, n), CAST(floor(top_k * 4 * sqrt(greatest(1.0, n / 2000.0))) AS BIGINT))) AS pool FROM p""",
)
def _(spark, d):
    """How many candidates a search of each source would take from each retriever."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.withColumn("top_k", F.explode(F.array(F.lit(5), F.lit(50), F.lit(600))))
    pool = F.udf(lambda k, n: se.pool_size(k, n, n, None, True), "bigint")  # a few rows
    return asked.select("source", "top_k", pool("top_k", "n").alias("pool"))


@query("hybrid_search", _fuse_sql(1.3, 0.8, " + coalesce(boost, 0)", f" LEFT JOIN {_BOOST} USING (chunk_id)") + " SELECT rank, chunk_id, filepath, lang, round(score, 9) AS score FROM fr JOIN c USING (chunk_id) WHERE rank < 10")
def _(spark, d):
    c = doc_chunks(spark, d)
    both = se.fuse(dense(spark, d, 40), lexical(spark, d, 40), DEFAULT.weights[se.shape_of(QUERY)], se.symbol_boosts(c, TERMS))
    return both.where("rank < 10").join(c, "chunk_id").select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", "filepath", "lang", F.round("score", 9).alias("score"))


# ---- lookups

_WORD_OF = "thing"


@query(
    "symbol_references",
    f"""WITH {_CORPUS}, s AS (SELECT chunk_id, filepath, symbol, text, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w = '{_WORD_OF}')) AS hits FROM c)
SELECT chunk_id, hits, CASE WHEN lower(symbol) = '{_WORD_OF}' THEN 'DEFINITION' WHEN regexp_matches(text, '(^|[^A-Za-z0-9_]){_WORD_OF}\\s*[(<{{]|[''"`]{_WORD_OF}[''"`]') THEN 'call site' ELSE 'mention' END AS kind FROM s WHERE hits > 0""",
)
def _(spark, d):
    return lk.references(doc_chunks(spark, d), _WORD_OF).select("chunk_id", "hits", "kind")


_NAMED = ("thing", "the", "license", "rehethnd", "no_such_symbol_anywhere")


@query(
    "symbol_references_pruned",
    f"""WITH {_CORPUS}, w AS (SELECT chunk_id, symbol, text, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS has, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS ws FROM c WHERE lang <> 'es'),
s AS (SELECT *, unnest([{_in(_NAMED)}]) AS name FROM w)
SELECT name, chunk_id, len(list_filter(ws, lambda x: x = name)) AS hits, CASE WHEN lower(symbol) = name THEN 2 WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])' || name || '\\s*[(<{{]|[''"`]' || name || '[''"`]') THEN 1 ELSE 0 END AS tier
FROM s WHERE list_contains(has, name)""",
)
def _(spark, d):
    """References in a stored index of a base and a delta, by way of its postings."""
    store = delta_index(spark, d, replace(DEFAULT, merge_ratio=0.0))
    at = store.versions()
    chunks, post = store.read("chunks", at), store.read("postings", at)
    rows = [lk.references(lk.holding(chunks, post, s), s).select(F.lit(s).alias("name"), "chunk_id", "hits", "tier") for s in _NAMED]
    return dl.union(rows)


@query(
    "symbol_tiers",
    f"""WITH {_CORPUS}, s AS (SELECT chunk_id, filepath, symbol, text, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w = 'the')) AS hits FROM c),
t AS (SELECT chunk_id, filepath, hits, CASE WHEN lower(symbol) = 'the' THEN 2 WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])the\\s*[(<{{]|[''"`]the[''"`]') THEN 1 ELSE 0 END AS tier FROM s WHERE hits > 0)
SELECT chunk_id, hits, tier FROM t ORDER BY tier DESC, hits DESC, filepath LIMIT 10""",
)
def _(spark, d):
    return lk.ranked_references(lk.references(doc_chunks(spark, d), "the"), 10).select("chunk_id", "hits", "tier")


_GREP = r"[Ll]icen[sc]e|@[a-z]+\.[a-z]+"
_GREP_SQL = f"l AS (SELECT filepath, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM {_lines(_DOCS)}), m AS (SELECT * FROM l WHERE regexp_matches(line, '{_GREP}'))"


@query("grep_lines", f"WITH {_GREP_SQL} SELECT filepath, line_no, line FROM m")
def _(spark, d):
    return lk.grep(doc_files(spark, d), _GREP).select("filepath", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("grep_paged", f"WITH {_GREP_SQL} SELECT filepath, line_no, line, (SELECT count(*) FROM m) AS total, CASE WHEN (SELECT count(*) FROM m) > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM m ORDER BY filepath, line_no LIMIT 40 OFFSET 20")
def _(spark, d):
    return lk.page(lk.grep(doc_files(spark, d), _GREP), 40, 20).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("grep_absent", f"WITH l AS (SELECT unnest(ls) AS line FROM {_lines(_DOCS)}) SELECT count(*) AS matches FROM l WHERE regexp_matches(line, 'no_such_symbol_anywhere')")
def _(spark, d):
    return lk.grep(doc_files(spark, d), "no_such_symbol_anywhere", "*.txt").agg(F.count(F.lit(1)).alias("matches"))


@query("chunk_lookup", f"WITH {_CORPUS} SELECT chunk_id, filepath, symbol, text FROM c WHERE chunk_id = '17'")
def _(spark, d):
    return lk.chunk(doc_chunks(spark, d), "17").select("chunk_id", "filepath", "symbol", "text")


@query("chunk_lookup_nearby", f"WITH {_CORPUS} SELECT chunk_id FROM (SELECT filepath || ':block:1-1' AS chunk_id FROM c) WHERE starts_with(chunk_id, 'docs/en/src1') ORDER BY chunk_id LIMIT 8")
def _(spark, d):
    c = doc_chunks(spark, d).withColumn("chunk_id", F.concat("filepath", F.lit(":block:1-1")))
    return lk.nearby(c, "docs/en/src1:gone:1-2")


@query(
    "file_context",
    f"""WITH f AS {_lines(_DOCS)}, t AS (SELECT filepath, ls, len(ls) AS n, 2 AS s, greatest(2, least(len(ls), 5)) AS e FROM f)
SELECT filepath, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", CAST(n AS BIGINT) AS total_lines, 'ok' AS status,
coalesce(array_to_string(list_transform(CASE WHEN s <= n THEN ls[s:e] ELSE []::VARCHAR[] END, lambda x, i: printf('%5d  %s', i + s - 1, x)), chr(10)), '') AS body FROM t""",
)
def _(spark, d):
    files = doc_files(spark, d)
    targets = files.select("filepath", F.lit(2).alias("first"), F.lit(5).alias("last"))
    return lk.file_context(files, targets)


@query("status_languages", f"SELECT {_LANG} AS language, count(*) AS chunks FROM ({_DOCS} UNION ALL {_PAGES} UNION ALL {_CHATS}) GROUP BY 1")
def _(spark, d):
    files = doc_files(spark, d).union(fs.from_pages(table(spark, d, "pages"))).union(fs.from_conversations(table(spark, d, "conversations")))
    return lk.language_counts(files.select(fs.language_of(fs.extension(F.col("filepath"))).alias("language")))


@query("status_counts", "SELECT lang AS language, count(*) AS chunks, count(DISTINCT source) AS sources, max(length(text)) AS longest FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"), F.max(F.char_length("text")).cast("bigint").alias("longest"))


@query(
    "freshness",
    f"""WITH m AS (SELECT *, 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS filepath FROM documents),
r AS (SELECT filepath, CASE WHEN source <> 'src1' THEN 0 END AS t, CASE WHEN lang <> 'es' THEN CASE WHEN source = 'src2' THEN 5 WHEN source = 'src3' THEN 1 ELSE 0 END END AS n FROM m WHERE source <> 'src1' OR lang <> 'es')
SELECT count(*) FILTER (n - t > 1) AS changed_count, count(*) FILTER (n IS NULL) AS missing_count, count(*) FILTER (t IS NULL) AS added_count,
(SELECT coalesce(list(filepath ORDER BY filepath), []) FROM (SELECT filepath FROM r WHERE n - t > 1 ORDER BY filepath LIMIT 5)) AS changed FROM r""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filepath"))
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    later = F.when(F.col("source") == "src2", F.expr("interval 5 seconds")).when(F.col("source") == "src3", F.expr("interval 1 seconds")).otherwise(F.expr("interval 0 seconds"))
    return lk.freshness(docs.where("source <> 'src1'").withColumn("mtime", base), docs.where("lang <> 'es'").withColumn("mtime", base + later))


@query(
    "eval_recall_mrr",
    f"""WITH {_INDEX}, b AS (SELECT item_id, {_terms("text")} AS ts FROM benchmark), q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(ts) AS term FROM b) GROUP BY ALL),
s AS (SELECT item_id, chunk_id, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 9) AS score FROM q JOIN post USING (term) JOIN stats USING (term) JOIN dl USING (chunk_id) GROUP BY ALL),
r AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10),
g AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
p AS (SELECT g.item_id, count(*) AS relevant, count(r.rank) AS found, coalesce(max(1.0 / r.rank), 0) AS rr FROM g LEFT JOIN r USING (item_id, chunk_id) GROUP BY g.item_id)
SELECT count(*) AS queries, round(avg(found / relevant), 6) AS recall_at_10, round(CAST(avg(rr) AS DOUBLE), 6) AS mrr FROM p""",
)
def _(spark, d):
    c, post, dl, stats, mean = index(spark, d)
    bench = table(spark, d, "benchmark")
    q = bench.select("item_id", F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    ranked = se.top_many(post, stats, dl, q, mean, 10)
    # a document that holds a passage holds its inner words; those of the rarest are read and looked into
    words = F.regexp_extract_all("text", F.lit(X.WORD), F.lit(0))
    inner = bench.select("item_id", F.explode(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), F.lower)).alias("term")).distinct()
    rarest = inner.join(stats, "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = rarest.join(post.drop("bucket"), "term").select("item_id", "chunk_id").join(c.select("chunk_id", "text"), "chunk_id")
    near = near.unionByName(bench.where(F.size(words) < 3).select("item_id").join(c.select("chunk_id", "text")))  # too short to have inner words
    gold = near.join(bench.withColumnRenamed("text", "passage"), "item_id").where(F.col("text").contains(F.col("passage"))).select("item_id", "chunk_id")
    return metrics.recall_and_mrr(ranked, gold, "item_id", "chunk_id", 10)
