from collections import Counter
from dataclasses import replace

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.config import DEFAULT
from siftwell.functions import terms
from siftwell.functions import text as X
from siftwell.operators import index as ix
from siftwell.operators import lookup as lk
from siftwell.operators import search as se

CORPUS = ["get user token", "user user name", "token refresh x y z", "foo bar"]


def scores(spark, corpus, terms):
    c = spark.createDataFrame([(str(i), t) for i, t in enumerate(corpus)], "chunk_id string, text string")
    post, dl = ix.postings(c, F.col("text")), ix.lengths(c, F.col("text"))
    n, mean = dl.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return {r.chunk_id: r.score for r in se.bm25_scores(post, ix.term_stats(post, n), dl, terms, mean).collect()}


def test_bm25(spark):
    got = scores(spark, CORPUS, ["token", "refresh"])
    assert got["2"] == pytest.approx(0.682035, abs=1e-6)
    assert got["0"] == pytest.approx(0, abs=1e-12)  # half of all hold it: idf is 0
    twice = scores(spark, CORPUS, ["refresh", "refresh"])
    assert twice["2"] == pytest.approx(2 * 0.682035, abs=1e-6)
    assert scores(spark, ["a b"], ["a"])["0"] == pytest.approx(-0.274653, abs=1e-6)
    assert scores(spark, CORPUS, ["absent"]) == {}


def ranks(spark, ids, column="score"):
    return spark.createDataFrame([(c, r) for r, c in enumerate(ids)], "chunk_id string, rank int")


def test_fuse(spark):
    rows = se.fuse(ranks(spark, "ABC"), ranks(spark, "CDA"), (0.7, 1.4)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["C", "A", "D", "B"]
    assert [round(r.score, 8) for r in rows] == [0.03406193, 0.03369763, 0.02258065, 0.01129032]
    tie = se.fuse(ranks(spark, "AB"), ranks(spark, "CD"), (1.0, 1.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["A", "C", "B", "D"]


def test_boosts(spark):
    c = spark.createDataFrame([("1", "db.refreshToken"), ("2", "refresh_token"), ("3", "block"), ("4", "other"), ("5", "Refresh")], "chunk_id string, symbol string")
    got = {r.chunk_id: r.boost for r in se.symbol_boosts(c, ["refresh"]).collect()}
    unit = 0.6 / 61
    assert got == {"1": pytest.approx(unit / 2), "2": pytest.approx(unit / 2), "5": pytest.approx(unit)}
    assert se.symbol_boosts(c, []).count() == 0


def test_dense_filters_before_it_ranks(spark):
    v = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    rows = se.top_dense(v, [1.0, 0.0], 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.distance) for r in rows] == [("b", 0.0), ("c", 0.0)]
    assert se.top_dense(v.where("chunk_id = 'a'"), [1.0, 0.0], 2).first().distance == 2.0


def test_rerank(spark):
    chunks = spark.createDataFrame([(c, c * 3) for c in "ABC"], "chunk_id string, text string")
    rows = se.rerank(ranks(spark, "ABC"), chunks, lambda q, texts: [ord(t[0]) for t in texts], "q").orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["C", "B", "A"]


def test_references(spark):
    rows = [("1", "db.load", "x load(y)"), ("2", "f", "call load (1) and load"), ("3", "g", "about load here"), ("4", "g", "reload loads"), ("5", "g", 'rpc("load")'), ("6", "h", "LOAD")]
    c = spark.createDataFrame(rows, "chunk_id string, symbol string, text string")
    got = {r.chunk_id: (r.kind, r.hits) for r in lk.references(c, "load").collect()}
    assert got == {"1": ("DEFINITION", 1), "2": ("call site", 2), "3": ("mention", 1), "5": ("call site", 1), "6": ("mention", 1)}


def test_grep_pages_in_a_total_order(spark):
    files = spark.createDataFrame([("b.txt", "x1\nno\nx2\n"), ("a.py", "x3\n")], "filepath string, content string")
    first = lk.page(lk.grep(files, r"x\d"), 2, 0).collect()
    assert [(r.filepath, r.line_no, r.total, r.next_offset) for r in first] == [("a.py", 1, 3, 2), ("b.txt", 1, 3, 2)]
    assert [(r.line_no, r.next_offset) for r in lk.page(lk.grep(files, r"x\d"), 2, 2).collect()] == [(3, None)]
    assert lk.grep(files, "x", "*.py").count() == 1
    with pytest.raises(Exception, match="(?i)regexp|pattern"):
        lk.grep(files, "(")


def test_file_context(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"l{i}" for i in range(1, 11)))], "filepath string, content string")
    targets = spark.createDataFrame([("a.py", 8, None), ("a.py", 50, None), ("no.py", 1, 2), ("../a.py", 1, 2), (None, 1, 2), ("a.py", None, 2)], "filepath string, first int, last int")
    rows = [(r.filepath, r.start, r.end, r.total_lines, r.status, r.body) for r in lk.file_context(files, targets).collect()]
    assert ("a.py", 8, 10, 10, "ok", "    8  l8\n    9  l9\n   10  l10") in rows
    assert ("a.py", 50, 50, 10, "ok", "") in rows
    assert ("a.py", 1, 2, 10, "ok", "    1  l1\n    2  l2") in rows
    assert {r[4] for r in rows} == {"ok", "not found", "outside root", "missing path"}


def test_idf_is_floored_at_a_share_of_the_mean(spark):
    c = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a d")], "chunk_id string, text string")
    post = ix.postings(c, F.col("text"))
    idf = {r.term: r.idf for r in ix.term_stats(post, 3).collect()}
    raw = {"a": math.log(0.5) - math.log(3.5), **{t: math.log(2.5) - math.log(1.5) for t in "bcd"}}
    assert idf["a"] == pytest.approx(0.25 * sum(raw.values()) / 4) and idf["b"] == pytest.approx(raw["b"])


def test_counts_are_those_of_tokenize_and_need_no_shuffle(spark):
    texts = ["HTTPServer get_x2 getX2 the the __init__ _", "", None, "Straße Foo_Bar FOO_BAR Kelvin", " 12 a1b2 "]
    c = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "chunk_id string, text string")
    made = ix.postings(c, F.col("text"), unique=True)
    want = c.select("chunk_id", F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("term", "chunk_id").count()
    assert sorted(tuple(r) for r in made.select("term", "chunk_id", "tf").collect()) == sorted(tuple(r) for r in want.collect())
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    twice = ix.postings(c.union(c), F.col("text"))  # ids that are not unique are added up
    assert sorted((r.term, r.chunk_id, r.tf) for r in twice.collect()) == sorted((t, i, 2 * n) for t, i, n in want.collect())


def test_best_of_many_queries_by_blocks_and_parts(spark):
    """Blocks of queries and parts of chunks give what all scores give; what is scored is not shuffled."""
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(words[(n * k) % 5] for k in range(n % 7)) for n in range(60)]
    c = spark.createDataFrame([(f"c{n}", t, "ab"[n % 2] if n % 11 else None) for n, t in enumerate(texts)], "chunk_id string, text string, lang string")
    post, dl = ix.postings(c, F.col("text")), ix.lengths(c, F.col("text"), keep=(F.col("lang"),))
    stats, mean = ix.term_stats(post, 60), dl.agg(F.avg("dl")).first()[0]
    asked = spark.createDataFrame([(i, w, 1 + i % 2) for i in range(9) for w in words[i % 3 : i % 3 + 1 + i % 4]], "item_id bigint, term string, times bigint")
    full = se.bm25_many(post, stats, dl, asked, mean, carry=("lang",)).withColumn("score", F.round("score", 9)).where("score > 0")
    for by in (None, "lang"):
        w = Window.partitionBy("item_id", *([by] if by else [])).orderBy(F.desc("score"), "chunk_id")
        want = full.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("item_id", "chunk_id", F.round("score", 6), "matched", "rank")
        for config in (DEFAULT, replace(DEFAULT, queries_per_block=2, postings_per_part=10)):
            got = se.top_many(post, stats, dl, asked, mean, 4, by, config).select("item_id", "chunk_id", F.round("score", 6), "matched", "rank")
            assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) and want.count()
    none = se.top_many(post, stats, dl, asked.limit(0), mean, 4)
    assert none.count() == 0
    few = se.top_many(post, stats, dl.where("chunk_id = 'c9'"), asked, mean, 4)  # other chunks are not scored
    assert {r.chunk_id for r in few.collect()} <= {"c9"}


def test_best_of_many_queries_by_counted_chunks(spark):
    """Chunks that come with their terms are scored where they are read; only the best of each part are shuffled."""
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(words[(n * k) % 5] for k in range(n % 7)) for n in range(60)] + [None]
    c = spark.createDataFrame([(f"c{n}", t, "ab"[n % 2] if n % 11 else None) for n, t in enumerate(texts)], "chunk_id string, text string, lang string")
    counted = terms.counted(c, F.col("text")).drop("text").coalesce(2)
    post, dl = ix.postings(c, F.col("text")), ix.lengths(c, F.col("text"), keep=(F.col("lang"),))
    stats, mean = ix.term_stats(post, 60), dl.agg(F.avg("dl")).first()[0]
    asked = spark.createDataFrame([(i, w, 1 + i % 2) for i in range(9) for w in words[i % 3 : i % 3 + 1 + i % 4]], "item_id bigint, term string, times bigint")
    kept = lambda rows: sorted(tuple(r) for r in rows.select("item_id", "chunk_id", F.round("score", 6), "matched", "rank").collect())
    for by in (None, "lang"):
        want = kept(se.top_many(post, stats, dl, asked, mean, 4, by))
        for config in (DEFAULT, replace(DEFAULT, postings_per_part=1), replace(DEFAULT, broadcast_rows=3)):
            assert kept(se.top_counted(counted, stats, asked, mean, 4, by, config)) == want and want
    plan = se.top_counted(spark.createDataFrame(counted.collect(), counted.schema), stats, asked, mean, 4, "lang")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert se.top_counted(counted, stats, asked.limit(0), mean, 4).count() == 0
    assert se.top_counted(counted.limit(0), stats, asked, mean, 4).count() == 0


@given(st.lists(st.sampled_from(["a", "The", "é", "\u212a", "\u0130", "_", "__", "A", "AB", "ABc", "aB", "1", "12", "9a", "a9", "9A", " ", "\n", ".", "x9Y", "²", "src1/22.txt"]), max_size=9).map("".join))
def test_counts_of_a_text_are_those_of_its_terms(text):
    assert dict(terms.counts_of(text)) == dict(Counter(terms.terms_of(text)))
