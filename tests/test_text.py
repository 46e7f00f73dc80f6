import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import search as se

WORDS = {
    "HTTPServer": "httpserver http server", "getX2": "getx2 get x 2", "X2y": "x2y x 2y", "Foo_Bar": "foo_bar foo bar foo bar", "FOO_BAR": "foo_bar foo bar",
    "my_fooBar": "my_foobar my foobar my foo bar", "__init__": "__init__ init", "_": "_", "123": "123", "a1b2": "a1b2", "users.expires_at": "users expires_at expires at", "Straße": "stra e", "": "",
}
SHAPES = {
    "refresh_access_token": "identifier", "sendMessage": "identifier", "token": "mixed", "users.expires_at": "mixed", "where do we validate expired sessions": "natural",
    "how does auth": "mixed", "": "mixed", "  ": "mixed", "averyverylongword": "identifier", "How does it work?": "natural",
}


def test_tokenize(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", X.tokenize(F.col("w")).alias("t")).collect()
    assert {r.w: " ".join(r.t) for r in rows} == WORDS
    assert {w: " ".join(se.terms_of(w)) for w in WORDS} == WORDS


@given(st.lists(st.text(alphabet="aB_9 xYZ.é", max_size=12), max_size=30))
def test_tokenize_driver_rule_splits_words(words):
    for w in words:
        assert all(t == t.lower() for t in se.terms_of(w))


def test_query_shape(spark):
    rows = spark.createDataFrame([(w,) for w in SHAPES], "w string").select("w", X.query_shape(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == SHAPES
    assert {w: se.shape_of(w) for w in SHAPES} == SHAPES


def test_estimates(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (0, 3, 703, 704)], "t string").select(X.token_estimate(F.col("t")).alias("n"), X.split_budget(F.col("t")).alias("b")).collect()
    assert [r.n for r in rows] == [1, 2, 235, 441]
    assert rows[3].b in (667, 668)


def test_lines(spark):
    rows = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("",), ("\n",), ("a\n\n",)], "t string").select(X.lines(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [["a", "b"], ["a", "b"], [], [""], ["a", ""]]


@pytest.mark.parametrize("args,pool", [((10, 1840, 161, None, False), 40), ((10, 2000, 200, 5, True), 100), ((10, 64000, 4000, None, False), 226), ((10, 64000, 4000, 50, True), 500), ((10, 2000, 200, 20, False), 500), ((5, 3, 1, None, False), 5)])
def test_pool(args, pool):
    assert se.pool_size(*args) == pool


def test_prefix():
    assert X.query_prefix("intfloat/e5-small") == "query: "
    assert X.query_prefix("gte-small") == ""
    assert X.query_prefix("BAAI/bge-small-en-v1.5").endswith("passages: ")
