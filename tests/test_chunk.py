from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.operators import chunk as ck


def spans(spark, n):
    body = F.array(*[F.lit(f"line {i}") for i in range(n)]) if n else F.array().cast("array<string>")
    rows = ck.window_spans(spark.range(1).select(F.lit("a.txt").alias("filepath"), F.lit(1).alias("start_line"), body.alias("body"))).collect()
    return [(r.start_line, r.start_line + len(r.body) - 1) for r in sorted(rows, key=lambda r: r.start_line)]


@pytest.mark.parametrize("n,want", [(0, []), (3, []), (39, [(1, 39)]), (40, [(1, 40), (33, 40)]), (41, [(1, 40), (33, 41)]), (72, [(1, 40), (33, 72), (65, 72)]), (73, [(1, 40), (33, 72), (65, 73)])])
def test_windows(spark, n, want):
    assert spans(spark, n) == want


def test_cut():
    lines = ["a" * 300, "b" * 300, "c" * 300, "d" * 700, "e" * 10]
    parts = ck.cut(lines, 668)
    assert [(a, b) for a, b, _ in parts] == [(0, 1), (2, 2), (3, 3), (3, 4)]
    assert [len(x) for x in parts[3][2]] == [32, 10]


@given(st.lists(st.text(alphabet="ab\t ", max_size=90), max_size=40), st.integers(10, 120))
def test_cut_keeps_everything(lines, budget):
    parts = ck.cut(lines, budget)
    # a part is within budget, or else what it carries over and one line
    assert all(sum(len(x) + 1 for x in p) <= max(budget, int(0.12 * budget) + 3 + budget + 1) for _, _, p in parts)
    assert all(0 <= a <= b < len(lines) for a, b, _ in parts)
    if parts:  # every line lies in a part
        assert {i for a, b, _ in parts for i in range(a, b + 1)} == set(range(len(lines)))


def test_skeleton():
    assert ck.skeleton("a\nb") == "a\nb"
    text = "# note\n\ndef run(a,\n        b):\n    x = 1\n\n    # no\n    y = 2\n    return x\n)\nz = 3\nend"
    assert ck.skeleton(text, "run") == "# note\n\ndef run(a,\n        b):\n    x = 1\n    y = 2\n    return x\n... [5 more lines -- get_chunk_content for full body] ..."
    assert ck.signature_span(["f(", "a", ")"], 0) == 3
    assert ck.signature_span(["f(", "a", "b", "c", ")"], 0) == 1


FILES = [
    ("src/one.py", "import os\nimport sys\nimport re\nimport json\n\ndef first(a):\n    return a\n\nclass Second:\n    pass\n"),
    ("src/three.ts", "a\nb\nc\n"),
    ("docs/x.md", "intro\n# One\ntext\n## Two `x`\nmore\n"),
    ("sql/s.sql", "create table t (\n a int,\n b int,\n c int\n);\n"),
    ("blank.txt", " \n\n"),
    ("long.txt", "x" * 5000),
    ("forty.txt", "\n".join(f"l{i}" for i in range(40))),
]


@pytest.mark.parametrize("structural", [False, True])
def test_chunk_files(spark, structural):
    files = spark.createDataFrame(FILES, "filepath string, content string")
    chunks = ck.chunk_files(files, structural=structural)
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert "docs/x.md:section:1-1" in rows and "docs/x.md:One:2-3" in rows and "docs/x.md:Two x:4-5" in rows
    assert not any(i.startswith(("src/three.ts", "blank.txt")) for i in rows)
    assert "sql/s.sql:t:1-5" in rows
    assert {"forty.txt:block:1-40", "forty.txt:block:33-40"} <= set(rows)
    assert not any(i.startswith("long.txt") for i in rows)  # one line is fewer than four
    if structural:
        assert rows["src/one.py:first:6-7"].type == "function_definition" and "src/one.py:Second:9-10" in rows and "src/one.py:block:1-5" in rows
    assert ck.invariants(chunks, files).select("over_budget", "bad_ranges", "duplicate_ids").first()[:] == (0, 0, 0)


def test_exact_budgets(spark):
    """With a tokenizer no chunk is over the budget, however dense its text is, and no line is lost."""
    import public_tokenizers

    from siftwell.functions import text as X
    from siftwell.functions import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    dense = "\n".join("".join(chr(0x4E00 + 37 * (i * 50 + j) % 9000) for j in range(50)) for i in range(60))
    rows = [("cjk.txt", dense), ("one.txt", "\U0001f9ff" * 3000 + "\nx\ny\nz"), ("plain.txt", "some words of text\n" * 300), ("short.txt", "a\nb\nc\nd")]
    files, exact = spark.createDataFrame(rows, "filepath string, content string"), replace(ck.DEFAULT, tokenizer=path)
    chunks = ck.chunk_files(files, exact)
    got = [(r.filepath, r.start_line, r.end_line, r.text) for r in chunks.collect()]
    assert max(tokens.count(t, path) for *_, t in got) <= exact.chunk_tokens < max(tokens.count(r.text, path) for r in ck.chunk_files(files).collect())
    assert ck.invariants(chunks, files, exact).select("over_budget", "bad_ranges", "duplicate_ids").first()[:] == (0, 0, 0)
    for name, content in rows:
        assert {n for f, a, b, _ in got if f == name for n in range(a, b + 1)} == set(range(1, content.count("\n") + (not content.endswith("\n")) + 1))
    few = spark.createDataFrame([(t,) for t in ["", None, "a b", dense, "x" * 400]], "t string")
    counted = [tuple(r) for r in few.select("t", X.token_count(F.col("t"), exact), X.token_estimate(F.col("t"), exact)).collect()]
    assert [c for _, c, _ in counted] == [None if t is None else tokens.count(t, path) for t, *_ in counted]
    assert [e for *_, e in counted] == [1, None, 2, tokens.count(dense, path), 134]
    with pytest.raises(ValueError, match="digest"):
        tokens.tokenizer(path, "0" * 64)


def _odd_texts(n):
    import random

    rng = random.Random(7)
    bits = ["a", "The", "é", "É", "e\u0301", "\u0301", "'s", " 's", "'", "ll", "<|endoftext|>", "<|ENDofTEXT|>", "<|endoftext", "|>", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "\r", "\n", "\t", " ", "  ", "1", "２", "Σ", "ΑΣ", "ǅ", "İ", "ß", "µ", "ª", "一", "!", ".", ",", "...", "_", "\u200d", "\U0001f9ff", "\u180e", "\ufeff", "\u212a", "\u212b", "가", "x" * 70]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name,by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_counts_are_those_of_the_tokenizer(name, by_words, monkeypatch):
    """Words are told apart where the vocabulary's rules allow it alone, and forgetting words changes no count."""
    import public_tokenizers

    from siftwell.functions import tokens

    monkeypatch.setattr(tokens, "_WORDS", 300)
    made = tokens.Counter(tokens.tokenizer(public_tokenizers.path(name)))
    assert made.words == by_words
    texts = [*_odd_texts(5000), "x" * 9000 + " " + "words, of text. " * 4000, ""]
    want = [len(e) for e in made.tok.encode_batch_fast(texts)]
    assert made.counts(texts) == want and [made.counts([t])[0] for t in texts[::-1]] == want[::-1]


def test_the_tokenizer_sees_a_word_once():
    import public_tokenizers

    from siftwell.functions import tokens

    class Told:
        def __init__(self, tok):
            self.tok, self.chars = tok, 0

        def encode_batch_fast(self, texts, **given):
            self.chars += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **given)

        def __getattr__(self, name):
            return getattr(self.tok, name)

    tok = Told(tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    made, words = tokens.Counter(tok), [f"{a}{b}" for a in ("some", "more", "last") for b in ("how", "thing", "où")]
    texts = [" ".join(words[k:] + words[:k]) + ".\n" for k in range(9)] * 50
    for _ in range(2):
        assert made.counts(texts) == [len(e) for e in tok.tok.encode_batch_fast(texts)]
    assert tok.chars <= sum(len(w) + 1 for w in words) + 1

    class Kept(dict):
        def __iter__(self):
            raise AssertionError("all kept words are walked through")

    made.old, made.known = Kept(made.known), {"": 0}  # as after very many words
    assert made.counts(texts[:2] + ["new"]) == [len(e) for e in tok.tok.encode_batch_fast(texts[:2] + ["new"])]


def test_units_are_found_once(spark):
    """Units and the lines between them come from one pass over a file."""
    files = spark.createDataFrame(FILES, "filepath string, content string")
    plan = ck.chunk_files(files, structural=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_collisions_get_numbers(spark):
    text = "# A\n# A\n"
    files = spark.createDataFrame([("a.md", text)], "filepath string, content string")
    ids = [r.chunk_id for r in ck.chunk_files(files).orderBy("ord").collect()]
    assert ids == ["a.md:A:1-1", "a.md:A:2-2"]


def test_symbols(spark):
    rows = [('CREATE POLICY "read own" ON t', "read own"), ("alter table public.users add x int", "public.users"), ("select 1", ""), ("CREATE OR REPLACE FUNCTION a.b()", "a.b")]
    got = spark.createDataFrame(rows, "t string, s string").select("s", ck.sql_symbol(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [r.s for r in got]
    assert spark.range(1).select(ck.dart_symbol(F.lit("  Future<int> load(String a) {"))).first()[0] == "load"


def test_sql_by_statement_and_dart_symbols(spark):
    sql = "-- head\nCREATE TABLE a (\n  x int\n);\nINSERT INTO a VALUES (1);\nCREATE VIEW b AS\nSELECT 1;\n"
    dart = "import 'x.dart';\nFuture<void> load(int n) async {\n  return;\n}\n" + "  // more\n" * 4
    out = ck.chunk_files(spark.createDataFrame([("m.sql", sql), ("w.dart", dart)], "filepath string, content string"))
    got = {(r.filepath, r.symbol, r.start_line, r.end_line) for r in out.collect()}
    assert {("m.sql", "a", 2, 4), ("m.sql", "b", 6, 7)} <= got
    assert any(f == "w.dart" and s == "load" for f, s, _, _ in got)
    assert sum(e - b + 1 for f, _, b, e in got if f == "m.sql") == 7  # every line in one statement


def test_units():
    from siftwell.operators.structure import units
    from siftwell.queries import UNIT_FILES

    got = {f: [(u.kind, u.symbol, u.first, u.last) for u in units(x, UNIT_FILES[f], 10**6)] for f, x in (("f.rs", "rust"), ("i.dart", "dart"), ("j.c", "c"), ("b.py", "python"))}
    assert got["f.rs"] == [("impl_item", "Walk", 2, 4), ("function_item", "free", 5, 5)]
    assert got["i.dart"] == [("function_signature", "twice", 1, 2), ("function_signature", "main", 4, 6)]
    assert got["j.c"] == [("declaration", "g", 1, 1), ("function_definition", "g2", 2, 6), ("struct_specifier", "s", 7, 9)]
    assert got["b.py"] == [] == units("ruby", "def a\nend\n", 9)


def test_units_over_the_budget():
    from siftwell.operators.structure import units

    java = "@Table\npublic class Big {\n  private int a;\n  Big(int a) {\n    this.a = a;\n  }\n  @Override\n  public int get() {\n    return a;\n  }\n}\n"
    got = [tuple(u) for u in units("java", java, 40)]
    assert got == [("class_declaration_header", "Big", "", 1, 3), ("constructor_declaration", "Big", "Big", 4, 6), ("method_declaration", "get", "Big", 7, 10)]
    assert [tuple(u) for u in units("java", java, 10**6)] == [("class_declaration", "Big", "", 1, 11)]
    python = "class Two:\n    def three(self):\n        pass\n\n    def four(self):\n        pass\n"
    assert [tuple(u) for u in units("python", python, 20)] == [("function_definition", "three", "Two", 2, 3), ("function_definition", "four", "Two", 5, 6)]


def test_units_take_time_in_proportion():
    import time

    from siftwell.operators.structure import units

    start = time.monotonic()
    assert len(units("javascript", "function f(a) {\n  if (a) { g({b: [1]}); }\n}\n" * 20_000, 10**6)) == 20_000
    assert units("java", "{" * 200_000, 9) == [] == units("c", " " * 20_000 + "x(" * 2000, 9)
    assert time.monotonic() - start < 20


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_once_and_units_need_no_join(spark):
    text = "<html>\n<body>\n<p>a</p>\n" + "\n".join(f"<p>{n} words</p>" for n in range(90)) + "\n</body></html>\n"
    files = spark.createDataFrame([("a.html", text), ("b.txt", "x\n" * 50), ("a.html", "one\ntwo\nthree\nfour")], "filepath string, content string")
    made = ck.chunk_files(files, structural=True)
    assert "Join" not in plan(made)
    assert plan(ck.invariants(ck.chunk_files(files), files)).count("MapIn") == 1
    bad = spark.createDataFrame([("a.html", "i", 1, 9, "x" * 9000), ("b.txt", "i", 0, 1, ""), ("b.txt", "j", 1, 50, "")], "filepath string, chunk_id string, start_line int, end_line int, text string")
    assert ck.invariants(bad, files).first().asDict() == {"over_budget": 2, "bad_ranges": 2, "chunks": 4, "duplicate_ids": 1}  # a.html is there twice


def test_lone_spans_are_cut_without_a_shuffle(spark):
    rows = [(f"f{n}.txt", "other", "documentation", "block", "", "block", 1, [f"line {k} of {n}, with more words" for k in range(60 * n)]) for n in range(1, 4)]
    spans = spark.createDataFrame(rows, ck.SPAN)
    lone = ck.bounded(spans, lone=True)
    assert "Exchange" not in lone._jdf.queryExecution().executedPlan().toString()
    assert sorted(lone.collect()) == sorted(ck.bounded(spans).collect())
