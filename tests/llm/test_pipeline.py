"""The pipeline against a brute-force version of its stages after the classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm.quality import fit_quality, score_quality
from tests.conftest import DATA
from tests.llm.test_jaccard import brute as components


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def brute(docs):
    """{doc_id: text} after exact dedup, near dedup and passage removal."""
    groups = {}
    for i, t in docs:
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), i))
    kept = {min(g)[1] for g in groups.values()}
    docs = [(i, t) for i, t in docs if i in kept]
    smallest = {i: c for i, _, c in components(docs, 5, 80)}
    docs = [(i, t) for i, t in docs if smallest[i] == i]
    seen = Counter(tuple(w[j : j + 35]) for w in (words(t) for _, t in docs) for j in range(len(w) - 34))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = {p for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        out[i] = t if not gone else " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_next = stage(spark, docs, DATA)
        assert docs_next.columns == docs.columns and docs_next.dtypes == docs.dtypes
        docs = docs_next
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = [(r.doc_id, r.text) for r in score_quality(docs, model).where("score >= 0.3").collect()]
    want = brute(good)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert zlib.crc32(b"".join(b for _, b in sorted(pieces[i]))) == zlib.crc32(ids)


def test_repeated_and_null_ids(spark):
    """A document on several rows stays once; a row that shares a removed near copy's id stays."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (3, c + " more"), (3, d), (None, e), (None, e + " more")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(3)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, DATA)
    got = Counter((r.doc_id, r.text) for r in docs.collect())
    assert set(got.values()) == {1} and len(got) == 5
    assert {(1, a), (None, b), (2, c), (3, d)} < set(got) and set(got) & {(None, e), (None, e + " more")}


EDGE = [(1, "one two three"), (2, None), (3, ""), (4, "onetwothree"), (5, " "), (6, "w " * 5000), (7, "q" * 20_000), (8, "!!! 123")]


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows_and_clashing_names(spark, k):
    """Null, empty and long texts, and columns that are named like what operators make: no stage fails or loses values."""
    kind = "doc_id bigint, text string, n_chars bigint, kept string, group_size string, keep_id string, row string, score string, kept_text string, n_words string, block string, component_id string, __score string"
    names = [c.split()[0] for c in kind.split(", ")]
    rows = [(i, t, len(t or ""), *(f"{c}{i}" for c in names[3:])) for i, t in EDGE]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kind).repartition(2)
        out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = {r.doc_id: r for r in out.collect()}
        assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in names[3:])
        if k == 1 and given:  # the longest of equal texts; null, empty and blank texts are equal
            assert set(got) == {1, 5, 6, 7, 8}
        if k in (2, 3) and given:
            assert set(got) == {i for i, _ in EDGE} and [got[i].text for i in (1, 2, 3, 5)] == ["one two three", None, "", " "]
        if k == 3 and given:
            assert got[6].text == "" and got[6].n_chars == 0
    packed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(rows, kind), DATA)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in EDGE}


@pytest.mark.parametrize("most", [0, 500_000])
def test_near_copies_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline.common, "BROADCAST_ROWS", most)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, DATA).collect()}
    assert got == {i for i, _, c in components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if c == i}
