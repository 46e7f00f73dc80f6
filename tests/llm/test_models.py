"""Language identification and the quality classifier: held-out accuracy, edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm.language import DIM, counts, fit_language, predict_language
from siftwell.llm.quality import BINS, FEATURES, RIDGE, fit_quality, held_out, isotonic, score_quality, statistics
from siftwell.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " ", "123 !!", "é", "word " * 40_000, "A", "\n\n"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language_id"](spark, DATA).join(docs, "doc_id").where("held_out and lang is not null")
    good, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and good > 0.98


def test_language_edges(spark, frame):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_language(docs)
    rows = {r.doc_id: r for r in predict_language(frame(list(enumerate(ODD))), model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 3, 7)] == ["und"] * 5 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[4].lang_pred in ("de", "en", "es", "fr") and rows[0].rejected
    empty = fit_language(docs.limit(0))
    assert {r.lang_pred for r in predict_language(frame([(1, "words")]), empty).collect()} == {"und"}
    assert predict_language(frame([]), model).count() == 0
    far = predict_language(frame([(1, "zzxq qqxz wvvx " * 50)]), model).first()
    assert far.rejected


def test_ngram_counts_stay_inside_texts():
    texts = ["ab", None, "", "abc abc", "é"]
    whole = np.concatenate([c for _, c in counts(pa.array(texts))])
    each = np.concatenate([c for t in texts for _, c in counts(pa.array([t], pa.string()))])
    assert (whole == each).all() and whole[1].sum() == 0 and whole[0].sum() == 1


@pytest.mark.parametrize("h", [True, False])
def test_quality_held_out(spark, h):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = QUERIES["op6_quality"](spark, DATA).join(labels, "doc_id").where(F.col("held_out") == h).select("score", "quality", "predicted").toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert (out.predicted == out.quality).mean() > 0.93
    assert out[out.quality == 1].predicted.mean() > 0.97


def test_quality_edges(spark, frame):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    twice = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    model = fit_quality(docs, twice)
    rows = score_quality(frame(list(enumerate(ODD))), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score_quality(frame([(1, "x")]), fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert score_quality(frame([]), model).count() == 0


def test_statistics_do_not_depend_on_batches():
    texts = ["One two two. Three!", None, "", "a | b | c", "X" * 5000, "é é é\nline\nline"]
    whole = statistics(pa.array(texts))
    each = np.concatenate([statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, each) and not whole[1].any() and not whole[2].any()


def test_isotonic():
    at, value = isotonic(np.arange(5.0), np.array([0.0, 3, 1, 5, 4]), np.array([1.0, 4, 4, 5, 4]))
    assert (np.diff(value) >= 0).all() and value[0] == 0 and value[-1] == 1
    assert value.tolist() == [0.0, 0.5, 1.0]


def test_folds(spark):
    import zlib

    rows = spark.range(-3, 300).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def _plain_counts(text):
    """Hashed counts of 2- and 3-byte n-grams, one at a time."""
    fold = lambda b: b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32
    x = [fold(b) for b in (text or "").lower().encode()]
    out = [0] * DIM
    for k in (2, 3):
        for i in range(len(x) - k + 1):
            if x[i] == x[i + 1] == 32:
                continue
            g = x[i] * 256 + x[i + 1] if k == 2 else ((x[i] * 256 + x[i + 1]) * 256 + x[i + 2] + (1 << 24))
            out[((g * 0x9E3779B1) % (1 << 32)) >> 21] += 1
    return out


def test_language_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = fit_language(docs)
    taught = [_plain_counts(t) for _, t, lang in rows if t is not None and lang is not None]
    df = [sum(c[j] > 0 for c in taught) for j in range(DIM)]
    assert np.allclose(model.idf, [math.log((1 + len(taught)) / (1 + d)) + 1 for d in df])
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    for i, t, _ in rows:
        v = [math.log1p(c) * w for c, w in zip(_plain_counts(t), model.idf)]
        norm = math.sqrt(sum(x * x for x in v))
        cos = [sum(x / norm * float(y) for x, y in zip(v, c)) if norm else 0.0 for c in model.centroids]
        best = max(range(len(cos)), key=lambda j: cos[j])
        if not any(ch.isalpha() for ch in t or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        assert abs(got[i].score - max(0.0, cos[best])) < 1e-4
        if sorted(cos)[-1] - sorted(cos)[-2] > 1e-4:
            assert got[i].lang_pred == model.names[best]
            assert abs(cos[best] - model.least[best]) < 1e-4 or got[i].rejected == (cos[best] < model.least[best])


def test_counts_beyond_16_bits(spark, frame):
    text = "ab " * 70_000
    assert counts(pa.array([text])).__next__()[1].max() == 70_000
    docs = spark.createDataFrame([(1, text, "xx"), (2, "cd " * 9, "yy")], "doc_id bigint, text string, lang string")
    model = fit_language(docs)
    assert {r.doc_id: r.lang_pred for r in predict_language(docs, model).collect()} == {1: "xx", 2: "yy"}


def test_statistics_against_plain_loops():
    texts = [t or "" for t in ODD] + ["A b b b, c! | d.\nÉ 12 [x] b b", "one\tone one two"]
    for t, row in zip(texts, statistics(pa.array(texts))):
        raw = t.encode()
        ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        pairs = list(zip(ws, ws[1:]))
        lines, space = raw.count(b"\n"), sum(raw.count(c) for c in (b" ", b"\t", b"\v", b"\f", b"\r"))
        rate = lambda a, b: a / max(b, 1)
        classes = [sum(65 <= b < 91 for b in raw), sum(48 <= b < 58 for b in raw), space, lines, raw.count(b"."), raw.count(b","), raw.count(b"!"), raw.count(b"|")]
        want = [rate(c, len(raw)) for c in classes]
        assert np.allclose(row[:8], want) and np.isclose(row[11], rate(sum(b >= 128 for b in raw), len(raw)))
        top = max(Counter(ws).values(), default=0)
        want = [
            math.log1p(len(raw)), math.log1p(len(ws)), rate(len(raw) - space - lines, len(ws)), rate(len(set(ws)), len(ws)), rate(top, len(ws)),
            rate(len(set(pairs)), len(ws) - 1), rate(sum(a == b for a, b in pairs), len(ws)), math.log1p(len(raw) / (lines + 1)),
        ]
        assert np.allclose(row[12:], want), t[:30]


def test_quality_against_a_dense_fit(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    stats = statistics(pa.array([r.text for r in rows]))
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale[stats.std(0) > 1e-6], stats.std(0)[stats.std(0) > 1e-6])
    quality = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    taught = [k for k, r in enumerate(rows) if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5]
    y = np.array([quality[rows[k].doc_id] for k in taught])
    z = np.clip((stats[taught] - model.mean) / model.scale, -6, 6)
    x = np.array([[1.0, *(math.sqrt(2 / FEATURES) * np.cos(r @ model.omega + model.phase))] for r in z])
    damp = np.sqrt(np.diag([1e-9] + [RIDGE + 1e-9] * FEATURES))
    w = np.linalg.lstsq(np.vstack([x, damp]), np.concatenate([y, np.zeros(FEATURES + 1)]), rcond=None)[0]
    assert np.abs(x @ w - x @ model.weights).max() < 1e-4
    # pool adjacent violators, by the largest mean of any bins up to here against the least from here on
    raw = x @ model.weights
    bins = {}
    for s, t in zip(np.floor(np.clip(raw, -0.5, 1.5) * (BINS / 2)), y):
        bins.setdefault(s, []).append(t)
    keys = sorted(bins)
    total, count = np.cumsum([0, *(sum(bins[b]) for b in keys)]), np.cumsum([0, *(len(bins[b]) for b in keys)])
    fitted = [max(min((total[j] - total[i]) / (count[j] - count[i]) for j in range(k + 1, len(keys) + 1)) for i in range(k + 1)) for k in range(len(keys))]
    assert np.allclose(sorted(set(np.round(fitted, 9))), sorted(set(np.round(model.value, 9))), atol=1e-6)


def test_sums_meet_in_rounds(spark):
    from siftwell.llm.common import tree_add

    def add(key, table):
        assert table.num_rows <= 40  # no group meets all of them
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())])})

    parts = spark.range(5000).selectExpr("id as slot", "id as n")
    sums = tree_add(parts, add, "n bigint")
    assert len(sums) == 8 and sum(r[0] for r in sums) == 5000 * 4999 // 2
