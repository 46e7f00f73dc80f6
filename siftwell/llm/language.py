"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Letters' n-grams are hashed to DIM places; weights are log(1 + count) * idf, vectors have length 1. Document
frequencies cover every training text. Each language's texts are clustered (spherical k-means) on a bounded
sample, SAMPLE texts a language, into up to CLUSTERS centroids. A text takes the language of the centroid of
largest cosine; it is flagged as rejected where it is farther from that centroid than nearly all texts of the
cluster were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

DIM = 2048
CLUSTERS = 4
SAMPLE = 800
REJECT_QUANTILE = 0.002
_STEP = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(col, rows: int = 256):
    """Yields (first row, matrix of n-gram counts) over a column of texts; n-grams have 2 and 3 bytes."""
    data, offs = C.utf8(pc.utf8_lower(col.fill_null("")))
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + _STEP, "right")) - 1))
        out = np.zeros((hi - lo) * DIM, np.int64)
        # a row at a time only where one text is longer than the step, and that in slices
        for a in range(int(offs[lo]), int(offs[hi]), _STEP):
            b = min(a + _STEP, int(offs[hi]))
            x = _FOLD[data[a : min(b + 2, int(offs[hi]))]].astype(np.uint32)
            doc = np.searchsorted(offs, np.arange(a, b), "right") - 1 - lo if hi - lo > 1 else np.zeros(b - a, np.int64)
            for k in (2, 3):
                m = len(x) - k + 1
                m = min(m, b - a)
                if m <= 0:
                    continue
                g = x[:m] * np.uint32(1 << 8) + x[1 : m + 1]
                if k == 3:
                    g = g * np.uint32(1 << 8) + x[2 : m + 2] + np.uint32(1 << 24)
                ends = np.arange(a, a + m) + k <= offs[1:][doc[:m] + lo]
                blank = (x[:m] == 32) & (x[1 : m + 1] == 32)
                use = ends & ~blank
                place = (g * np.uint32(0x9E3779B1)) >> np.uint32(21)
                out += np.bincount(doc[:m][use] * DIM + place[use], minlength=len(out))
        yield lo, out.reshape(hi - lo, DIM)
        lo = hi


def weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]  # of each centroid
    least: np.ndarray  # cosine below which each centroid rejects


def _df(batches):
    from pyspark import TaskContext

    total, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for _, c in counts(b.column(0)):
            total += (c > 0).sum(0)
            n += len(c)
    yield pa.record_batch({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n]), "df": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _add(key, table):
    return pa.table({"n": pa.array([sum(table.column("n").to_pylist())]), "df": pa.array([np.sum([x.as_py() for x in table.column("df")], axis=0).tolist()], pa.list_(pa.int64()))})


def _sparse(batches):
    for b in batches:
        rows = []
        for _, c in counts(b.column(1)):
            for r in c:
                at = np.flatnonzero(r)
                rows.append(at.astype("<u4").tobytes() + r[at].astype("<u4").tobytes())
        yield pa.record_batch({"lang": b.column(0), "v": pa.array(rows, pa.binary())})


def _cluster(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means from far-apart seeds."""
    seeds = [int(rng.integers(len(x)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(12):
        of = (x @ c.T).argmax(1)
        c = np.array([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_language(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", seed: int = 5) -> LanguageModel:
    """Learn from rows of docs with a language and a text; which rows those are is the caller's choice.

    One row a language and SAMPLE sparse vectors a language come to the driver.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    df = C.tree_add(rows.select("text").mapInArrow(_df, "slot bigint, n bigint, df array<bigint>"), _add, "n bigint, df array<bigint>")
    n, total = sum(r[0] for r in df), np.sum([np.zeros(DIM), *[r[1] for r in df]], axis=0)
    idf = np.log((1 + n) / (1 + total)) + 1
    if not per:
        return LanguageModel(idf, np.zeros((0, DIM), np.float32), [], np.zeros(0))
    share = F.create_map(*[x for lang, c in per.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / c)))])
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.where(chance < share[F.col("lang")]).select("lang", "text").mapInArrow(_sparse, "lang string, v binary").collect()
    rng, centroids, names, least = np.random.default_rng(seed), [], [], []
    for lang in sorted(per):
        mine = sorted(bytes(r[1]) for r in some if r[0] == lang)
        if not mine:
            continue
        dense = np.zeros((len(mine), DIM))
        for r, v in zip(dense, mine):
            half = np.frombuffer(v, "<u4").reshape(2, -1)
            r[half[0]] = half[1]
        x = weigh(dense, idf)
        c = _cluster(x, CLUSTERS, rng)
        cos = x @ c.T
        of = cos.argmax(1)
        for j in range(len(c)):
            if (of == j).any():
                centroids.append(c[j])
                names.append(lang)
                least.append(float(np.quantile(cos[of == j, j], REJECT_QUANTILE)))
    return LanguageModel(idf, np.array(centroids, np.float32), names, np.array(least))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (largest cosine, 0 to 1) and rejected.

    lang_pred is the language of the nearest centroid; `und`, with score 0, for a null text or one without a
    letter, or if nothing was learned. rejected also marks texts that lie outside of what was learned.
    Input columns of these names are replaced.
    """
    docs = C.without(docs, "lang_pred", "score", "rejected")
    where, names = docs.columns.index(text_col), np.array([*model.names, "und"], object)

    def predict(batches):
        for b in batches:
            col = b.column(where).fill_null("")
            letter = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.full(len(col), len(names) - 1), np.zeros(len(col))
            if len(names) > 1:
                for lo, c in counts(col):
                    cos = weigh(c, model.idf) @ model.centroids.T
                    best[lo : lo + len(c)], score[lo : lo + len(c)] = cos.argmax(1), cos.max(1)
            best[~letter], score[~letter] = len(names) - 1, 0.0
            rejected = (best == len(names) - 1) | (score < np.append(model.least, 2.0)[best])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0).astype(float)), pa.array(rejected)],
                [*b.schema.names, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
