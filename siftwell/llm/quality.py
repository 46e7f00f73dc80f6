"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each task sums the normal equations of its rows; the sums are
added in rounds, solved on the driver, and the resulting scores calibrated by pool-adjacent-
violators over score bins. What reaches the driver is bounded by FEATURES and BINS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FEATURES = 320
RIDGE = 1e-3
BANDWIDTH = 1.6
BINS = 2000
_STEP = 2 << 20

# byte classes: 0 lower-case letter or other, 1 upper case, 2 digit, 3 space, 4 line end, 5 full stop, 6 comma,
# 7 exclamation mark, 8 bar, 9 symbol, 10 bracket or quote, 11 other punctuation, 12 not ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate([b"", bytes(range(65, 91)), b"0123456789", b" \t\v\f\r", b"\n", b".", b",", b"!", b"|", b"#$%&*@^~+=<>\\/_`", b"()[]{}\"'", b"?;:-"]):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 12
_STATS = 12 + 8


def _rate(a, b):
    return a / np.maximum(b, 1)


def statistics(col) -> np.ndarray:
    """One row of _STATS numbers for each text; an empty or null text has zeros."""
    data, offs = C.utf8(col)
    n = np.diff(offs)
    out = np.zeros((len(n), _STATS))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + _STEP, "right")) - 1)
        out[lo:hi] = _statistics(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi
    return out


def _statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = np.diff(offs).astype(float)
    kinds = _CLASS[data]
    full = np.flatnonzero(n > 0)
    share = np.zeros((len(n), 12))
    for k in range(1, 13):
        if len(full):
            share[full, k - 1] = np.add.reduceat((kinds == k).view(np.uint8), offs[full], dtype=np.int64)
    h, at = C.words(data, offs)
    words = np.diff(at).astype(float)
    doc = np.repeat(np.arange(len(n)), np.diff(at))

    def distinct(x, d):
        """Distinct values and the count of the most frequent one for each document."""
        order = np.lexsort((x, d))
        new = np.ones(len(x), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (d[order][1:] != d[order][:-1])
        first = np.flatnonzero(new)
        top = np.zeros(len(n))
        np.maximum.at(top, d[order][first], np.diff(np.append(first, len(x))))
        return np.bincount(d[order][first], minlength=len(n)), top

    kinds_of, top = distinct(h, doc)
    pair = h[1:] * np.uint64(3) + h[:-1]
    inside = doc[1:] == doc[:-1]
    pairs, _ = distinct(pair[inside], doc[1:][inside])
    again = np.bincount(doc[1:][inside & (h[1:] == h[:-1])], minlength=len(n))
    space = share[:, 2] + share[:, 3]
    return np.column_stack([
        _rate(share, n[:, None]), np.log1p(n), np.log1p(words), _rate(n - space, words), _rate(kinds_of, words), _rate(top, words),
        _rate(pairs, words - 1), _rate(again, words), np.log1p(_rate(n, share[:, 3] + 1)),
    ])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(z)), np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0.0, 1.0)


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: centres and non-decreasing means."""
    pools: list[list[float]] = []
    for x, s, c in zip(at, total, count):
        pools.append([x * c, s, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            b = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], b)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def held_out(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def _doc_stats(batches):
    for b in batches:
        s = statistics(b.column(1))
        yield pa.record_batch({"id": b.column(0), "stats": pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), _STATS).cast(pa.list_(pa.float64()))})


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, _STATS)


def _summer(model: QualityModel):
    def sums(batches):
        from pyspark import TaskContext

        d = FEATURES + 1
        total = np.zeros((d, d + 1))
        for b in batches:
            x, y = model.features(_matrix(b.column(0))), b.column(1).to_numpy()
            total[:, :d] += x.T @ x
            total[:, d] += x.T @ y
        yield pa.record_batch({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    return sums


def _add(key, table):
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def _raw(model: QualityModel):
    def raw(batches):
        for b in batches:
            yield pa.record_batch({"bin": pa.array(np.floor(np.clip(model.raw(_matrix(b.column(0))), -0.5, 1.5) * (BINS / 2)).astype(np.int64)), "y": b.column(1)})

    return raw


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11) -> QualityModel:
    """Fit on every labelled row whose crc32(id as text) mod 5 is not 0; statistics are scaled over all rows.

    Null labels and ids teach nothing. Without any label the model scores 0.5 everywhere.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stats = C.materialize(rows.mapInArrow(_doc_stats, T.StructType().add("id", rows.schema["id"].dataType).add("stats", T.ArrayType(T.DoubleType()))), "quality-stats")
    item = [F.col("stats")[k] for k in range(_STATS)]
    moments = stats.agg(F.array(*[F.avg(c) for c in item]), F.array(*[F.stddev_pop(c) for c in item])).first()
    mean, scale = (np.array([x or 0.0 for x in m]) for m in moments)
    rng = np.random.default_rng(seed)
    omega = rng.normal(size=(_STATS, FEATURES)) / (BANDWIDTH * np.sqrt(_STATS) / 2)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), omega, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("y is not null")
    train = stats.join(known, "id").where(~held_out("id")).select("stats", "y")
    train = C.materialize(train, "quality-train")
    sums = C.tree_add(train.mapInArrow(_summer(model), "slot bigint, sums binary"), _add, "sums binary")
    d = FEATURES + 1
    total = sum((np.frombuffer(r[0]).reshape(d, d + 1) for r in sums), np.zeros((d, d + 1)))
    n = total[0, 0]
    if n == 0:
        return model
    weights = np.linalg.solve(total[:, :d] + RIDGE * np.diag([0.0] + [1.0] * FEATURES) + 1e-9 * np.eye(d), total[:, d])
    model = QualityModel(model.mean, model.scale, omega, model.phase, weights, model.at, model.value)
    bins = train.mapInArrow(_raw(model), "bin bigint, y double").groupBy("bin").agg(F.sum("y"), F.count("y")).orderBy("bin").collect()
    at, value = isotonic((np.array([r[0] for r in bins]) + 0.5) / (BINS / 2), np.array([r[1] for r in bins]), np.array([r[2] for r in bins]))
    return QualityModel(model.mean, model.scale, omega, model.phase, weights, at, value)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs and score_col in [0, 1], higher for text likelier to be labelled 1.

    Null and empty texts have the score of zero statistics. An input column named like score_col is replaced.
    """
    docs = C.without(docs, score_col)
    where = docs.columns.index(text_col)

    def score(batches):
        for b in batches:
            s = model.score(statistics(b.column(where)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score_col])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields]).add(score_col, "double"))
