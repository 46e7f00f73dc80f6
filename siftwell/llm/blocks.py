"""Integer vectors in vertical blocks, and the grid of cells in which a set of queries meets every row.

A row of the block table holds up to BLOCK vectors of one length, component after component (all first components,
then all second ones, ...), in the narrowest integer type that holds them, in order of id. Queries are dealt to groups
of about GROUP, blocks to piles of about PILE; a cell is one group and one pile. A group is sent to each pile and a
pile to each group as a few large rows, so that what a task holds does not grow with the table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4096
BLOCK_BYTES = 2 << 20  # of 64-bit components; longer vectors make smaller blocks
PILE = 4
GROUP = 512
STEP = 128  # queries of a cell that are scored at once
_BLOCKS = "dim int, block bigint, n int, n_asked int, ids binary, rows binary, labels binary, asked binary, kind string, data binary"
_ASKED = "dim int, ids binary, rows binary, labels binary, kind string, data binary"
_MOST = (1 << 63) - 1


class Block(NamedTuple):
    """Vectors side by side: x has a row a component and a column a vector."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def quantised(df: DataFrame, asked: Column, id_col: str, vector_col: str, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(row, id, label, asked, v) of the rows that take part: v is floor(scale * component), the component as double.

    Rows without an id, a vector or a label (where labels count), and those with a component that is null, NaN or
    infinite take no part. Values beyond a long are clamped to it. Each row is its own: ids may repeat.
    """
    v, bad = F.col(f"`{vector_col}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.lit(0).cast("bigint") if label is None else label.cast("bigint")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"), v.cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "asked", whole.alias("v"))


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, np.ascontiguousarray(x.T).astype(kind).tobytes()


def _pack(batches):
    """Rows to blocks; what is held is a block for each length of vector that the task has met and not yet sent."""
    held: dict[int, list] = {}

    def sent(dim: int) -> pa.RecordBatch:
        row, ident, label, asked, x = (np.concatenate(c) for c in zip(*held.pop(dim)))
        order = np.lexsort((row, ident))
        kind, data = _narrow(x[order])
        one = {"dim": dim, "block": int(row.min()), "n": len(row), "n_asked": int(asked.sum()), "ids": ident[order].tobytes(), "rows": row[order].tobytes(), "labels": label[order].tobytes(), "asked": asked[order].tobytes(), "kind": kind, "data": data}
        return pa.RecordBatch.from_pylist([one], schema=_SCHEMA)

    for b in batches:
        row, ident, label = (b.column(n).to_numpy() for n in ("row", "id", "label"))
        asked, v = b.column("asked").to_numpy(zero_copy_only=False), b.column("v")
        size = v.value_lengths().to_numpy()
        for dim in np.unique(size).tolist():
            mine = np.flatnonzero(size == dim)
            x = v.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim)
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))
            lo = 0
            while lo < len(mine):
                have = sum(len(h[0]) for h in held.get(dim, []))
                part = slice(lo, lo + most - have)
                at = mine[part]
                held.setdefault(dim, []).append((row[at], ident[at], label[at], asked[at], x[part]))
                lo += len(at)
                if have + len(at) >= most:
                    yield sent(dim)
    for dim in list(held):
        yield sent(dim)


_SCHEMA = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("n_asked", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "labels", "asked")), ("kind", pa.string()), ("data", pa.binary())])


def unpacked(table, at: int = 0) -> Block:
    ids, rows, labels = (np.frombuffer(table.column(c)[at].as_py(), np.int64) for c in ("ids", "rows", "labels"))
    x = np.frombuffer(table.column("data")[at].as_py(), table.column("kind")[at].as_py())
    return Block(ids, rows, labels, x.reshape(-1, len(ids)) if len(ids) else x.reshape(0, 0))


def _only_asked(batches):
    for b in batches:
        for at in range(b.num_rows):
            block, dim = unpacked(b, at), b.column("dim")[at].as_py()
            mine = np.flatnonzero(np.frombuffer(b.column("asked")[at].as_py(), bool))
            x = np.ascontiguousarray(block.x.T[mine]).astype(np.int64)
            yield pa.record_batch({"dim": pa.array([dim] * len(mine), pa.int32()), "row": block.rows[mine], "id": block.ids[mine], "label": block.labels[mine], "v": pa.array([r.tobytes() for r in x], pa.binary())})


def _group(key, table):
    """The queries of a group as one row, like a block."""
    row, ident, label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
    x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int64).reshape(len(row), key[0].as_py())
    kind, data = _narrow(x)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], pa.int64()), "ids": [ident.tobytes()], "rows": [row.tobytes()], "labels": [label.tobytes()], "kind": [kind], "data": [data]})


class Grid:
    """Blocks of all rows and groups of the queries among them, as written tables, and the cells where they meet."""

    def __init__(self, rows: DataFrame, name: str):
        self.spark = rows.sparkSession
        self.blocks = C.materialize(rows.mapInArrow(_pack, _BLOCKS), f"{name}-blocks")
        asked, n = self.blocks.agg(F.coalesce(F.sum("n_asked"), F.lit(0)), F.count(F.lit(1))).first()
        self.groups, self.piles = max(1, -(-asked // GROUP)), max(1, -(-n // PILE))
        single = self.blocks.where("n_asked > 0").mapInArrow(_only_asked, "dim int, row bigint, id bigint, label bigint, v binary")
        dealt = single.withColumn("g", self.group_of(F.col("row")))
        self.queries = C.materialize(dealt.groupBy("dim", "g").applyInArrow(_group, "dim int, g bigint, ids binary, rows binary, labels binary, kind string, data binary"), f"{name}-queries")

    def group_of(self, row: Column) -> Column:
        return F.pmod(F.xxhash64(row), F.lit(self.groups))

    def meet(self, cell, schema: str, windows: DataFrame | None = None) -> DataFrame:
        """cell(key, blocks, queries) for each cell; windows, if given: (dim, g, windows), joined to the rows of queries."""
        n = max(C.shuffle_partitions(self.spark), min(self.groups * self.piles, 4096))
        blocks = self.blocks.withColumn("j", F.pmod(F.xxhash64("block"), F.lit(self.piles)))
        # only groups that have queries of that length (and windows) meet a block
        queries = self.queries if windows is None else self.queries.join(windows, ["dim", "g"])
        blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))).withColumn("g", F.col("g").cast("bigint")).drop("asked", "n", "n_asked")
        queries = queries.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(self.piles - 1)))).withColumn("j", F.col("j").cast("bigint"))
        key = ["dim", "g", "j"]
        left, right = (x.repartition(n, *key).groupBy(*key) for x in (blocks, queries))
        return left.cogroup(right).applyInArrow(cell, schema)

    def drop(self) -> None:
        C.drop(self.blocks)
        C.drop(self.queries)


def fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether every partial inner product is exact in double precision."""
    high = lambda a: max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0
    return high(q) * high(x) * max(1, len(q)) < 1 << 53


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the columns of q with those of x as longs; what exceeds a long is clamped to it."""
    if fits(q, x):
        return (q.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    s = q.T.astype(object) @ x.astype(object)
    return np.clip(s, -_MOST - 1, _MOST).astype(np.int64) if q.size and x.size else np.zeros((q.shape[1], x.shape[1]), np.int64)


def first_of_each(group: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of rows in an order that keeps groups together, the first k of each group."""
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[place < k]
