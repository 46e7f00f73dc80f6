"""Hard negatives by distributed radix selection.

For an anchor and each of its positives, negatives are sought whose score lies in a window below the positive's. Cells
count scores in 256 buckets of each window, Spark adds the counts up, and the bucket that holds the k-th score is cut
into 256 again, digit by digit, until it is a single score. Then, and only then, rows are gathered: those that reach
that score, and at that score the first ids. A cell sends no bucket below its own k-th score, as the k-th of all rows
cannot lie there, so counts stay few whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .blocks import STEP, Grid, first_of_each, quantised, scores, unpacked

BITS = 8  # of a digit
_KEY = ["dim", "g", "a_row", "p_row"]


def _positives(k: int):
    """The first k rows of each anchor's label in a cell."""

    def cell(key, blocks, asked):
        out = []
        if blocks.num_rows and asked.num_rows:
            q = unpacked(asked)
            for at in range(blocks.num_rows):
                b = unpacked(blocks, at)
                for lo in range(0, len(q.ids), STEP):
                    part = slice(lo, lo + STEP)
                    s = scores(q.x[:, part], b.x)
                    i, j = np.nonzero((q.labels[part][:, None] == b.labels) & (q.rows[part][:, None] != b.rows))
                    keep = first_of_each(i, np.lexsort((j, ~s[i, j], i)), k)  # blocks are in order of id
                    i, j = i[keep], j[keep]
                    out.append((q.rows[part][i], q.ids[part][i], b.rows[j], b.ids[j], s[i, j]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        n, (dim, g, _) = len(cols[0]), (x.as_py() for x in key)
        return pa.table({"dim": pa.array(np.full(n, dim, np.int32)), "g": pa.array(np.full(n, g, np.int64))} | dict(zip(("a_row", "anchor_id", "p_row", "positive_id", "positive_score"), cols)))

    return cell


def _in_windows(blocks, asked, use):
    """use(window, scores, ids, rows) for each block and window, of the different-label rows that the window holds."""
    if not blocks.num_rows or not asked.num_rows:
        return
    q = unpacked(asked)
    of = {r: i for i, r in enumerate(q.rows.tolist())}
    windows = sorted(((of[w["a_row"]], w) for w in asked.column("windows")[0].as_py()), key=lambda x: x[0])
    for at in range(blocks.num_rows):
        b, lo, s = unpacked(blocks, at), -STEP, None
        for i, w in windows:
            if i >= lo + STEP:
                lo = i - i % STEP
                s = scores(q.x[:, lo : lo + STEP], b.x)
            mine = np.flatnonzero((s[i - lo] >= w["lo"]) & (s[i - lo] <= w["hi"]) & (b.labels != q.labels[i]))
            if len(mine):
                use(w, s[i - lo][mine], b.ids[mine], b.rows[mine])


def _histograms(shift: int):
    def cell(key, blocks, asked):
        out: dict[tuple[int, int], dict[int, int]] = {}

        def count(w, s, ids, rows):
            bucket = (w["hi"] - s) >> shift
            if len(bucket) > w["need"]:
                bucket = bucket[bucket <= np.partition(bucket, w["need"] - 1)[w["need"] - 1]]
            mine = out.setdefault((w["a_row"], w["p_row"]), {})
            for k, n in zip(*(x.tolist() for x in np.unique(bucket, return_counts=True))):
                mine[k] = mine.get(k, 0) + n

        _in_windows(blocks, asked, count)
        rows = [(a, p, k, n) for (a, p), mine in out.items() for k, n in mine.items()]
        cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)]
        dim, g, _ = (x.as_py() for x in key)
        return pa.table({"dim": pa.array([dim] * len(rows), pa.int32()), "g": pa.array([g] * len(rows), pa.int64())} | dict(zip(("a_row", "p_row", "bucket", "n"), cols)))

    return cell


def _gather(k: int):
    def cell(key, blocks, asked):
        out = []

        def keep(w, s, ids, rows):
            order = np.lexsort((rows, ids, ~s))[:k]  # of more rows than k at the k-th score, none past the first k can stay
            out.append((np.full(len(order), w["a_row"]), np.full(len(order), w["p_row"]), rows[order], ids[order], s[order]))

        _in_windows(blocks, asked, keep)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        dim, g, _ = (x.as_py() for x in key)
        return pa.table({"dim": pa.array(np.full(len(cols[0]), dim, np.int32)), "g": pa.array(np.full(len(cols[0]), g, np.int64))} | dict(zip(("a_row", "p_row", "row", "negative_id", "negative_score"), cols)))

    return cell


def _share(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded up or down, without leaving the range of a long."""
    r = F.pmod(score, F.lit(100))
    return F.expr("(positive_score - pmod(positive_score, 100)) div 100") * percent + ((r * percent + (99 if up else 0)) - F.pmod(r * percent + (99 if up else 0), F.lit(100))) / 100


def _windows_of(windows: DataFrame) -> DataFrame:
    """(dim, g, windows): those of a group of anchors in one array, a few for each anchor."""
    return windows.groupBy("dim", "g").agg(F.collect_list(F.struct("a_row", "p_row", "lo", "hi", "need")).alias("windows"))


def kth_scores(grid: Grid, windows: DataFrame) -> DataFrame:
    """windows (_KEY, lo, hi, need) with kth: the need-th highest score within [lo, hi], or lo if there are fewer."""
    width = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    if width is None:
        return windows.withColumn("kth", F.col("lo"))
    open_, ended = windows.withColumn("least", F.col("lo")), None
    for digit in reversed(range(max(1, -(-int(width).bit_length() // BITS)))):
        shift = digit * BITS
        counts = grid.meet(_histograms(shift), "dim int, g bigint, a_row bigint, p_row bigint, bucket bigint, n bigint", _windows_of(open_))
        counts = counts.groupBy(*_KEY, "bucket").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("up_to", F.sum("n").over(Window.partitionBy(*_KEY).orderBy("bucket")))
        at = counts.join(open_.select(*_KEY, "need"), _KEY).where("up_to >= need and up_to - n < need").select(*_KEY, "bucket", (F.col("need") - F.col("up_to") + F.col("n")).cast("int").alias("left"))
        both = C.materialize(open_.join(at, _KEY, "left"), "windows")
        few = both.where("bucket is null").select(*_KEY, F.col("least").alias("kth"))
        ended = few if ended is None else ended.unionByName(few)
        hi = F.col("hi") - F.shiftleft("bucket", shift)
        cut = both.where("bucket is not null").select(*_KEY, F.greatest(F.col("lo"), hi - ((1 << shift) - 1)).alias("lo"), hi.alias("hi"), F.col("left").alias("need"), "least")
        open_ = cut
    found = ended.unionByName(open_.select(*_KEY, F.col("hi").alias("kth")))  # a bucket is one score now
    return windows.join(found, _KEY)


def hard_negatives(
    df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` marks.

    Scores are inner products of floor(scale * component). An anchor's positives are its first `positives` other rows of
    the same label; a positive's negatives are the first `negatives` rows of another label with low * positive_score <=
    100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller id; rows of one id are rows
    of their own. Rows without an id, a label or a vector, or with a component that is null, NaN or infinite, take no
    part; vectors meet only vectors of their length. Positives without negatives have no row, so that a table with
    one label, or none, gives none. A negative positive score has an empty window. Other columns are not read.
    """
    grid = Grid(quantised(df, anchors, id_col, vector_col, label, scale), "negatives")
    kinds = "dim int, g bigint, a_row bigint, anchor_id bigint, p_row bigint, positive_id bigint, positive_score bigint"
    near = Window.partitionBy("a_row").orderBy(F.desc("positive_score"), "positive_id", "p_row")
    pairs = grid.meet(_positives(positives), kinds).withColumn("place", F.row_number().over(near)).where(F.col("place") <= positives)
    score = F.col("positive_score")
    pairs = pairs.withColumns({"lo": _share(score, low, True).cast("bigint"), "hi": _share(score, high, False).cast("bigint"), "need": F.lit(negatives)})
    pairs = C.materialize(pairs.where("lo <= hi").drop("place"), "pairs")
    wanted = kth_scores(grid, pairs.select(*_KEY, "lo", "hi", "need")).select(*_KEY, F.col("kth").alias("lo"), "hi", "need")
    rows = grid.meet(_gather(negatives), "dim int, g bigint, a_row bigint, p_row bigint, row bigint, negative_id bigint, negative_score bigint", _windows_of(wanted))
    rows = C.materialize(rows, "gathered")
    grid.drop()
    w = Window.partitionBy(*_KEY).orderBy(F.desc("negative_score"), "negative_id", "row")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return ranked.join(pairs, _KEY).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
