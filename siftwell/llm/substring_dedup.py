"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt to blocks of a few MB. A block sends each distinct window hash once (local combining, so
a passage that a third of all documents share costs one entry a block), split by hash range into buckets. A
bucket finds the hashes that several blocks sent and answers each block with one bit a hash. Blocks then
recompute their windows, mark those repeated here or elsewhere, and merge them into maximal intervals.

Hashes have 64 bits after mixing; two different windows are taken for equal with probability 2**-64 a pair.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK_BYTES = 4 << 20
BUCKET_HASHES = 2 << 20
ROW_BYTES = 64  # what a row takes beside its text, about
_SPANS = T.ArrayType(T.StructType().add("first", "long").add("last", "long"))


def _block_sender(text_col: str, k: int, n_buckets: int):
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def send(key, table):
        h, bounds = C.words(*C.utf8(table.column(text_col)))
        u = np.unique(C.windows(h, bounds, k)[0])
        of = (u >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(u), np.int64)
        at = np.searchsorted(of, np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(at))
        C.trim(len(u))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "block": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
            "hashes": pa.array([C.pack_sorted(u[at[b] : at[b + 1]]) for b in full], pa.binary()),
        })

    return send


def _bucket_counter(key, table):
    sent = [C.unpack_sorted(x.as_py()) for x in table.column("hashes")]
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    many = np.zeros(len(every), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    at = np.cumsum([0, *map(len, sent)])
    bits = [many[i:j] for i, j in zip(at[:-1], at[1:])]
    some = [i for i, b in enumerate(bits) if b.any()]
    blocks = table.column("block").to_numpy()
    del every, order, same
    C.trim(len(many))
    return pa.table({
        "block": pa.array(blocks[some], pa.int64()),
        "bucket": pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
        "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()),
    })


def _block_cutter(text_col: str, k: int, n_buckets: int, names: list[str]):
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def cut(key, table, answers):
        data, offs = C.utf8(table.column(text_col))
        h, bounds = C.words(data, offs)
        win, at = C.windows(h, bounds, k)
        u, inverse, count = np.unique(win, return_inverse=True, return_counts=True)
        many = count > 1
        of = (u >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(u), np.int64)
        start = np.searchsorted(of, np.arange(n_buckets + 1))
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            lo, hi = start[b], start[b + 1]
            many[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        edge = np.zeros(len(h) + 1, np.int32)
        hit = at[many[inverse]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + k, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = data.tobytes()
        kept, removed, spans = [], [], []
        for i in range(len(offs) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            ws, g = raw[offs[i] : offs[i + 1]].split(), gone[lo:hi]
            n = int(g.sum())
            removed.append(n)
            if n:
                turn = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(turn[::2], turn[1::2] - 1)])
                ws = compress(ws, (~g).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(ws))
        del u, inverse, count, win, at, raw
        C.trim(len(data))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return table.select(names).append_column("n_words", pa.array(np.diff(bounds), pa.int64())).append_column(
            "n_removed", pa.array(removed, pa.int64())
        ).append_column("removed_spans", pa.array(spans, kind)).append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))

    return cut


def _dealt(docs: DataFrame, text_col: str, block: str, n_blocks: int) -> DataFrame:
    """docs with the number of a block. Both readings of docs must deal alike, so a row goes by the hash of its values.

    Equal rows of more than a block's bytes together are first written with a number each and go by that number too.
    """
    row, number = C.fresh(docs, "row"), C.fresh(docs, "number")
    values = [F.col(f"`{c}`") for c, t in docs.dtypes if t in ("bigint", "int", "string")]
    rows = docs.withColumn(row, F.xxhash64(*values))
    deal = F.pmod(F.xxhash64(row, F.lit(0)), F.lit(n_blocks))
    size = F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + ROW_BYTES)
    hot = C.materialize(rows.groupBy(row).agg(size.alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") > BLOCK_BYTES)).select(row), "hot-rows")
    if hot.isEmpty():
        C.drop(hot)
        return rows.withColumn(block, deal).drop(row)
    many = C.materialize(C.semi_join(rows, hot, row).withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
    spread = F.pmod(F.xxhash64(row, number), F.lit(n_blocks))
    few, kept = C.semi_join(rows, hot, row, "left_anti"), [F.col(f"`{c}`") for c in docs.columns]
    return few.select(*kept, deal.alias(block)).unionByName(many.select(*kept, spread.alias(block)))


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word covered by a window of `window` words that starts anywhere else as well.

    Words are maximal runs of characters outside [\\x20\\x09-\\x0D]. Returns the columns of docs and n_words,
    n_removed, removed_spans (maximal intervals of word positions, both ends included) and kept_text (kept
    words joined by one space). Input columns of these names are replaced. A null text counts as empty: 0
    words, kept_text ''. Texts shorter than a window lose nothing. Repeated rows count as other places, so
    all copies of a passage go, the first one too. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = C.without(docs, "n_words", "n_removed", "removed_spans", "kept_text")
    _, size = C.text_bytes(docs, text_col)
    parts = C.shuffle_partitions(spark)
    n_blocks = max(parts, size // BLOCK_BYTES + 1)
    n_buckets = C.pow2(max(parts, size / 6 / BUCKET_HASHES))
    names = docs.columns
    block = C.fresh(docs, "block")
    blocks = _dealt(docs, text_col, block, n_blocks)
    sent = blocks.groupBy(block).applyInArrow(_block_sender(text_col, window, n_buckets), "bucket long, block long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_bucket_counter, "block long, bucket long, bits binary")
    out = T.StructType([*docs.schema.fields]).add("n_words", "long").add("n_removed", "long")
    out = out.add("removed_spans", _SPANS).add("kept_text", "string")
    return blocks.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(_block_cutter(text_col, window, n_buckets, names), out)
