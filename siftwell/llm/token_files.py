"""Token-id output in patched frame-of-reference blocks.

A shard is a byte image that holds whole documents, ids of all of them end to end:

  header   magic 'PFOR', version, documents, ids, block length, blocks (little-endian 32 or 64 bits)
  tables   document ids (int64), ids before each document in the shard (uint64)
  index    byte offset of each block, from the end of the index (uint64)
  blocks   minimum (uint32), width (uint8), exceptions (uint16), ids (uint16); the low `width` bits of each
           id less the minimum, packed; positions (uint16) and whole differences (uint32) of the exceptions

The width of a block is that of its WIDTH_PERCENTILE-th smallest difference; larger ones are exceptions.
Shards are rows (part, seq, content) of a table in the shared folder; `content` is the file image.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .encode import encoder, slices

BLOCK = 1024
SHARD_IDS = 1 << 20
WIDTH_PERCENTILE = 95
_HEAD = struct.Struct("<4sIQQIQ")
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patched", "<u2"), ("n", "<u2")])


def _pack(diffs: np.ndarray, low: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Images of blocks; diffs has a row for each block, padded with 0 beyond n."""
    if not len(diffs):
        return []
    at = np.maximum(0, -(-n * WIDTH_PERCENTILE // 100) - 1)
    rank = diffs.shape[1] - n + at  # padding is smallest, so it comes first in a row's order
    value = np.partition(diffs[:-1], rank[0], axis=1)[:, rank[0]] if len(diffs) > 1 else np.zeros(0, np.uint32)
    value = np.append(value, np.sort(diffs[-1])[rank[-1]])
    width = np.frexp(value.astype(np.float64))[1]
    out: list[bytes] = [b""] * len(diffs)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        wide = np.dtype("<u2") if w <= 16 else np.dtype("<u4")
        for lo in range(0, len(rows), 64):
            part = rows[lo : lo + 64]
            d = diffs[part]
            if w == 8 * wide.itemsize:
                packed = d.astype(wide).view(np.uint8)
            else:
                bits = np.unpackbits(d.astype(wide).view(np.uint8).reshape(-1, wide.itemsize), axis=1, bitorder="little", count=w or None)
                packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            r_of, c_of = np.nonzero(d >= (1 << w))
            at = np.searchsorted(r_of, np.arange(len(part) + 1))
            c_of, over = c_of.astype("<u2"), d[r_of, c_of].astype("<u4")
            for r, k in enumerate(part.tolist()):
                i, j = at[r], at[r + 1]
                head = np.array((low[k], w, j - i, n[k]), _BLOCK_HEAD).tobytes()
                out[k] = head + packed[r, : (int(n[k]) * w + 7) // 8].tobytes() + c_of[i:j].tobytes() + over[i:j].tobytes()
    return out


def write_shard(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The image of documents whose ids lie end to end, document k from bounds[k] to bounds[k + 1]."""
    if not 0 < block < 1 << 16:
        raise ValueError("a block's counts and positions have 16 bits")
    n_blocks = -(-len(ids) // block)
    padded = np.zeros(n_blocks * block, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n_blocks, block)
    n = np.full(n_blocks, block)
    if n_blocks:
        n[-1] = len(ids) - block * (n_blocks - 1)
        rows[-1, n[-1] :] = rows[-1, 0]
    low = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diffs = rows - low[:, None]
    if n_blocks:
        diffs[-1, n[-1] :] = 0
    images = _pack(diffs, low, n)
    offsets = np.cumsum([0, *map(len, images)])[:-1] if images else np.zeros(0)
    head = _HEAD.pack(b"PFOR", 1, len(doc_ids), len(ids), block, n_blocks)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), bounds[:-1].astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *images])


class Shard:
    """Reads an image; any range of ids through the block index."""

    def __init__(self, image: bytes):
        magic, version, docs, self.n_ids, self.block, self.n_blocks = _HEAD.unpack_from(image)
        if magic != b"PFOR" or version != 1:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.starts = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.index = np.frombuffer(image, "<u8", self.n_blocks, at + 16 * docs)
        self.image, self.base = image, at + 16 * docs + 8 * self.n_blocks

    def read(self, start: int, stop: int) -> np.ndarray:
        """ids from start to stop, through the block index; blocks of one width are unpacked together."""
        first, last = start // self.block, -(-stop // self.block)
        if stop <= start:
            return np.zeros(0, np.uint32)
        at = self.base + self.index[first:last].astype(np.int64)
        heads = np.array([self.image[i : i + _BLOCK_HEAD.itemsize] for i in at.tolist()]).view(_BLOCK_HEAD)
        out = np.zeros((last - first, self.block), np.uint32)
        size = (heads["n"].astype(np.int64) * heads["width"] + 7) // 8
        at += _BLOCK_HEAD.itemsize
        for w, n in set(zip(heads["width"].tolist(), heads["n"].tolist())):
            rows = np.flatnonzero((heads["width"] == w) & (heads["n"] == n))
            step = (n * w + 7) // 8
            raw = np.frombuffer(b"".join([self.image[i : i + step] for i in at[rows].tolist()]), np.uint8).reshape(len(rows), step)
            wide = np.dtype("<u2") if w <= 16 else np.dtype("<u4")
            if w == 8 * wide.itemsize:
                out[rows, :n] = raw.view(wide)
            elif w:
                full = np.zeros((len(rows) * n, 8 * wide.itemsize), np.uint8)
                full[:, :w] = np.unpackbits(raw, axis=1, count=n * w, bitorder="little").reshape(-1, w)
                out[rows, :n] = np.packbits(full, axis=1, bitorder="little").view(wide).reshape(len(rows), n)
        for r in np.flatnonzero(heads["patched"]).tolist():
            p, i = int(heads["patched"][r]), int(at[r] + size[r])
            out[r, np.frombuffer(self.image, "<u2", p, i)] = np.frombuffer(self.image, "<u4", p, i + 2 * p)
        out += heads["low"][:, None]
        return out.ravel()[start - first * self.block : stop - first * self.block]


def _writer(id_col: str, text_col: str, vocabulary: str, leading_space: bool, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        enc = encoder(vocabulary, leading_space)

        def shard():
            nonlocal docs, sizes, held, seq, before
            ids, size = np.concatenate(held), np.concatenate(sizes)
            image = write_shard(np.concatenate(docs), np.concatenate(([0], np.cumsum(size))), ids)
            row = pa.record_batch({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(size)], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "part_start": pa.array([before], pa.int64()), "content": pa.array([image], pa.binary()),
            })
            before, seq, docs, sizes, held = before + len(ids), seq + 1, docs[:0], sizes[:0], held[:0]
            return row

        for batch in batches:
            names = batch.column(batch.schema.get_field_index(id_col)).fill_null(-(2**63)).to_numpy()
            col = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in slices(col):
                ids, bounds = enc.encode_ended(col.slice(lo, hi - lo), end_id)
                k = 0
                while k < hi - lo:  # whole documents, until the shard is full
                    room = SHARD_IDS - sum(map(len, held))
                    j = min(hi - lo, int(np.searchsorted(bounds, bounds[k] + room)))
                    docs.append(names[lo + k : lo + j])
                    sizes.append(np.diff(bounds[k : j + 1]))
                    held.append(ids[bounds[k] : bounds[j]])
                    k = j
                    if sum(map(len, held)) >= SHARD_IDS:
                        yield shard()
        if any(map(len, sizes)):
            yield shard()

    return write


def write_token_table(docs: DataFrame, vocabulary: str, leading_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, end it with end_id and write shards in ascending id order to the shared folder.

    Returns the table of shards: part, seq, n_docs, n_ids, start (ids in all earlier shards) and content.
    Shards hold whole documents; (part, seq) is their order. Null text counts as empty; a null id sorts first
    and is written as the least int64; rows that repeat an id are documents of their own, in any order among
    themselves. Other columns are not read. An empty table gives no shards.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id")
    made = ranged.mapInArrow(_writer("id", "text", vocabulary, leading_space, end_id), "part int, seq int, n_docs bigint, n_ids bigint, part_start bigint, content binary")
    shards = C.materialize(made, "tokens")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row a range partition: the only thing that is put in one sequence
    base = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    return shards.join(F.broadcast(base), "part").select("part", "seq", "n_docs", "n_ids", (F.col("base") + F.col("part_start")).alias("start"), "content")


def _reader(batches):
    for batch in batches:
        for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = Shard(image.as_py())
            ids = s.read(0, s.n_ids).astype("<u4")
            stops = np.append(s.starts[1:], s.n_ids)
            raw = ids.tobytes()
            yield pa.record_batch({
                "id": pa.array(s.doc_ids), "start": pa.array(s.starts + start), "n_tokens": pa.array(stops - s.starts),
                "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(s.starts, stops)], pa.binary()),
            })


def read_token_table(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode shards to one row a document: id_col, start (ids before it), n_tokens, ids (uint32, little-endian)."""
    out = shards.select("start", "content").mapInArrow(_reader, "id bigint, start bigint, n_tokens bigint, ids binary")
    return out.select(F.expr(f"nullif(id, cast({-(2**63)} as bigint))").alias(id_col), "start", "n_tokens", "ids")
