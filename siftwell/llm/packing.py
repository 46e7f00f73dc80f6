"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task gathers whole documents until their tails (what is left after full windows) fill GROUP_WINDOWS
windows less some slack, cuts the tails into pieces and partitions these into that many windows: each piece
begins as a partial partition of its own, and the two partial partitions with the largest imbalances are
merged over and over, largest window against smallest. If a window then exceeds the capacity, the window
count rises by one and the group is partitioned again.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .encode import encoder, slices, spans

CAPACITY = 2048
PIECE = 512
GROUP_WINDOWS = 96
SLACK = 8  # tokens a window


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows of near-equal sums.

    A partial partition holds its non-empty windows alone, largest first, so that all of them together hold no
    more than the items; a window's items are a tree of pairs until the end.
    """
    heap, made = [(-n, i) for i, n in enumerate(sizes)], {i: ([n], [i]) for i, n in enumerate(sizes)}
    heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heappop(heap), heappop(heap)
        (sa, la), (sb, lb) = made.pop(a), made.pop(b)
        alone = max(0, k - len(sb))  # windows of a, from the largest, that meet none of b
        sums, items = sa[:alone], la[:alone]
        for j in range(alone, len(sa)):
            sums.append(sa[j] + sb[k - 1 - j])
            items.append((la[j], lb[k - 1 - j]))
        rest = k - max(alone, len(sa))
        sums += sb[:rest]
        items += lb[:rest]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[j] for j in order], [items[j] for j in order]
        made[new] = (sums, items)
        heappush(heap, ((sums[-1] if len(sums) == k else 0) - sums[0], new))
        new += 1
    out = []
    for tree in made[heap[0][1]][1] if heap else []:
        todo, window = [tree], []
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                window.append(x)
        out.append(window)
    return out + [[] for _ in range(k - len(out))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the least possible count upwards, that differencing fills within capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = [w for w in differencing(sizes, k) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k += 1


class _Packer:
    """Turns documents into rows (document, start, length, sequence, offset) group by group."""

    def __init__(self, capacity: int, piece: int, group: int):
        self.capacity, self.piece, self.group, self.next = capacity, piece, group, 0
        self.pieces: list[tuple[int, int, int]] = []
        self.held = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int, n: int) -> None:
        at = 0
        while n - at >= self.capacity:
            self.rows.append((doc, at, self.capacity, self.next, 0))
            self.next += 1
            at += self.capacity
        room = self.group * (self.capacity - SLACK)
        while at < n:
            size = min(n - at, self.piece, room - self.held)
            self.pieces.append((doc, at, size))
            self.held += size
            at += size
            if self.held >= room:
                self.close()

    def close(self) -> None:
        if not self.pieces:
            return
        for window in windows_for([p[2] for p in self.pieces], self.capacity):
            offset = 0
            for i in sorted(window):
                doc, at, size = self.pieces[i]
                self.rows.append((doc, at, size, self.next, offset))
                offset += size
            self.next += 1
        self.pieces, self.held = [], 0


def _packer(id_col: str, text_col: str, vocabulary: str, leading_space: bool, end_id: int, capacity: int, piece: int, group: int):
    def pack(batches):
        from pyspark import TaskContext

        enc, packer = encoder(vocabulary, leading_space), _Packer(capacity, piece, group)
        first = TaskContext.get().partitionId() << 40
        # documents whose ids are still to go out: the number of the first, names, bounds, and the ids end to end
        before, names, bounds, ids = 0, [], np.zeros(1, np.int64), np.zeros(0, np.uint32)

        def rows():
            nonlocal before, names, bounds, ids
            r = np.array(packer.rows, np.int64).reshape(-1, 5)
            packer.rows = []
            done, size = r[:, 0] - before, r[:, 2]
            data, end = ids[spans(bounds[done] + r[:, 1], size)].astype("<u4"), np.concatenate(([0], 4 * np.cumsum(size)))
            out = pa.record_batch({
                "id": pa.array([names[k] for k in done.tolist()], pa.int64()), "start": pa.array(r[:, 1]), "length": pa.array(size),
                "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(end), pa.py_buffer(data)]).cast(pa.binary()),
                "doc_tokens": pa.array(np.diff(bounds)[done]), "sequence_id": pa.array(first + r[:, 3]), "offset": pa.array(r[:, 4]),
            })
            drop = (packer.pieces[0][0] - before) if packer.pieces else len(names)
            before, names, ids, bounds = before + drop, names[drop:], ids[bounds[drop] :].copy(), bounds[drop:] - bounds[drop]
            return out

        for batch in batches:
            ids_col, col = batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in slices(col):
                more, at = enc.encode_ended(col.slice(lo, hi - lo), end_id)
                doc = before + len(names)
                names += ids_col.slice(lo, hi - lo).to_pylist()
                ids, bounds = np.concatenate((ids, more)), np.concatenate((bounds, bounds[-1] + at[1:]))
                del more
                for k, n in enumerate(np.diff(at).tolist()):
                    packer.add(doc + k, n)
                if packer.rows:
                    yield rows()
        packer.close()
        if packer.rows:
            yield rows()

    return pack


def pack_sequences(docs: DataFrame, vocabulary: str, leading_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Encode every text, end it with end_id and pack all ids into sequences of at most `capacity`.

    Returns a row for each piece: id_col, start (its document's ids before it), length, ids (uint32, little-
    endian), doc_tokens, sequence_id and offset (in the sequence, gapless from 0). Every id lies in exactly
    one piece. Null text counts as empty and makes one piece, the end id. A null id is kept; rows that repeat
    an id are documents of their own. Other columns are not read. An empty table gives no pieces. No row
    moves between tasks, and a task holds one group of windows at a time.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(
        _packer("id", "text", vocabulary, leading_space, end_id, capacity, piece, group_windows),
        "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
    return out.withColumnRenamed("id", id_col)
