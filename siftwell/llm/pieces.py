"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation into pieces (largest sum of scores) is found boundary by boundary. Kept are the text and
the back-pointers since the last commit only: a window of the longest piece's length and what is not committed.
Survivors are the boundaries ahead that some piece reaches; where the back-pointer paths of all of them meet in
one boundary, everything before it is committed. Characters that no piece covers fall back to bytes.

Pieces of such models hold their word mark at the start alone, or are runs of marks. So before a mark that
follows no other, every path meets: the ids of a text without runs are those of its words, and each worker
keeps the words that it has met, in a bounded cache.
"""

from __future__ import annotations

import itertools
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
CACHE_WORDS = 300_000
STEP_BYTES = 4 << 20
SLICE = 1024
_UNKNOWN_PENALTY = 10.0
_NORMAL, _BYTE = 1, 6


def _fields(raw: bytes):
    """Fields of a protocol buffer message: (number, value); groups do not occur."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file; a trie of the normal pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(got.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(got.get(3, _NORMAL))
        self.bytes = [0] * 256
        self.trie: dict = {}
        normal = [k == _NORMAL for k in self.kinds]
        self.unknown = min(s for s, n in zip(self.scores, normal) if n) - _UNKNOWN_PENALTY
        self.out = [b""] * len(self.pieces)
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == _BYTE:
                self.bytes[int(piece[3:-1], 16)] = i
                self.out[i] = bytes([int(piece[3:-1], 16)])
            elif kind == _NORMAL:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
                self.out[i] = piece.replace(MARK, " ").encode()
        self.longest = max(len(p) for p, n in zip(self.pieces, normal) if n)
        self.by_word = not any(n and MARK in p[1:] and p.strip(MARK) for p, n in zip(self.pieces, normal))
        self.known: dict[str, bytes] = {}

    def stream(self, chunks):
        """Ids of a text that comes in pieces, in lists as they are committed; the text has its marks already.

        A boundary is expanded once the longest piece from it is at hand. The window slides on when all paths
        to boundaries still reachable meet; where no piece runs past a boundary, they meet there. Where paths do
        not meet yet, the next look comes when the window is twice as long, so that all looks together take time
        in proportion to the text, and the window has at most twice the length that the paths need.
        """
        text, best, back = [], [0.0], [None]  # since the last commit
        trie, scores, longest, unknown = self.trie, self.scores, self.longest, self.unknown
        s = reach = 0
        look = 2 * longest
        for chunk in itertools.chain(chunks, (None,)):
            text += chunk or ""
            end = len(text)
            best += [-1e300] * (end + 1 - len(best))
            back += [None] * (end + 1 - len(back))
            stop = end if chunk is None else end - longest + 1
            while s < stop:
                base, node, e, single = best[s], trie, s, False
                while e < end:
                    node = node.get(text[e])
                    if node is None:
                        break
                    e += 1
                    i = node.get("")
                    if i is not None:
                        single |= e == s + 1
                        score = base + scores[i]
                        if score > best[e]:
                            best[e], back[e] = score, (s, i)
                        if e > reach:
                            reach = e
                if not single:
                    if base + unknown > best[s + 1]:
                        best[s + 1], back[s + 1] = base + unknown, (s, None)
                    reach = max(reach, s + 1)
                s += 1
                if s >= look or reach == s >= 2 * longest:
                    meet = self._meet(back, [e for e in range(s, reach + 1) if back[e]])
                    look = 2 * max(longest, s - meet)
                    if meet:
                        yield self._ids(text, back, meet)
                        zero = best[meet]
                        text, s, reach, end, stop = text[meet:], s - meet, reach - meet, end - meet, stop - meet
                        best = [x - zero for x in best[meet:]]
                        back = [None, *((j - meet, i) if b else None for b in back[meet + 1 :] for j, i in [b or (0, 0)])]
        if text:
            yield self._ids(text, back, len(text))

    @staticmethod
    def _meet(back, survivors: list[int]) -> int:
        """The last boundary on the paths of all survivors."""
        ahead = [-e for e in survivors]
        heapify(ahead)
        while len(ahead) > 1:
            last = -heappop(ahead)
            if ahead[0] != -last:  # else another path came to the same boundary
                heappush(ahead, -back[last][0])
        return -ahead[0]

    def _ids(self, text: str, back, end: int) -> list[int]:
        out = []
        while end:
            start, i = back[end]
            out += [i] if i is not None else [self.bytes[b] for b in reversed("".join(text[start:end]).encode())]
            end = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, which goes to stream() in slices, so that its tables cover a slice and what is not committed."""
        slices = ((MARK if at == 0 else "") + text[at : at + SLICE].replace(" ", MARK) for at in range(0, len(text), SLICE))
        return [i for ids in self.stream(slices) for i in ids]

    def decode(self, ids) -> str:
        """The text; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def encode_column(self, col) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string column and the n + 1 bounds of its texts; null and empty texts have none."""
        col = col.fill_null("").cast(pa.large_string())
        full = pc.binary_length(col).to_numpy(zero_copy_only=False)
        size = np.concatenate(([0], np.cumsum(full)))
        ids, bounds, lo = [], [np.zeros(1, np.int64)], 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + STEP_BYTES, "right")) - 1)
            part = col.slice(lo, hi - lo)
            # runs of marks can be pieces: such texts are segmented whole
            odd = np.flatnonzero(pc.match_substring_regex(part, f"^[ {MARK}]|[ {MARK}][ {MARK}]").to_numpy(zero_copy_only=False))
            aside = [np.array(self.encode(t), np.uint32).tobytes() for t in part.take(pa.array(odd)).to_pylist()]
            if len(odd):
                part = pc.if_else(pa.array(~np.isin(np.arange(hi - lo), odd)), part, "")
            lists = pc.split_pattern(part, " ")
            at = lists.offsets.to_numpy().astype(np.int64)
            at -= at[0]
            coded = lists.flatten().dictionary_encode()
            table = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            code = coded.indices.to_numpy().copy()
            code[at[:-1][full[lo:hi] == 0]] = len(table)
            code[at[odd]] = len(table) + 1 + np.arange(len(odd))
            table += [b"", *aside]
            n = np.fromiter(map(len, table), np.int64, len(table)) // 4
            ids.append(np.frombuffer(b"".join(map(table.__getitem__, code.tolist())), np.uint32))
            bounds.append(np.concatenate(([0], np.cumsum(n[code])))[at][1:] + bounds[-1][-1])
            lo = hi
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(bounds)

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        out = []
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                ids = np.array(self.encode(w) if w else [self.trie[MARK][""]], np.uint32).tobytes()
                if len(w) <= 64:
                    self.known[w] = ids
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model a worker and file."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids) of every row; ids are uint32, little-endian. Null and empty texts have no ids.

    Repeated rows are encoded each; a null id is kept; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        model = piece_model(model_path)
        for b in batches:
            if model.by_word:
                ids, at = model.encode_column(b.column(1))
            else:
                each = [np.array(model.encode(t or ""), np.uint32) for t in b.column(1).to_pylist()]
                ids, at = np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
            raw = ids.tobytes()
            yield pa.record_batch({"id": b.column(0), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids": pa.array([raw[4 * i : 4 * j] for i, j in zip(at[:-1], at[1:])], pa.binary())})

    return rows.mapInArrow(run, "id bigint, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of encoded rows, id_col of any type; null ids give a null text."""
    rows = encoded.select(F.col(f"`{id_col}`"), "ids")

    def run(batches):
        model = piece_model(model_path)
        for b in batches:
            text = [None if x is None else model.decode(np.frombuffer(x, np.uint32).tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col]]).add("text", "string"))
