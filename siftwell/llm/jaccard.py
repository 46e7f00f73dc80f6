"""N-gram Jaccard join with signature trees.

Two sets of similarity t or more differ in few shingles: in at most (|x| + |y|) (1 - t) / (1 + t). So if the
shingles are dealt by hash to classes and a set has more classes that are not empty than that, it agrees with
each set it links to on one of these classes in full. The top level of the search is this fan-out over (size
range, class, its shingles), which prunes exactly and lists no pairs. Sets that meet there are searched with
signature trees: leaves are documents, nodes hold the OR of their documents' token bitmaps and their size
range, and a dual traversal descends only into pairs of nodes whose largest possible overlap reaches the
threshold. Leaves that remain are compared exactly; only their texts are read again. What meets directly or
through others is a cluster, and clusters of up to BLOCK documents are searched at once.

Documents with a passage in common make large clusters of classes that hold nothing else. There the fan-out is
refined: shingles are put in one order, rare ones of these documents first, and sets that link share one of
the first |x| - ceil(t |x|) + 1 of either. A passage is last in that order, so it brings documents together only
where it is nearly all of them. In clusters that are still large each document is first compared with the
smallest id that it meets, then what is not connected by that with everything else, by blocks or by shingle.

Sets are of 64-bit shingle hashes; equal sets (128-bit sums of mixed hashes, and the size) are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

BLOCK = 96
KEYS_PER_BLOCK = 1 << 19
KEYS_PER_BUCKET = 1 << 20
FAN_OUT = 4
BATCH_ROWS = 1000


class Ranges:
    """Size ranges such that sets of similarity num/100 or more lie in one range or in two next to each other."""

    def __init__(self, num: int, largest: int):
        self.num = num
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // num + 1)
        low.append(low[-1] * 100 // num + 1)
        self.low = np.array(low, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def differ(self, space: np.ndarray) -> np.ndarray:
        """Most shingles in which sets that link can differ, one of them in range `space`, one there or in the next."""
        at = np.clip(space, 0, len(self.low) - 3)
        return (self.low[at + 1] - 1 + self.low[at + 2] - 1) * (100 - self.num) // (100 + self.num)

    def classes(self, space: np.ndarray) -> np.ndarray:
        """Hash classes in that space: enough for nearly all of its sets to fill more than they may differ in."""
        many, which = np.unique(np.clip(space, 0, len(self.low) - 3), return_inverse=True)
        out = []
        for s, d in zip(many.tolist(), self.differ(many).tolist()):
            n, k = int(self.low[s]), d + 1
            while d and k < 4 * d and k * (1 - (empty := np.exp(-n / k))) - 2 * np.sqrt(k * empty) < d + 1:
                k += max(1, d // 64)
            out.append(k)
        return np.array(out, np.int64)[which] if out else np.zeros(0, np.int64)


def shingle_sets(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text and the n + 1 bounds; A-Z count as a-z.

    A text of fewer than k words is one shingle, one without words (or null) has none.
    """
    h, at = C.words(*C.utf8(col), fold=True)
    win, start = C.windows(h, at, k)
    size = np.diff(at)
    short = np.flatnonzero((size > 0) & (size < k))
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = size[short] > j
        whole[has] = C.mix(whole[has] * np.uint64(31) + h[at[short[has]] + j] + np.uint64(j + 1))
    doc = np.concatenate((np.searchsorted(at, start, "right") - 1, short))
    every = np.concatenate((win, whole))
    order = np.lexsort((every, doc))
    doc, every = doc[order], every[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])
    return every[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def _narrow(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _signer(k: int, num: int, width: int = 0):
    """Set sizes and digests of texts, and with a width their keys, one for each class that a set fills."""

    def sign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s, at = shingle_sets(part.column(1), k)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                m = C.mix(s)
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                np.add.at(sums[0], doc, m)
                np.add.at(sums[1], doc, C.mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                cols = {"id": part.column(0), "n": pa.array(n, pa.int64()), "lo": pa.array(sums[0].view(np.int64)), "hi": pa.array(sums[1].view(np.int64))}
                if not width:
                    yield pa.record_batch(cols)
                    continue
                ranges = Ranges(num, int(n.max(initial=1)))
                own = ranges.of(np.maximum(n, 1))
                keys = []
                for space in (own, own - 1):
                    count = np.where((space >= 0) & (n > 0), ranges.classes(space), 0)
                    base = np.cumsum(count) - count
                    of = np.repeat(np.arange(len(n)), count)
                    acc = C.mix(C.mix(space.astype(np.uint64) + np.uint64(1))[of] + (np.arange(len(of)) - base[of]).astype(np.uint64))
                    use = count[doc] > 0
                    place = base[doc[use]] + ((s[use] >> np.uint64(32)) % np.maximum(count[doc[use]], 1).astype(np.uint64)).astype(np.int64)
                    np.add.at(acc, place, m[use])
                    full = np.zeros(len(of), bool)
                    full[place] = True
                    # a set with too few full classes also says which of its classes are empty
                    full |= (np.bincount(of[full], minlength=len(n)) <= ranges.differ(space))[of]
                    keys.append((C.mix(acc[full]), np.searchsorted(of[full], np.arange(len(n) + 1))))
                blobs = [b"".join(_narrow(k[i[j] : i[j + 1]], width) for k, i in keys) for j in range(len(n))]
                bits = []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    one = np.zeros(C.pow2(max(64, 2 * (j - i))), bool)
                    one[(s[i:j] & np.uint64(len(one) - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(one).tobytes())
                yield pa.record_batch(cols | {"keys": pa.array(blobs, pa.binary()), "bits": pa.array(bits, pa.binary())})

    return sign


def _unique_keys(table: pa.Table, width: int):
    """Distinct keys of a block, the least and greatest node of each, and for every key of every node its place among them."""
    nodes = table.column("node").to_numpy()
    blobs = [x.as_py() for x in table.column("keys")]
    every = _widen(b"".join(blobs), width)
    owner = np.repeat(nodes, [len(x) // width for x in blobs])
    u, inverse = np.unique(every, return_inverse=True)
    least, most = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, owner)
    np.maximum.at(most, inverse, owner)
    return u, least, most, inverse, owner


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _slices(u: np.ndarray, n_buckets: int, width: int) -> np.ndarray:
    of = (u >> np.uint64(8 * width - (n_buckets.bit_length() - 1))).astype(np.int64) if n_buckets > 1 else np.zeros(len(u), np.int64)
    return np.searchsorted(of, np.arange(n_buckets + 1))


def _key_sender(n_buckets: int, width: int):
    def send(key, table):
        u, least, most, _, _ = _unique_keys(table, width)
        at = _slices(u, n_buckets, width)
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
            "keys": pa.array([C.pack_sorted(u[at[b] : at[b + 1]]) for b in full], pa.binary()),
            "least": pa.array([_planes(least[at[b] : at[b + 1]]) for b in full], pa.binary()),
            "span": pa.array([_planes((most - least)[at[b] : at[b + 1]]) for b in full], pa.binary()),
        })

    return send


def _key_meeting(key, table):
    """Tells each block the least and greatest node anywhere for those of its keys for which another block's differ."""
    keys = [C.unpack_sorted(x.as_py()) for x in table.column("keys")]
    least = np.concatenate([_from_planes(x.as_py()) for x in table.column("least")])
    most = least + np.concatenate([_from_planes(x.as_py()) for x in table.column("span")])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    first = np.ones(len(every), bool)
    first[1:] = every[order][1:] != every[order][:-1]
    at, group = np.flatnonzero(first), np.cumsum(first) - 1
    low, high = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
    low[order] = np.minimum.reduceat(least[order], at)[group]
    high[order] = np.maximum.reduceat(most[order], at)[group]
    news = (low < least) | (high > most)
    edge = np.cumsum([0, *map(len, keys)])
    spans = [(i, j) for i, j in zip(edge[:-1], edge[1:])]
    some = [r for r, (i, j) in enumerate(spans) if news[i:j].any()]
    told = [(i, j, news[i:j]) for i, j in (spans[r] for r in some)]
    C.trim(len(every))
    return pa.table({
        "block": pa.array(table.column("block").to_numpy()[some], pa.int64()), "bucket": pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
        "bits": pa.array([np.packbits(n).tobytes() for _, _, n in told], pa.binary()),
        "low": pa.array([_planes(low[i:j][n]) for i, j, n in told], pa.binary()),
        "high": pa.array([_planes(high[i:j][n]) for i, j, n in told], pa.binary()),
    })


def _linker(n_buckets: int, width: int):
    """For each node with a key that another has: the least nodes of such keys, and the keys."""

    def link(key, table, answers):
        u, least, most, inverse, owner = _unique_keys(table, width)
        at = _slices(u, n_buckets, width)
        for b, bits, low, high in zip(*(answers.column(c).to_pylist() for c in ("bucket", "bits", "low", "high"))):
            lo, hi = at[b], at[b + 1]
            told = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
            least[lo:hi][told], most[lo:hi][told] = _from_planes(low), _from_planes(high)
        shared = (least < most)[inverse]
        node, k = owner[shared], inverse[shared]
        order = np.lexsort((k, node))
        node, k = node[order], k[order]
        edge = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(node))
        pivots = [np.unique(least[k[i:j]]) for i, j in zip(edge, ends)]
        row = dict(zip(table.column("node").to_pylist(), range(table.num_rows)))
        mine = table.select(["n", "bits"]).take(pa.array([row[x] for x in node[edge].tolist()], pa.int64()))
        longs = pa.list_(pa.int64())
        C.trim(len(inverse))
        return pa.table({
            "node": pa.array(node[edge], pa.int64()), "n": mine.column("n"), "bits": mine.column("bits"),
            "pivots": pa.array([p[p < n] for p, n in zip(pivots, node[edge])], longs),
            "keys": pa.array([np.unique(u[k[i:j]]).view(np.int64) for i, j in zip(edge, ends)], longs),
        })

    return link


def _meet(sets: DataFrame, total: float, width: int, name: str) -> DataFrame:
    """(node, n, bits, pivots, keys) of the nodes of sets (node, n, keys, bits) that share a key; total: keys in all."""
    parts = C.shuffle_partitions(sets.sparkSession)
    n_blocks = max(parts, int(total) // KEYS_PER_BLOCK + 1)
    n_buckets = min(C.pow2(max(parts, total / KEYS_PER_BUCKET)), 1 << (8 * width - 8))
    blocks = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n_blocks)))
    sent = blocks.groupBy("block").applyInArrow(_key_sender(n_buckets, width), "bucket bigint, block bigint, keys binary, least binary, span binary")
    answers = sent.groupBy("bucket").applyInArrow(_key_meeting, "block bigint, bucket bigint, bits binary, low binary, high binary")
    shared = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_linker(n_buckets, width), "node bigint, n bigint, bits binary, pivots array<bigint>, keys array<bigint>")
    return C.materialize(shared, name)


def _clusters(shared: DataFrame, name: str) -> DataFrame:
    """(cluster, node, size): what meets directly or through others."""
    edges = shared.select(F.col("node").alias("a"), F.explode("pivots").alias("b"))
    found = components(edges, name).select(F.col("component").alias("cluster"), F.col("id").alias("node"))
    found = C.materialize(found, name)
    size = C.materialize(found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), f"{name}-sizes")
    return C.materialize(found.join(size, "cluster"), f"{name}-sized")


def _block_shingles(table: pa.Table):
    """Nodes, set sizes and all shingles of a block; its distinct shingles with counts, and the place of each among them."""
    every = np.frombuffer(b"".join(x.as_py() for x in table.column("shingles")), np.uint64)
    return table.column("node").to_numpy(), table.column("n").to_numpy(), every, *np.unique(every, return_inverse=True, return_counts=True)


def _count_sender(n_buckets: int):
    def send(key, table):
        _, _, _, u, _, count = _block_shingles(table)
        at = _slices(u, n_buckets, 8)
        full = np.flatnonzero(np.diff(at))
        C.trim(len(u))
        return pa.table({
            "bucket": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
            "keys": pa.array([C.pack_sorted(u[at[b] : at[b + 1]]) for b in full], pa.binary()),
            "counts": pa.array([_planes(count[at[b] : at[b + 1]].astype(np.int64)) for b in full], pa.binary()),
        })

    return send


def _count_meeting(key, table):
    """Tells each block how many sets have those of its shingles that another block has too."""
    keys = [C.unpack_sorted(x.as_py()) for x in table.column("keys")]
    count = np.concatenate([_from_planes(x.as_py()) for x in table.column("counts")])
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inverse, count)
    news = total[inverse] > count
    edge = np.cumsum([0, *map(len, keys)])
    some = [r for r, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if news[i:j].any()]
    told = [(slice(edge[r], edge[r + 1]), news[edge[r] : edge[r + 1]]) for r in some]
    C.trim(len(inverse))
    return pa.table({
        "block": pa.array(table.column("block").to_numpy()[some], pa.int64()), "bucket": pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
        "bits": pa.array([np.packbits(n).tobytes() for _, n in told], pa.binary()),
        "totals": pa.array([_planes(total[inverse[at]][n]) for at, n in told], pa.binary()),
    })


def _prefixer(n_buckets: int, num: int):
    """For each set the shingles among its first n - ceil(num n / 100) + 1, rare ones first, that another set has too."""

    def prefix(key, table, answers):
        node, n, every, u, inverse, count = _block_shingles(table)
        count = count.astype(np.int64)
        at = _slices(u, n_buckets, 8)
        for b, bits, totals in zip(*(answers.column(c).to_pylist() for c in ("bucket", "bits", "totals"))):
            told = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[b + 1] - at[b]).astype(bool)
            count[at[b] : at[b + 1]][told] = _from_planes(totals)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((every, count[inverse], owner))
        rank = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
        use = (rank < (n + (-num * n) // 100 + 1)[owner]) & (count[inverse][order] > 1)
        keys, bound = every[order][use], np.searchsorted(owner[use], np.arange(len(n) + 1))
        full = np.flatnonzero(np.diff(bound))
        C.trim(len(every))
        return table.select(["node", "n", "bits"]).take(pa.array(full)).append_column("keys", pa.array([keys[bound[k] : bound[k + 1]].tobytes() for k in full], pa.binary()))

    return prefix


def _prefixes(crowd: DataFrame, shared: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, n, bits, keys) of the nodes of crowd whose prefix holds a shingle that another of them has."""
    texts = C.semi_join(rows.withColumnRenamed("id", "node"), crowd, "node")
    # an id on several rows with different texts has several sets: the one that stands for it is found by its size
    sets = texts.mapInArrow(_shingler(shingle), "node bigint, shingles binary").withColumn("n", F.expr("octet_length(shingles) div 8"))
    sets = C.materialize(sets.join(shared.select("node", "n", "bits"), ["node", "n"]), "crowd-sets")
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    parts = C.shuffle_partitions(rows.sparkSession)
    n_blocks, n_buckets = max(parts, total // KEYS_PER_BLOCK + 1), C.pow2(max(parts, total / KEYS_PER_BUCKET))
    blocks = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n_blocks)))
    sent = blocks.groupBy("block").applyInArrow(_count_sender(n_buckets), "bucket bigint, block bigint, keys binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_count_meeting, "block bigint, bucket bigint, bits binary, totals binary")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_prefixer(n_buckets, percent), "node bigint, n bigint, bits binary, keys binary")
    return C.materialize(out, "prefixes")


class SignatureTree:
    """Nodes of FAN_OUT children over token bitmaps, in the order of their bytes, so that like ones are near."""

    def __init__(self, bits: list[bytes], sizes: list[int], width: int):
        rows = np.array([np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in bits])
        order = sorted(range(len(bits)), key=lambda i: rows[i].tobytes())
        words, size = np.ascontiguousarray(rows[order]).view(np.uint64), np.array(sizes, np.int64)[order]
        self.leaf = order
        self.levels = [(words, size, size, size - np.bitwise_count(words).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            words, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def children(self, level: int, i: int) -> list[int]:
        return list(range(i * FAN_OUT, min((i + 1) * FAN_OUT, len(self.levels[level - 1][1]))))


def tree_join(a: SignatureTree, b: SignatureTree, num: int, same: bool, visit) -> None:
    """Dual traversal: visit(i, j) gets each pair of leaves whose largest possible overlap reaches the threshold.

    An overlap is at most the common bits plus the shingles that share a bit with another in one of the sets.
    """
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        wa, lo_a, hi_a, over_a = (x[i] for x in a.levels[la])
        wb, lo_b, hi_b, over_b = (x[j] for x in b.levels[lb])
        if 100 * hi_a < num * lo_b or 100 * hi_b < num * lo_a:
            continue
        most = min(int(np.bitwise_count(wa & wb).sum()) + int(min(over_a, over_b)), int(hi_a), int(hi_b))
        if (100 + num) * most < num * (int(lo_a) + int(lo_b)):
            continue
        if la == 0 and lb == 0:
            x, y = a.leaf[i], b.leaf[j]
            if not same or i < j:
                visit(x, y)
        elif la >= lb and la:
            for c in a.children(la, i):
                # of two nodes of one tree, only the pairs in order are descended into
                if not same or (c * FAN_OUT ** (la - 1)) <= (j + 1) * FAN_OUT**lb:
                    stack.append((la - 1, c, lb, j))
        else:
            stack.extend((la, i, lb - 1, c) for c in b.children(lb, j))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _tasks(table: pa.Table, num: int, connected, visit) -> None:
    """Run the trees of every task of a batch; visit(i, j) gets rows of the table.

    A task holds documents of side 0 alone, to be searched among themselves, or of sides 0 and 1, to be
    searched against each other. connected(rows): whether a task needs no look.
    """
    task, side = table.column("task").to_numpy(), table.column("side").to_numpy()
    size, bits = table.column("n").to_pylist(), table.column("bits")
    order = np.lexsort((side, task))
    for rows in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
        rows = rows.tolist()
        if len(rows) < 2 or connected(rows):
            continue
        maps = {i: bits[i].as_py() for i in rows}
        width = min(map(len, maps.values()))
        groups = [[i for i in rows if side[i] == s] for s in (0, 1)]
        trees = [SignatureTree([maps[i] for i in g], [size[i] for i in g], width) if g else None for g in groups]
        a, b = (0, 1) if trees[0] and trees[1] else (0, 0) if trees[0] else (1, 1)
        tree_join(trees[a], trees[b], num, a == b, lambda x, y, g=groups[a], h=groups[b]: visit(g[x], h[y]))


def _pruner(num: int):
    """The rows of tasks that have a partner of another label, as far as bitmaps and sizes can tell."""

    def prune(key, table):
        label, live = table.column("label").to_pylist(), np.zeros(table.num_rows, bool)

        def visit(i, j):
            if label[i] != label[j]:
                live[i] = live[j] = True

        _tasks(table, num, lambda rows: len({label[i] for i in rows}) < 2, visit)
        return table.select(["task", "node", "side", "label", "n", "bits"]).filter(pa.array(live))

    return prune


def _grouper(num: int):
    """Edges that connect what bitmaps and sizes alone cannot tell apart: a spanning forest of such pairs."""

    def group(key, table):
        nodes, at = np.unique(table.column("node").to_numpy(), return_inverse=True)
        label, union, out = table.column("label").to_pylist(), _Union(len(nodes)), []

        def visit(i, j):
            if label[i] != label[j] and union.join(at[i], at[j]):
                out.append((nodes[at[i]], nodes[at[j]]))

        _tasks(table, num, lambda rows: len({label[i] for i in rows}) < 2, visit)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return group


def _searcher(num: int):
    """Links inside the tasks of a batch, enough to connect what links connect."""

    def search(key, table):
        nodes, blobs = table.column("node").to_numpy(), table.column("shingles")
        labels, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        union, out, sets = _Union(len(labels)), [], {}

        def set_of(i):
            if i not in sets:
                sets[i] = np.frombuffer(blobs[i].as_py(), np.uint64)
            return sets[i]

        def visit(i, j):
            if union.find(label[i]) != union.find(label[j]):
                a, b = set_of(i), set_of(j)
                if (100 + num) * len(np.intersect1d(a, b, assume_unique=True)) >= num * (len(a) + len(b)):
                    union.join(label[i], label[j])
                    out.append((nodes[i], nodes[j]))

        def connected(rows):
            sets.clear()
            return len({union.find(label[i]) for i in rows}) < 2

        _tasks(table, num, connected, visit)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return search


def _shingler(k: int):
    def shingles(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s, at = shingle_sets(part.column(1), k)
                raw = s.tobytes()
                yield pa.record_batch({"node": part.column(0), "shingles": pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:])], pa.binary())})

    return shingles


def _dealt(tasks: DataFrame, n: int):
    """n rows of tasks grouped evenly to batches of whole tasks."""
    batches = max(2 * C.shuffle_partitions(tasks.sparkSession), n // BATCH_ROWS + 1)
    return tasks.withColumn("batch", F.pmod(F.xxhash64("task"), F.lit(batches))).groupBy("batch")


def _search(tasks: DataFrame, shared: DataFrame, rows: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """Links that tasks (task, node, side, label) find, each node in few of them.

    Bitmaps go first: what has no partner by them is left out before any text or set is moved.
    """
    tasks = C.materialize(tasks, name)
    kind = "task bigint, node bigint, side int, label bigint, n bigint, bits binary"
    live = C.materialize(_dealt(tasks.join(shared.select("node", "n", "bits"), "node"), tasks.count()).applyInArrow(_pruner(percent), kind), f"{name}-live")
    nodes = C.materialize(live.select("node").distinct(), f"{name}-nodes")
    texts = C.semi_join(rows.withColumnRenamed("id", "node"), nodes, "node")
    shingled = C.materialize(texts.mapInArrow(_shingler(shingle), "node bigint, shingles binary"), f"{name}-sets")
    return C.materialize(_dealt(live.join(shingled, "node"), live.count()).applyInArrow(_searcher(percent), "a bigint, b bigint"), f"{name}-links")


def _families(tasks: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(node, cluster): the groups that tasks' bitmaps cannot tell apart; every link lies inside one."""
    tasks = C.materialize(tasks, "class-tasks")
    edges = _dealt(tasks.join(shared.select("node", "n", "bits"), "node"), tasks.count()).applyInArrow(_grouper(percent), "a bigint, b bigint")
    return C.materialize(components(C.materialize(edges, "alike"), "alike").select(F.col("id").alias("node"), F.col("component").alias("cluster")), "families")


def _blocks(named: DataFrame, size: int) -> DataFrame:
    """How clusters (node, cluster, label) of several labels divide: the largest label inside, the rest outside."""
    up = lambda n: F.ceil(n / F.lit(size)).cast("int")
    count = C.materialize(named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    one = "18446744073709551616"
    best = F.expr(f"cast(n as decimal(18,0)) * {one} + (9223372036854775807 - cast(label as decimal(20,0)))").cast("decimal(38,0)")
    top = count.groupBy("cluster").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.max(best).alias("best")).where("labels > 1")
    top = top.select("cluster", F.expr(f"cast(9223372036854775807 - best % {one} as bigint)").alias("main"), F.expr(f"cast((best - best % {one}) / {one} as bigint)").alias("inner"), "n")
    top = top.withColumns({"outer": F.col("n") - F.col("inner"), "ins": up(F.col("inner")), "outs": up(F.col("n") - F.col("inner"))})
    return C.materialize(top.withColumn("by_block", F.col("inner") * F.col("outs") + F.col("outer") * (F.col("ins") + F.col("outs"))), "cluster-blocks")


_TASK = ["task", "node", "side", "label"]


def _by_block(named: DataFrame, plan: DataFrame) -> DataFrame:
    """Tasks (i, j): outer block i against inner block j, or against outer block j - ins, itself included."""
    at = named.select("node", "cluster", "label").join(plan.select("cluster", "main", "ins", "outs"), "cluster").withColumn("out", F.col("label") != F.col("main"))
    at = at.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    upto = lambda lo, hi: F.sequence(lo, hi)
    inner = at.where("not out").withColumn("i", F.explode(upto(F.lit(0), F.col("outs") - 1))).withColumn("j", F.col("block")).withColumn("side", F.lit(1))
    partners = F.concat(upto(F.lit(0), F.col("ins") - 1), upto(F.col("ins") + F.col("block"), F.col("ins") + F.col("outs") - 1))
    first = at.where("out").withColumn("i", F.col("block")).withColumn("j", F.explode(partners)).withColumn("side", F.lit(0))
    second = at.where("out and block > 0").withColumn("i", F.explode(upto(F.lit(0), F.col("block") - 1))).withColumn("j", F.col("ins") + F.col("block")).withColumn("side", F.lit(1))
    parts = [x.withColumn("task", F.xxhash64("cluster", "i", "j")).select(*_TASK) for x in (inner, first, second)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _by_class(keyed: DataFrame, several: DataFrame) -> DataFrame:
    """Tasks (class, i, j) of classes (key, blocks) over their nodes (node, label, key)."""
    inside = keyed.join(several, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    first = inside.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(F.xxhash64("key", "block", "other").alias("task"), "node", F.lit(0).alias("side"), "label")
    second = inside.where("block > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).select(F.xxhash64("key", "other", "block").alias("task"), "node", F.lit(1).alias("side"), "label")
    return first.unionByName(second)


def _rest(named: DataFrame, shared: DataFrame, percent: int, size: int) -> DataFrame:
    """Tasks that search large clusters (node, cluster, keys, label) for links between different labels.

    First by bitmaps alone, in the cheaper of two exact ways: by blocks, all that is outside a cluster's largest
    label against everything, or by class, within each class that has several labels. What that cannot tell apart
    are families; a family is one task, or if it is large is searched by blocks.
    """
    top = _blocks(named, size)
    keyed = C.materialize(named.select("node", "cluster", "label", F.explode("keys").alias("key")), "class-labels")
    several = keyed.groupBy("cluster", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    several = C.materialize(several.select("cluster", "key", "n", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("blocks")), "open-classes")
    by_class = several.groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias("by_class"))
    plan = C.materialize(top.join(by_class, "cluster").withColumn("blockwise", F.col("by_block") <= F.col("by_class")), "cluster-plans")
    open_keys = several.join(plan.where("not blockwise").select("cluster"), "cluster", "left_semi").select("key", "blocks")
    family = _families(_by_block(named, plan.where("blockwise")).unionByName(_by_class(keyed, open_keys)), shared, percent)
    inside = C.materialize(family.join(named.select("node", "label"), "node"), "family-labels")
    count = C.materialize(inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "family-sizes")
    small = inside.join(count.where(F.col("n") <= size).select("cluster"), "cluster", "left_semi")
    large = inside.join(count.where(F.col("n") > size).select("cluster"), "cluster", "left_semi")
    return small.select(F.xxhash64("cluster").alias("task"), "node", F.lit(0).alias("side"), "label").unionByName(_by_block(large, _blocks(large, size)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union; return components.

    Words are maximal runs outside [\\x20\\x09-\\x0D], A-Z lower-cased. Returns id_col, n_shingles and
    component_id (the smallest id reachable by links), one row per row of docs. Null texts and texts without
    words have no shingles and link with nothing. Ids name documents: rows that repeat an id with another text
    share a component by equal texts, and by near links of one of the texts at least. A null id links with
    nothing and has a null component. Other columns are not read. No link between documents is lost: every
    pass over pairs is exact.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    C.small_batches(docs.sparkSession)
    sig = C.materialize(rows.mapInArrow(_signer(shingle, percent), "id bigint, n bigint, lo bigint, hi bigint"), "signatures")
    sets = C.materialize(sig.where("n > 0 and id is not null").groupBy("lo", "hi", "n").agg(F.min("id").alias("node")), "sets")
    # ---- nodes that agree on a class; equal sets have equal keys
    total = int(sets.agg(F.sum("n")).first()[0] or 0) * 2.6 * (100 - percent) / (100 + percent)
    # so many bytes that a few thousand pairs of different keys at most look alike, which costs a look and no more
    width = min(8, max(4, int(-(-(2 * np.log2(max(total, 2)) - 12) // 8))))
    keyed = rows.mapInArrow(_signer(shingle, percent, width), "id bigint, n bigint, lo bigint, hi bigint, keys binary, bits binary").where("n > 0 and id is not null")
    reps = keyed.groupBy("lo", "hi", "n").agg(F.min("id").alias("node"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    shared = _meet(reps.select("node", "n", "keys", "bits"), total, width, "shared-classes")
    cluster = _clusters(shared, "clusters")
    small = cluster.where(F.col("size") <= block).select("node", "cluster")
    crowd = cluster.where(F.col("size") > block).select("node")
    refined = not crowd.isEmpty()
    if refined:
        crowd = C.materialize(crowd, "crowd")
        prefixes = _prefixes(crowd, shared, rows, shingle, percent)
        met = _meet(prefixes, prefixes.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0, 8, "shared-prefixes")
        cluster = _clusters(met, "prefix-clusters")
        small = small.unionByName(cluster.where(F.col("size") <= block).select("node", "cluster"))
    # ---- first pass: small clusters as they are; in large ones every node against its least pivot
    tasks = small.select(F.xxhash64("cluster").alias("task"), "node", F.lit(0).alias("side"), F.col("node").alias("label"))
    any_large = refined and not cluster.where(F.col("size") > block).isEmpty()
    if any_large:
        large = met.join(cluster.where(F.col("size") > block), "node")
        large = C.materialize(large, "large-clusters")
        pairs = C.materialize(large.where(F.size("pivots") > 0).select("node", F.array_min("pivots").alias("pivot")), "pivots")
        stars = C.materialize(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")), "pivot-sizes")
        task = F.xxhash64("pivot", "block")
        outer = pairs.join(stars, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(task.alias("task"), "node", F.lit(1).alias("side"), F.col("node").alias("label"))
        pivots = stars.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(task.alias("task"), F.col("pivot").alias("node"), F.lit(0).alias("side"), F.col("pivot").alias("label"))
        tasks = tasks.unionByName(outer).unionByName(pivots)
    links = _search(tasks, shared, rows, shingle, percent, "first-pass")
    labels = C.materialize(components(links, "links"), "labels")
    # ---- second pass: what is not connected yet in large clusters
    if any_large:
        named = large.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "cluster", "keys", F.coalesce("component", "node").alias("label"))
        more = _search(_rest(C.materialize(named, "large-labels"), shared, percent, block), shared, rows, shingle, percent, "second-pass")
        if not more.isEmpty():
            labels = C.materialize(components(links.unionByName(more), "all-links"), "labels")
    found = sets.join(labels, sets.node == labels.id, "left").select("lo", "hi", "n", F.coalesce("component", "node").alias("found"))
    out = sig.join(found, ["lo", "hi", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("found", "id")).alias("component_id"))
