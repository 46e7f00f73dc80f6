"""What the training-data operators share: working tables, column hygiene and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 21


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder of this process; on a cluster that is an error, as
    executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or _own_folder()).rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="siftwell-")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/siftwell-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again, as a round's is once the next is written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that df does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tree_add(parts: DataFrame, add, kind: str) -> list:
    """One sum of rows (slot, ...) for each of 8 slots, added in rounds so that no task or the driver meets many at once.

    slot is the number of the task that made the row; add(key, table) adds rows and keeps slot out of its result.
    """
    for slots in (4096, 128, 8):
        of = parts.withColumn("slot", F.pmod("slot", F.lit(slots)))

        def keep(key, table):
            return add(key, table).append_column("slot", pa.array([key[0].as_py()], pa.int64()))

        parts = of.groupBy("slot").applyInArrow(keep, f"{kind}, slot bigint")
    return parts.drop("slot").collect()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts cross to Python in batches of so many rows: what the JVM and the worker hold at once is a few MB."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


BROADCAST_ROWS = 500_000


def semi_join(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", most: int | None = None) -> DataFrame:
    """Rows of df whose id is (left_anti: is not) in a written table of distinct ids.

    Up to `most` ids (BROADCAST_ROWS if not given), counted first, are broadcast, so that df does not move; more are
    joined by a shuffle.
    """
    ids = ids.select(on)
    return df.join(F.broadcast(ids) if ids.count() <= (BROADCAST_ROWS if most is None else most) else ids, on, how)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that the operator will itself produce (compared without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pow2(n: float) -> int:
    k = 1
    while k < n:
        k *= 2
    return k


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows of df and bytes of text, to size groups and buckets; one scan, two numbers to the driver."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)))).first()
    return int(r[0] or 0), int(r[1] or 0)


def trim(used: int = 1 << 62) -> None:
    """Give freed memory back to the system: a worker lives on after a stage, and with it what its allocators keep."""
    if used < 1 << 19:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES = Powers(0x9E3779B97F4A7C15)
_WORDS = Powers(0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.fill_null("").cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the n + 1 word offsets of the texts.

    Words are maximal runs of bytes outside SPACE; a text's edge ends a word. fold: A-Z count as a-z.
    Temporaries are bounded by the segment (cut at white space) and not by the texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    table = _FOLDED if fold else _TABLE
    hashes, starts_all = [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + _SEGMENT)
        while hi < n and not _IS_SPACE[data[hi]]:
            step = np.flatnonzero(_IS_SPACE[data[hi : hi + 65536]])
            hi = min(n, hi + (int(step[0]) if len(step) else 65536))
        part = data[lo:hi]
        sep = _IS_SPACE[part]
        begin = ~sep
        begin[1:] &= sep[:-1] | cut[lo + 1 : hi]
        end = ~sep
        end[:-1] &= sep[1:] | cut[lo + 1 : hi]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = _BYTES.get(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts_all.append(s + lo)
        lo = hi
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offs)


def windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of one text, and the word index where each starts."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.zeros(len(h), bool)
    sizes = np.diff(bounds)
    for_text = np.repeat(bounds[1:], sizes)
    ok[: len(for_text)] = np.arange(len(for_text)) + k <= for_text
    out, at = [], []
    for lo in range(0, len(h) - k + 1, _SEGMENT):
        part = h[lo : lo + _SEGMENT + k - 1]
        up, down = _WORDS.get(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=total[1:])
        i = np.flatnonzero(ok[lo : lo + len(part) - k + 1])
        out.append(mix((total[i + k] - total[i]) * down[i]))
        at.append(i + lo)
    return np.concatenate(out), np.concatenate(at)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, which shuffle compression shortens."""
    d = a.copy()
    d[1:] -= a[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)
