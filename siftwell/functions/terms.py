"""The terms of texts, counted in Arrow batches: each text is read once and gives each of its terms once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import text as X

_WORDS, _HUMPS = re.compile(X.WORD, re.ASCII), re.compile(X.HUMP)
_PARTED = re.compile("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[0-9][A-Za-z]")  # where a word has pieces, or letters start one right after digits
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
_SLICE = 256  # texts that are counted at a time; bounds what a worker holds beside its batch
_ENTRIES = pa.struct([("term", pa.string()), ("tf", pa.int32())])


@lru_cache(maxsize=1 << 16)
def _pieces(word: str) -> tuple[str, ...]:
    """A word, what stands between its underscores, and its humps if it is in both cases; in lower case."""
    low = word.lower()
    out = [low, *filter(None, low.split("_"))] if "_" in word else [low]
    if word not in (low, word.upper()) and len(humps := _HUMPS.findall(word)) > 1:
        out += [h.lower() for h in humps]
    return tuple(out)


def terms_of(text: str) -> list[str]:
    """functions.text.tokenize for one string, where no DataFrame is at hand."""
    return [piece for word in _WORDS.findall(text) for piece in _pieces(word)]


def counts_of(text: str | None) -> dict[str, int]:
    """How often a text has each of its terms; null has none.

    A text without such places as _PARTED is its words in lower case, all at once.
    """
    if text and not _PARTED.search(text):
        return Counter(text.encode("utf-8", "surrogatepass").translate(_PLAIN).decode("ascii").split())
    out: dict[str, int] = {}
    for word, n in Counter(_WORDS.findall(text or "")).items():
        for piece in _pieces(word):
            out[piece] = out.get(piece, 0) + n
    return out


def counts_arrays(found: list[dict[str, int]]) -> tuple[pa.Array, pa.Array]:
    """dl and entries, as counted() gives them, of texts with these counts."""
    terms, tfs = pa.array([t for f in found for t in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int32())
    ends = [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    entries = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms, tfs], fields=list(_ENTRIES)))
    return pa.array([sum(f.values()) for f in found], pa.int64()), entries


def counted(rows: DataFrame, text: Column, entries: bool = True) -> DataFrame:
    """The rows with dl, how many terms their text has (duplicates counted), and entries, an array of (term, tf), if asked for."""
    given = rows.withColumn("__text", text)
    names = rows.columns
    fields = [*rows.schema.fields, T.StructField("dl", T.LongType())]
    if entries:
        kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
        fields.append(T.StructField("entries", T.ArrayType(kind)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = [counts_of(t) for t in part.column("__text").to_pylist()]
                columns = [*(part.column(n) for n in names), *(counts_arrays(found) if entries else [pa.array([sum(f.values()) for f in found], pa.int64())])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return given.mapInArrow(count, T.StructType(fields))
