"""Vectorised text kernels for Arrow batches: pieces, words, lines, rolling hashes.

A piece is a run of rows of one Arrow string column, small enough that the working arrays stay in a few tens of
megabytes (a longer single row is a piece of its own). Everything works on UTF-8 bytes; hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_RADIX = 0xD6E8FEB86659FD93
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _MULT)


#: Bytes by role: separators of word definitions, and A-Z folded to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Not a letter, digit or non-ASCII character, once lower-cased.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[65:91] = NOT_ALNUM[128:] = False

_RAW = stream(256, 7)
_FOLDED = _RAW[LOWER]
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, radix in (("up", _RADIX), ("down", _RADIX_INVERSE)):
            steps = np.full(size, radix, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Piece:
    """Some rows of a string column: their bytes, one after the other, and where each row begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1

    def spans_where(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the maximal runs of true bytes; no run crosses a row's edge."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none
        edges = self.offsets[1:-1]
        edges = edges[edges < len(inside)]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.spans_where(~separators[self.data])

    def per_row(self, starts: np.ndarray) -> np.ndarray:
        """For sorted span starts: the first span of each row, and the number of spans as last entry."""
        return np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
        """Hashes of spans' bytes, A-Z folded or not."""
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_FOLDED if folded else _RAW)[self.data] * up[: len(self.data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; of the whole sequence, if it is shorter and not empty."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    steps = stream(width, 11) | np.uint64(1)
    total = np.full(n, (width * int(_MULT)) % (1 << 64), np.uint64)
    for k in range(width):
        total += words[k : k + n] * steps[k]
    return mixed(total)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Piece]]:
    """(first row, end row, piece) over a whole column."""
    data, offsets = text_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def with_columns(df: DataFrame, fields: list[T.StructField], kernel: Callable[[pa.RecordBatch, Piece, int, int], list], text: str = "text") -> DataFrame:
    """Append the columns that kernel makes of each row's text; columns of df with the same names give way.

    kernel(batch, piece, i, j) returns one Arrow array or list for each field, over rows i to j of the batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    if text.lower() in taken or text not in df.columns:
        raise ValueError(f"needs the text column {text!r}, apart from the columns that it adds")
    schema = T.StructType([*kept, *fields])
    names, added = [f.name for f in kept], to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text)
            for i, j, piece in pieces(batch.column(at)):
                part = batch.slice(i, j - i)
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(kernel(part, piece, i, j), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *added.names])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Flat values cut into one list for each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges that begin at starts."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)
