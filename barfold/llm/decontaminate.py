"""Benchmark decontamination: Wu-Manber multi-pattern search of benchmark word windows in documents.

Texts become lower-case words joined by single spaces, and each window of benchmark words one pattern. Patterns of like
length form a class with the shortest length m. A table holds, for each hashed block of bytes, how far the search may
move on because the block ends no nearer to the end of any pattern's first m bytes; where it may not move, the patterns
with that block as suffix of their first m bytes are compared with the text. Many cursors, each over a stretch of the
text, move in lock-step as numpy arrays, so that the skips are kept and no Python loop runs over positions.

The benchmark is taken in blocks of at most BLOCK_BYTES of text: only one block is broadcast at a time, and documents
pass once for each block, with the table written between two passes.

Defined cases: a null or empty text has no words and no hits; an item without id, text or words is none; items with the
same id count as one; repeated documents are separate rows; an empty table of either kind gives no hits; input columns
named like the added ones are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.llm.shared import written
from barfold.llm.text import LOWER, NOT_ALNUM, Piece, expand, lists, pieces, with_columns

#: Most bytes of benchmark text searched for, and broadcast, in one pass.
BLOCK_BYTES = 16 << 20
#: Patterns below this many bytes are searched apart, so that they don't shorten the skips of the others.
SHORT = 24
#: A cursor's stretch of text, in bytes.
STRETCH = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalised(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words of all rows, each after a space, each row closed by a space and byte 1; where each word's space
    is; and the first word of each row."""
    starts, ends = piece.words(NOT_ALNUM)
    first = piece.per_row(starts)
    closing = np.zeros(len(starts), np.int64)
    closing[first[1:][first[1:] > first[:-1]] - 1] = 2
    size = ends - starts + 1 + closing
    place = np.cumsum(size) - size
    out = np.full(int(size.sum()) + 8, 0x20, np.uint8)
    out[-8:] = 1
    out[expand(place + 1, ends - starts)] = LOWER[piece.data[expand(starts, ends - starts)]]
    last = closing > 0
    out[(place + size)[last] - 1] = 1
    return out, place, first


def windows(texts: list[str], width: int) -> list[list[tuple[bytes, int]]]:
    """For each item its windows: pattern and number of words."""
    out: list[list[tuple[bytes, int]]] = []
    for _, _, piece in pieces(pa.array(texts, pa.string())):
        starts, ends = piece.words(NOT_ALNUM)
        first = piece.per_row(starts)
        low = LOWER[piece.data].tobytes()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = [low[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            k = min(width, len(words))
            out.append([(b" " + b" ".join(words[i : i + k]) + b" ", k) for i in range(len(words) - k + 1)] if words else [])
    return out


@dataclass
class LengthClass:
    """Shift and bucket tables of patterns of like length."""

    patterns: list[bytes]
    ids: np.ndarray

    def __post_init__(self):
        self.m = min(map(len, self.patterns))
        self.block = min(8, max(1, self.m // 2))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(-1, self.m)
        reach = self.m - self.block
        codes = np.zeros((len(heads), reach + 1), np.uint64)
        for k in range(self.block):
            codes |= heads[:, k : k + reach + 1].astype(np.uint64) << np.uint64(8 * k)
        bits = int(np.clip(np.ceil(np.log2(codes.size * 4)), 12, 22))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, reach + 1, np.int64)
        np.minimum.at(self.shift, self._slot(codes), np.broadcast_to(reach - np.arange(reach + 1), codes.shape))
        self.reach = reach
        order = np.argsort(codes[:, reach], kind="stable")
        self.suffix, self.order = codes[order, reach], order

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MULT) >> self.down).astype(np.int64)

    def search(self, text: np.ndarray, raw: bytes) -> tuple[list[int], list[int]]:
        """Places and patterns (as positions in ids) of all occurrences."""
        if len(text) < self.m + 8:
            return [], []
        codes = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        at = np.arange(self.reach, len(codes), STRETCH)
        end = np.minimum(at + STRETCH, len(codes))
        stops = []
        while len(at):
            skip = self.shift[self._slot(codes[at] & self.mask)]
            stops.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        stop = np.concatenate(stops)
        value = codes[stop] & self.mask
        low, high = np.searchsorted(self.suffix, value, "left"), np.searchsorted(self.suffix, value, "right")
        begin = np.repeat(stop - self.reach, high - low).tolist()
        found = self.order[expand(low, high - low)].tolist()
        hits = [(a, p) for a, p in zip(begin, found, strict=True) if raw.startswith(self.patterns[p], a)]
        return [a for a, _ in hits], [p for _, p in hits]


class Searcher:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        names = sorted({name for name, _ in items})
        index = {name: k for k, name in enumerate(names)}
        owners: dict[bytes, set[int]] = {}
        words: dict[bytes, int] = {}
        for (name, _), found in zip(items, windows([t for _, t in items], width), strict=True):
            for pattern, k in found:
                owners.setdefault(pattern, set()).add(index[name])
                words[pattern] = k
        every = sorted(owners)
        self.names = np.array(names, object)
        self.words = np.array([words[p] for p in every], np.int64)
        self.count = np.array([len(owners[p]) for p in every], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owners = np.array([o for p in every for o in sorted(owners[p])], np.int64)
        self.classes = []
        for some in ([k for k, p in enumerate(every) if len(p) < SHORT], [k for k, p in enumerate(every) if len(p) >= SHORT]):
            if some:
                self.classes.append(LengthClass([every[k] for k in some], np.array(some)))

    def search(self, piece: Piece) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Words in each row, spans of hit words (begin, end), and the items with windows there."""
        text, place, first = normalised(piece)
        raw = text.tobytes()
        begin, pattern = [], []
        for group in self.classes:
            a, p = group.search(text, raw)
            begin += a
            pattern += group.ids[p].tolist() if p else []
        spans: list[list[tuple[int, int]]] = [[] for _ in range(piece.rows)]
        items: list[list[str]] = [[] for _ in range(piece.rows)]
        if begin:
            word = np.searchsorted(place, np.array(begin))
            pattern = np.array(pattern)
            depth = np.zeros(len(place) + 1, np.int64)
            np.add.at(depth, word, 1)
            np.add.at(depth, word + self.words[pattern], -1)
            hit = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            row = np.searchsorted(first, edge[::2], "right") - 1
            # A run may go on over a row's edge where a row begins with a hit.
            for a, b, r in zip(edge[::2].tolist(), edge[1::2].tolist(), row.tolist(), strict=True):
                while a < b:
                    stop = min(b, int(first[r + 1]))
                    if stop > a:
                        spans[r].append((a - int(first[r]), stop - int(first[r])))
                    a, r = max(a, stop), r + 1
            of = np.repeat(np.searchsorted(first, word, "right") - 1, self.count[pattern])
            for r, k in sorted(set(zip(of.tolist(), self.owners[expand(self.first[pattern], self.count[pattern])].tolist(), strict=True))):
                items[r].append(self.names[k])
        return np.diff(first), spans, items


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN, False)),
    T.StructField("hit_items", T.ArrayType(T.StringType(), False)),
]


#: The searcher of the block in hand, once for each worker.
_MEMORY: dict[str, Searcher] = {}


def _pass(df: DataFrame, items: list[tuple[str, str]], width: int, text: str, earlier: bool) -> DataFrame:
    broadcast = df.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def kernel(batch: pa.RecordBatch, piece: Piece, i: int, j: int) -> list:
        if key not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[key] = Searcher(broadcast.value, width)
        counts, spans, names = _MEMORY[key].search(piece)
        if earlier:
            before = batch.column(batch.schema.names.index("_earlier")).to_pylist()
            spans = [_united([*((s["start"], s["end"]) for s in b["hit_spans"]), *s2]) for b, s2 in zip(before, spans, strict=True)]
            names = [sorted({*b["hit_items"], *n}) for b, n in zip(before, names, strict=True)]
        size = np.array([len(s) for s in spans])
        flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
        return [counts, lists(pairs, size, pairs.type), pa.array(names, pa.list_(pa.string()))]

    return with_columns(df, FIELDS, kernel, text)


def _blocks(known: DataFrame, block_bytes: int) -> int:
    """Number of blocks by hash of which none is much larger than asked for, unless by a single item."""
    size = known.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    while blocks > 1:
        each = known.groupBy(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)).alias("b")).agg(F.sum(F.octet_length("words")).alias("size"), F.count("*").alias("n"))
        if (each.filter("n > 1").agg(F.max("size")).first()[0] or 0) <= 2 * block_bytes:
            break
        blocks *= 2
    return blocks


def search(df: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append n_words, hit_spans (runs of hit words: begin, end) and hit_items (ids as strings, sorted) to documents."""
    known = items.select(F.col(f"`{item}`").cast("string").alias("name"), F.col(f"`{item_text}`").alias("words")).dropna().distinct()
    blocks = _blocks(known, block_bytes)
    out = df
    for b in range(blocks):
        some = known.filter(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == b) if blocks > 1 else known
        rows = [(r.name, r.words) for r in some.collect()]  # one block, bounded above
        if b:
            out = written(out).withColumn("_earlier", F.struct("hit_spans", "hit_items"))
        out = _pass(out, rows, width, text, earlier=b > 0)
        if b:
            out = out.drop("_earlier")
    return out
