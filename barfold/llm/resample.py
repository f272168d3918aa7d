"""Target-distribution importance resampling: draw the documents whose features look most like a target's.

Features are all runs of one to three consecutive words, hashed into BUCKETS by their CRC-32. Two arrays of bucket
counts, of the documents and of the target, give each bucket a gain (a smoothed log ratio, in thousandths, floored); a
document's weight is the sum of the gains of its features, read off the array. A Gumbel term made from the id turns the
highest scores into a draw without replacement.

The k highest are found by a distributed quickselect, not by a sort of all documents: PIVOTS random keys of the rows
still in question, exact counts of the rows before and at each pivot in one pass, and the interval with the k-th key is
kept. Keys are (score, id, row), so they are unique and the k-th one is a row. Winners alone are then sorted and ranked.

Each pass runs over Arrow batches with numpy: CRCs of words in lock-step, those of runs combined from their words' by
shift tables, so no feature is ever a string. A task emits one row for each bucket; the driver holds 2 * BUCKETS counts
and PIVOTS keys. Memory is bounded by an Arrow batch and its largest text.

Defined cases: a null or empty text has no words, weight 0; a row without id has no score and is never drawn or counted;
repeated rows are rows of their own, and of equal keys those first in the stored table win; an empty target gives gains
from the documents alone; an empty table gives an empty one. Only id and text are read, so other columns don't clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.shared import written
from barfold.llm.text import LOWER, NOT_ALNUM, Piece, expand, pieces

BUCKETS = 10_000
#: Longest run of words that is a feature.
MOST_WORDS = 3
#: Random keys that a pass of the selection counts against.
PIVOTS = 32
#: Words up to this many bytes go in lock-step, longer ones by themselves.
SHORT = 64

#: CRC-32 as zip files have it: the reversed polynomial, a fixed value.
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), reg >> np.uint32(1))
    return reg


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what byte k of value v of a CRC becomes after n more zero bytes."""
    reg = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
    out = [reg]
    for _ in range(SHORT):
        reg = (reg >> np.uint32(8)) ^ _TABLE[reg & np.uint32(255)]
        out.append(reg)
    return np.array(out)


_SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs as they count towards that of a string that goes on for so many bytes."""
    crc, left = crc.copy(), length.astype(np.int64)
    todo = np.arange(len(crc))
    while len(todo):
        step, c = np.minimum(left, SHORT), crc[todo]
        byte = [_SHIFTS[step, k, (c >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
        crc[todo] = byte[0] ^ byte[1] ^ byte[2] ^ byte[3]
        more = left > SHORT
        todo, left = todo[more], left[more] - SHORT
    return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    longer = int(np.searchsorted(-size[order], -SHORT, "left"))
    for w in order[:longer].tolist():
        out[w] = zlib.crc32(data[starts[w] : ends[w]].tobytes())
    order = order[longer:]
    at, length = starts[order], size[order]
    reg = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, "left"))  # spans with more than k bytes
        now = reg[:n]
        reg[:n] = (now >> np.uint32(8)) ^ _TABLE[(now ^ data[at[:n] + k]) & np.uint32(255)]
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def features(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its row, words of each row) of a piece's texts."""
    data = LOWER[piece.data]
    starts, ends = piece.words(NOT_ALNUM)
    first = piece.per_row(starts)
    words = np.diff(first)
    row = np.repeat(np.arange(piece.rows), words)
    size = ends - starts
    crc = word_crcs(data, starts, ends)
    space = (crc ^ np.uint32(0xFFFFFFFF)) if len(crc) else crc
    space = ((space >> np.uint32(8)) ^ _TABLE[(space ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)
    found, rows = [crc], [row]
    run = crc
    for width in range(2, MOST_WORDS + 1):  # run: the first width - 1 words from here
        n = len(crc) - width + 1
        if n <= 0:
            break
        here = np.flatnonzero(row[:n] == row[width - 1 :])
        before = _with_space(run, space, here, width)
        last = here + width - 1
        grown = shifted(before, size[last]) ^ crc[last]
        found.append(grown)
        rows.append(row[here])
        run = np.zeros(len(crc), np.uint32)
        run[here] = grown
    return np.concatenate(found) % np.uint32(BUCKETS), np.concatenate(rows), words


def _with_space(run: np.ndarray, space: np.ndarray, here: np.ndarray, width: int) -> np.ndarray:
    """CRCs of the runs at `here`, and a space after them."""
    if width == 2:
        return space[here]
    reg = run[here] ^ np.uint32(0xFFFFFFFF)
    return ((reg >> np.uint32(8)) ^ _TABLE[(reg ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)


def bucket_counts(df: DataFrame, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, piece in pieces(batch.column(0)):
                total += np.bincount(features(piece)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    parts = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long")
    out = [0] * BUCKETS
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Floored thousandths of the smoothed log ratio of a bucket's share in the target to that in the source."""
    s_all, t_all = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def gumbel(seed: int, doc_id: int) -> int:
    """Floored thousandths of a Gumbel number that follows from the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, seed: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, number, weight = (np.zeros(n, np.int64) for _ in range(3))
            for i, j, piece in pieces(batch.column(1)):
                bucket, row, words[i:j] = features(piece)
                number[i:j] = np.bincount(row, minlength=j - i)
                # Sums of integers below 2^53 are exact in doubles.
                weight[i:j] = np.rint(np.bincount(row, weights=gain[bucket], minlength=j - i)).astype(np.int64)
            ids = batch.column(0).to_pylist()
            score = [None if k is None else w + gumbel(seed, k) for k, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(number), pa.array(weight), pa.array(score, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


Key = tuple[int, int, int]


def _before(key: Key) -> Column:
    """Does a row come before the key: a higher score, then a smaller id, then an earlier row?"""
    score, doc, row = (F.lit(v).cast("long") for v in key)
    return (F.col("score") > score) | ((F.col("score") == score) & ((F.col("doc_id") < doc) | ((F.col("doc_id") == doc) & (F.col("row") < row))))


def kth_key(rows: DataFrame, k: int, seed: int = 0, pivots: int = PIVOTS) -> Key:
    """The k-th (from 1) key of rows (score, doc_id, row, all distinct) in the order of _before."""
    low: Key | None = None
    high: Key | None = None
    number = 0
    while True:
        some = rows
        if low is not None:
            some = some.filter(F.col("score") <= low[0]).filter(~_before(low) & ~_is(low))
        if high is not None:
            some = some.filter(F.col("score") >= high[0]).filter(_before(high))
        number += 1
        drawn = some.select("score", "doc_id", "row").orderBy(F.xxhash64("row", F.lit(seed + number)), "row").limit(pivots).collect()
        keys = sorted(((r.score, r.doc_id, r.row) for r in drawn), key=lambda x: (-x[0], x[1], x[2]))
        counts = some.agg(*[F.count_if(_before(x)).alias(f"b{i}") for i, x in enumerate(keys)], *[F.count_if(_is(x)).alias(f"e{i}") for i, x in enumerate(keys)]).first()
        passed = 0
        for i, key in enumerate(keys):
            before, equal = counts[f"b{i}"], counts[f"e{i}"]
            if before < k <= before + equal:
                return key
            if before >= k:
                high = key
                break
            low, passed = key, before + equal
        k -= passed


def _is(key: Key) -> Column:
    return (F.col("score") == key[0]) & (F.col("doc_id") == key[1]) & (F.col("row") == key[2])


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank 1, 2, ... in the order of _before: sorted by ranges, numbered within each, offset by counts."""
    order = [F.col("score").desc(), F.col("doc_id"), F.col("row")]
    at = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    at = at.withColumns({"_part": part, "_place": place})
    sizes = sorted((r._part, r.n) for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one for each range
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    known = rows.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    out = at.join(F.broadcast(known), "_part")
    return out.withColumn("rank", F.col("_offset") + F.col("_place") + 1).drop("_at", "_part", "_place", "_offset")


def resample(df: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = 20, seed: int = 42, doc: str = "doc_id", text: str = "text", pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of df.

    Of the rows with at least least_words words, floor(per_cent * N / 100) are drawn."""
    gain = gains(bucket_counts(df, text), bucket_counts(target, text))
    # The stored numbers of the rows make keys distinct.
    rows = written(scored(df, gain, seed, doc, text).withColumn("row", F.monotonically_increasing_id()))
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    able = rows.filter(fit)
    k = per_cent * able.count() // 100
    none = F.lit(None).cast("long")
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    if k == 0:
        return rows.withColumn("rank", none).select(out)
    last = kth_key(able, k, seed, pivots)
    won = fit & (_before(last) | _is(last))
    losers = rows.filter(~F.coalesce(won, F.lit(False))).withColumn("rank", none)
    return ranked(rows.filter(won)).select(out).unionByName(losers.select(out))
