"""Quality rules: counts of a document, and its divergence from what is usual in its language.

Two histograms of each document, of byte classes (vowels, other letters, capitals, digits, blanks, punctuation, symbols,
characters beyond ASCII) and of the common words of its language, are held against the same histograms of all documents
of that language by Jensen-Shannon distance (base 2, 0 to 1). A distance beyond a bound rejects the document. A short
text strays from the mean by chance: the bounds widen with 1/sqrt(words), and below MIN_WORDS only the counts judge.

A text without any common word of its language has the same distance at any length, that of its reference from nothing
but other words. The bound of words is therefore a part of this distance, with what chance adds to as many words. Many
common words leave much to chance, so common words are also held against all others as two classes, which tells texts
with too few of them from some 50 words on. Both tests need the words of one language: texts of languages without a
reference of their own, or of none, are held against a mixture, where missing words mean nothing, by a fixed bound.

References are gathered over all documents: words are counted where the texts are and summed by a shuffle. A common word
has at least WORD_SHARE of its language's words, so there are at most 1/WORD_SHARE for each; a language has a reference
of its own from LANGUAGE_SHARE of the documents on, so there are at most 1/LANGUAGE_SHARE + 1; other documents are held
against all. This bounds what is broadcast.

Defined cases: a null or empty text has no words and fails the counts; a null language counts as a language named '';
repeated rows are rows of their own; an empty table gives an empty one; input columns named like the added ones are
replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.llm.shared import written
from barfold.llm.text import BLANK, Piece, mixed, pieces, stream, with_columns
from barfold.llm.words import word_counts

MIN_WORDS = 50
WORD_SHARE = 0.005
LANGUAGE_SHARE = 0.0001
#: Bounds of the distances: level + slope / sqrt(words).
CLASS_BOUND = (0.30, 0.4)
WORD_BOUND = (0.40, 0.5)
#: Part of the distance of a text without common words that is beyond the bound, and normal score of what chance adds.
WORD_PART, WORD_SCORE = 0.45, 3.1
#: Most share of repeated words, in per cent, and least number of words.
MOST_REPEATED, LEAST_WORDS = 20, 10
SYMBOLS = b"#*$%&|<>"
CLASSES = 8
_ALL = "\x00all"


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes have none (CLASSES)."""
    table = np.full(256, 6)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[list(b"aeiou")] = 0
    table[BLANK] = 4
    table[list(b".,;:!?'\"-()")] = 5
    table[0x80:0xC0], table[0xC0:] = CLASSES, 7
    return table


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of shares."""
    m = (p + q) / 2

    def half(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum(0.0, (half(p) + half(q)) / 2))


def word_bound(common: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bound of distances of n words from the shares `common`, that of all other words last."""
    nothing, free = np.zeros(len(common)), len(common) - 1
    nothing[-1] = 1
    if not free:
        return np.ones(len(n))
    # The squared distance of n words drawn from common is about chi-squared / (8 ln 2 n) (Wilson and Hilferty's cube).
    spread = 2 / (9 * free)
    chance = free * (1 - spread + WORD_SCORE * np.sqrt(spread)) ** 3 / (8 * np.log(2) * np.maximum(1, n))
    return np.sqrt((WORD_PART * distance(nothing, common)) ** 2 + chance)


def words_stray(shares: np.ndarray, common: np.ndarray, n: np.ndarray, by_word: np.ndarray, mixture: bool) -> np.ndarray:
    """Are texts of n words, with these shares and distances, too far from the reference `common`?"""
    if mixture:
        return by_word > WORD_BOUND[0] + WORD_BOUND[1] / np.sqrt(np.maximum(1, n))
    two, both = (np.stack([1 - x[..., -1], x[..., -1]], axis=-1) for x in (shares, common))
    few = (two[:, 0] < both[0]) & (distance(two, both) > word_bound(both, n))
    return (by_word > word_bound(common, n)) | few


def class_counts(piece: Piece) -> np.ndarray:
    """Characters of each class in each row."""
    out = np.zeros((piece.rows, CLASSES), np.int64)
    for k, (a, b) in enumerate(zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist(), strict=True)):
        out[k] = np.bincount(_CLASS[piece.data[a:b]], minlength=CLASSES + 1)[:CLASSES]
    return out


def base_counts(piece: Piece) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends = piece.words(BLANK)
    first = piece.per_row(starts)
    n_words = np.diff(first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[piece.offsets])

    out = {"n_words": n_words, "word_chars": per_row(_LEAD[piece.data] & ~BLANK[piece.data]), "n_symbols": per_row(_SYMBOL[piece.data])}
    begin, end = piece.spans_where(piece.data != 10)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    row = np.searchsorted(piece.offsets, begin, "right") - 1
    salt = stream(piece.rows, 3)
    again = pd.Series(mixed(piece.hashes(begin, end, folded=False) ^ salt[row]) if len(begin) else np.zeros(0, np.uint64)).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(row[again], minlength=piece.rows)
    out["n_repeat_words"] = np.zeros(piece.rows, np.int64)
    if len(starts) >= 5:
        words = piece.hashes(starts, ends, folded=False)
        of = np.repeat(np.arange(piece.rows), n_words)
        whole = of[4:] == of[:-4]
        total = np.zeros(len(words) - 4, np.uint64)
        for k, step in enumerate(stream(5, 11) | np.uint64(1)):
            total += words[k : len(words) - 4 + k] * step
        at = np.flatnonzero(whole)
        back, keys = pd.factorize(mixed(mixed(total[at]) ^ salt[of[at]]))
        repeated = at[(np.bincount(back, minlength=len(keys)) >= 2)[back]]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, repeated, 1)
        np.add.at(depth, repeated + 5, -1)
        out["n_repeat_words"] = np.bincount(of[np.cumsum(depth[:-1]) > 0], minlength=piece.rows)
    return out


def word_hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    edges = np.cumsum([0, *map(len, data)])
    return Piece(np.frombuffer(b"".join(data), np.uint8), edges).hashes(edges[:-1], edges[1:], folded=True)


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language with enough documents, and for all: shares of classes, hashes of common words (sorted), their
    shares with that of all other words last."""
    group = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))

    def run(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            total: dict[str, np.ndarray] = {}
            for i, j, piece in pieces(batch.column(1)):
                counts = class_counts(piece)
                for name in set(names[i:j].tolist()):
                    total[name] = total.get(name, 0) + np.append(counts[names[i:j] == name].sum(axis=0), (names[i:j] == name).sum())
            yield pa.RecordBatch.from_pydict({"grp": pa.array(list(total), pa.string()), "counts": pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))})

    rows = df.select(group.alias("grp"), F.col(f"`{text}`").alias("text"))
    classes = written(rows.mapInArrow(run, "grp string, counts array<long>").groupBy("grp").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(CLASSES + 1)]))
    docs = classes.agg(F.sum(f"c{CLASSES}")).first()[0] or 0
    own = classes.filter(F.col(f"c{CLASSES}") >= max(1, LANGUAGE_SHARE * docs))
    words = written(word_counts(df, group, text))
    # 'all' has the sums over all languages.
    both = words.unionByName(words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("grp", F.lit(_ALL)))
    totals = both.groupBy("grp").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    named = own.select("grp").unionByName(df.sparkSession.createDataFrame([(_ALL,)], "grp string"))
    totals = {r.grp: r.total for r in totals.join(named, "grp", "left_semi").collect()}  # at most 1/LANGUAGE_SHARE + 1
    sums = {r.grp: np.array(r[1 : CLASSES + 1], float) for r in own.collect()}
    every = classes.agg(*[F.sum(f"c{k}") for k in range(CLASSES)]).first()
    sums[_ALL] = np.array([x or 0 for x in every], float)
    floors = df.sparkSession.createDataFrame([(g, WORD_SHARE * n) for g, n in totals.items()], "grp string, least double")
    common: dict[str, list[tuple[str, int]]] = {}
    for r in both.join(F.broadcast(floors), "grp").filter("n >= least").collect():  # at most 1/WORD_SHARE for each
        common.setdefault(r.grp, []).append((r.word, r.n))
    out = {}
    for name, counts in sums.items():
        some, total = common.get(name, []), max(1, totals.get(name, 0))
        hashes = word_hash([w for w, _ in some])
        order = np.argsort(hashes)
        shares = np.array([n for _, n in some], float)[order] / total
        out[name] = (counts / max(1.0, counts.sum()), hashes[order], np.append(shares, max(0.0, 1 - shares.sum())))
    return out


FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("class_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def judge(df: DataFrame, known: dict | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Append counts, base_failed, both distances (null without words) and kept. known: references() of a corpus, else of df."""
    known = references(df, text, lang) if known is None else known
    shared = df.sparkSession.sparkContext.broadcast(known)

    def kernel(batch: pa.RecordBatch, piece: Piece, i: int, j: int) -> list:
        refs = shared.value
        base = base_counts(piece)
        n = base["n_words"]
        names = [x or "" for x in batch.column(batch.schema.names.index(lang)).to_pylist()]
        names = np.array([x if x in refs else _ALL for x in map(str, names)], object)
        classes = class_counts(piece).astype(float)
        classes /= np.maximum(1, classes.sum(axis=1, keepdims=True))
        starts, ends = piece.words(BLANK)
        words = piece.hashes(starts, ends, folded=True) if len(starts) else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(piece.rows), n)
        by_class, by_word, wordy = np.zeros(piece.rows), np.zeros(piece.rows), np.zeros(piece.rows, bool)
        for name in set(names.tolist()):
            share, hashes, common = refs[name]
            mine = np.flatnonzero(names == name)
            by_class[mine] = distance(classes[mine], share)
            local = np.full(piece.rows, -1)
            local[mine] = np.arange(len(mine))
            inside = local[of] >= 0
            at = np.searchsorted(hashes, words[inside])
            if len(hashes):
                at = np.where(hashes[np.minimum(at, len(hashes) - 1)] == words[inside], at, len(hashes))
            counts = np.bincount(local[of[inside]] * len(common) + at, minlength=len(mine) * len(common)).reshape(len(mine), -1)
            shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
            by_word[mine] = distance(shares, common)
            wordy[mine] = words_stray(shares, common, n[mine], by_word[mine], name in ("", _ALL))
        failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
        root = np.sqrt(np.maximum(1, n))
        strays = (n >= MIN_WORDS) & ((by_class > CLASS_BOUND[0] + CLASS_BOUND[1] / root) | wordy)
        return [*base.values(), failed, pa.array(by_class, mask=n == 0), pa.array(by_word, mask=n == 0), ~failed & ~strays]

    return with_columns(df, FIELDS, kernel, text)
