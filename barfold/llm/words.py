"""Counts of blank-separated, lower-cased words, pre-aggregated where the texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.text import BLANK, LOWER, expand, pieces

#: Text counted at once; within it each word leaves the task once.
COUNT_BYTES = 4 << 20


def word_counts(df: DataFrame, group: F.Column, text: str = "text") -> DataFrame:
    """(grp, word, n): how often each word, A-Z folded, occurs in the texts of each group; null group is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(0).fill_null("").to_pylist(), object).astype(str), return_inverse=True)
            for i, j, piece in pieces(batch.column(1), COUNT_BYTES):
                starts, ends = piece.words(BLANK)
                if not len(starts):
                    continue
                row = np.repeat(codes[i:j], np.diff(piece.per_row(starts)))
                keys = piece.hashes(starts, ends, folded=True) + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
                back, seen = pd.factorize(keys)
                first = np.empty(len(seen), np.int64)
                first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
                size = (ends - starts)[first]
                data = LOWER[piece.data[expand(starts[first], size)]]
                edges = np.zeros(len(first) + 1, np.int32)
                np.cumsum(size, out=edges[1:])
                words = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
                yield pa.RecordBatch.from_arrays([pa.array(names[row[first]], pa.string()), words, pa.array(np.bincount(back))], names=["grp", "word", "n"])

    rows = df.select(group.cast("string").alias("grp"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))
