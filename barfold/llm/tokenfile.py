"""Token ids of documents in bit-packed files: written in order of the document ids, read back in blocks.

A file holds the ids of neighbouring documents, each followed by an end id, as one stream of fixed-width numbers of
just the bits that the vocabulary needs. The stream is cut into blocks of a fixed number of ids; each begins at a byte,
so that any block is found by its offset and unpacked by numpy alone. Layout, little-endian:

    magic "BITIDS01" | blocks | block offsets (u64 each) | document ids (i64 each) | null flags (u8 each) |
    ids per document (u64 each) | footer: blocks, documents, ids, ids per block (u64), bits (u64), magic

A task writes one file under a name of its own and returns its manifest row; only files in the manifest, a table that
Spark commits, count. So a task may run twice and executors may be lost. The rows are range-partitioned and sorted by
document id; nothing passes through the driver.

Defined cases: a null or empty text has the end id alone; rows without an id come first; rows with the same id follow
each other in order of their texts; an empty table makes no file and reads back as no rows. Only the id and the text
are taken from df, so clashing names of other columns don't matter. A document's ids are held by one task at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barfold.llm.bpe import vocabulary
from barfold.llm.shared import spread
from barfold.llm.text import pieces

MAGIC = b"BITIDS01"
BLOCK_IDS = 8192
READ_BLOCKS = 64
MANIFEST = "part int, file string, n_docs long, n_ids long"


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width numbers, most significant bit first, padded to a byte."""
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(data: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype(np.uint32)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.pending, self.waiting = [], 0
        self.offsets, self.at, self.total = [], len(MAGIC), 0
        self.docs, self.nulls, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in docs], np.int64))
        self.nulls.append(np.array([d is None for d in docs], np.uint8))
        self.counts.append(counts.astype(np.uint64))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.int64)
        end = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, end, BLOCK_IDS):
            block = pack(ids[a : min(end, a + BLOCK_IDS)], self.bits)
            self.offsets.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.total += end
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int]:
        self._blocks(last=True)
        docs = np.concatenate(self.docs)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(docs.astype("<i8").tobytes() + np.concatenate(self.nulls).tobytes() + np.concatenate(self.counts).astype("<u8").tobytes())
        self.out.write(np.array([len(self.offsets), len(docs), self.total, BLOCK_IDS, self.bits], "<u8").tobytes() + MAGIC)
        self.out.close()
        return len(docs), self.total


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, name = _place(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{path} is not a complete file of token ids")
        blocks, docs, self.total, self.block_ids, self.bits = np.frombuffer(tail[:40], "<u8").astype(np.int64).tolist()
        at = size - 48 - 17 * docs - 8 * blocks
        self.end = at
        self.offsets = np.append(np.frombuffer(self.file.read_at(8 * blocks, at), "<u8").astype(np.int64), at)
        at += 8 * blocks
        self.docs = np.frombuffer(self.file.read_at(8 * docs, at), "<i8")
        self.nulls = np.frombuffer(self.file.read_at(docs, at + 8 * docs), np.uint8).astype(bool)
        self.counts = np.frombuffer(self.file.read_at(8 * docs, at + 9 * docs), "<u8").astype(np.int64)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids first to first + count of the file's stream."""
        if not count:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, -(-(first + count) // self.block_ids)
        raw = np.frombuffer(self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a])), np.uint8)
        parts = []
        for k in range(a, b):
            n = min(self.block_ids, self.total - k * self.block_ids)
            begin = int(self.offsets[k] - self.offsets[a])
            parts.append(unpack(raw[begin : begin + -(-n * self.bits // 8)], n, self.bits))
        out = np.concatenate(parts)
        return out[first - a * self.block_ids : first - a * self.block_ids + count]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of documents: ids of documents, null flags, ids of tokens (flat), ids for each document."""
        begins = np.cumsum(self.counts) - self.counts
        i = 0
        while i < len(self.docs):
            j = int(np.searchsorted(begins, begins[i] + READ_BLOCKS * self.block_ids, "left"))
            j = min(len(self.docs), max(i + 1, j))
            yield self.docs[i:j], self.nulls[i:j], self.ids(int(begins[i]), int(self.counts[i:j].sum())), self.counts[i:j]
            i = j


def write(df: DataFrame, folder: str, path: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, write the files and the manifest into folder, and return the manifest."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = name = None
        vocab = vocabulary(path)
        for batch in batches:
            for i, j, piece in pieces(batch.column(1)):
                if writer is None:
                    fs, base = _place(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"ids-{uuid.uuid4().hex}.bits"
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"), bits_for(vocab.size))
                ids, counts = vocab.encode(piece)
                ends = np.cumsum(counts)
                writer.add(batch.column(0).slice(i, j - i).to_pylist(), np.insert(ids, ends, end_id), counts + 1)
        if writer is not None:
            docs, total = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": [docs], "n_ids": [total]}
            )

    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions("doc", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file, in order, with the ids before it. As many rows as files: few enough for one window."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, and its ids as
    little-endian unsigned 32-bit integers (raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for docs, nulls, ids, counts in Reader(f"{folder}/{row['file']}").documents():
                    edges = np.zeros(len(docs) + 1, np.int64)
                    np.cumsum(counts, out=edges[1:])
                    raw = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64(), mask=nulls), pa.array(start + edges[:-1]), pa.array(counts), raw], names=["doc_id", "start", "n_tokens", "raw"]
                    )
                    start += int(edges[-1])

    return spread(manifest(spark, folder)).mapInArrow(run, "doc_id long, start long, n_tokens long, raw binary")
