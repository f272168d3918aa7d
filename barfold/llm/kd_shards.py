"""Sharding by a k-d tree: recursive splits at weighted medians along the widest metadata dimension.

A node that stands for several shards is cut where its left part has the bytes of its share of them, along the dimension
in which the node is widest (its range over the root's). The weighted median is found by histograms of the coordinates:
each pass sums the bytes of 4096 cells of every open node of a level, and the next pass looks into the cell that holds
the cut, down to 36 bits. The driver sees at most shards x 4096 sums and keeps shards - 1 cuts. Law: bytes, that is,
sizes of shards are near equal.

Dimensions are made of the text (length, language, hash), so equal texts share all coordinates and stay together. If
the key at the cut weighs more than the tolerance (a large group of copies), the next dimension is tried; if none fits,
the key's rows are parted by a hash of id and text, so that even a group of a third of all rows keeps the law.

Slots number a shard's rows without gaps: rows fall into buckets by hash, bucket sizes are summed up in order, and rows
are numbered within buckets of a few thousand rows.

Defined cases: a null or empty text has 8 bytes; a null id or language is a value of its own; repeated rows are rows of
their own, side by side; an empty table gives an empty one. Only id, text and language are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.llm.shared import written

CELLS, PASSES = 12, 3  # bits of a pass, passes
KEY_BITS = CELLS * PASSES
#: Bytes that a cut may be off, as a share of one shard's.
TOLERANCE = 0.002
#: Rows of a bucket in which slots are numbered.
SLOT_ROWS = 4096
OVERHEAD = 8
DIMENSIONS = ["length", "language", "content"]


def coordinates(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, one long below 2**36 for each dimension, and spread, that parts equal texts."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mask = (1 << KEY_BITS) - 1
    hashed = F.xxhash64(body)
    fine = hashed.bitwiseAND(F.lit((1 << 24) - 1))
    size = F.octet_length(body).cast("long") + OVERHEAD
    # 12 bits of the leading quantity, then 24 bits of the text's hash.
    length = F.least(F.lit(4095), F.floor(F.log2(size.cast("double")) * 128))
    language = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))), F.lit(4096))
    return df.select(
        F.col(f"`{doc}`").alias("doc_id"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        (F.shiftleft(length.cast("long"), 24) + fine).alias("length"),
        (F.shiftleft(language.cast("long"), 24) + fine).alias("language"),
        hashed.bitwiseAND(F.lit(mask)).alias("content"),
        F.xxhash64(F.col(f"`{doc}`"), body).bitwiseAND(F.lit(mask)).alias("spread"),
    )


@dataclass
class Node:
    """first shard, number of shards; once cut: rows with key < at go left, rows of the cell at go left if spread < inner."""

    first: int
    shards: int
    dimension: str = ""
    at: int = 0
    inner: int = 0
    children: list[Node] = field(default_factory=list)

    def column(self) -> Column:
        """The number of the leaf (its first shard) of each row."""
        if not self.children:
            return F.lit(self.first)
        key = F.col(self.dimension)
        left = (key < self.at) | ((key == self.at) & (F.col("spread") < self.inner)) if self.inner else key < self.at
        return F.when(left, self.children[0].column()).otherwise(self.children[1].column())


def _cells(meta: DataFrame, leaf: Column, open_: dict[int, tuple[str, int]], done: int, target: dict[int, float], inside: dict[int, int] | None = None) -> dict[int, tuple[int, float, float]]:
    """For each open leaf (dimension, prefix of `done` passes): the cell of the next pass that holds the target, the
    bytes before it and its own. inside: the whole cell of the leaf's own dimension, when the spread is refined."""
    key = None
    keep = None
    shift = KEY_BITS - CELLS * (done + 1)
    for first, (dimension, prefix) in open_.items():
        value = F.col(dimension)
        here = leaf == first
        if done:
            here = here & (F.shiftright(value, KEY_BITS - CELLS * done) == prefix)
        if inside is not None:
            here = here & (F.col(inside[first][0]) == inside[first][1])
        cell = F.pmod(F.shiftright(value, shift), F.lit(1 << CELLS))
        key = F.when(here, cell) if key is None else key.when(here, cell)
        keep = here if keep is None else keep | here
    rows = meta.select(leaf.alias("leaf"), key.alias("cell"), "size", keep.alias("keep")).filter("keep")
    sums: dict[int, np.ndarray] = {first: np.zeros(1 << CELLS) for first in open_}
    for r in rows.groupBy("leaf", "cell").agg(F.sum("size").alias("bytes")).collect():  # at most shards x 4096
        sums[r.leaf][r.cell] = r.bytes
    out = {}
    for first, bytes_ in sums.items():
        total = np.cumsum(bytes_)
        cell = int(min(np.searchsorted(total, target[first], "left"), len(total) - 1))
        out[first] = (cell, float(total[cell] - bytes_[cell]), float(bytes_[cell]))
    return out


def _located(meta: DataFrame, leaf: Column, names: dict[int, str], target: dict[int, float], inside=None) -> dict[int, tuple[int, float, float]]:
    """For each leaf: the key at which its cut lies, the bytes before that key and with it."""
    prefix, before, rest = {f: 0 for f in names}, {f: 0.0 for f in names}, dict(target)
    own: dict[int, float] = {}
    for done in range(PASSES):
        for f, (cell, less, bytes_) in _cells(meta, leaf, {f: (names[f], prefix[f]) for f in names}, done, rest, inside).items():
            prefix[f] = (prefix[f] << CELLS) + cell
            before[f] += less
            rest[f] -= less
            own[f] = bytes_
    return {f: (prefix[f], before[f], own[f]) for f in names}


def tree(meta: DataFrame, shards: int) -> Node:
    """The cuts, level by level; all nodes of a level share each pass."""
    root = Node(0, shards)
    first = meta.agg(F.sum("size").alias("bytes"), *[f(F.col(d)).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    if first.bytes is None:
        return root
    tolerance = TOLERANCE * first.bytes / shards
    whole = {d: max(1, first[f"{d}_high"] - first[f"{d}_low"]) for d in DIMENSIONS}
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        leaf = root.column()
        extents = meta.groupBy(leaf.alias("leaf")).agg(
            F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
        )
        found = {r.leaf: r for r in extents.collect()}
        nodes = {n.first: n for n in level if n.first in found}
        order = {f: sorted(DIMENSIONS, key=lambda d: -found[f][d] / whole[d]) for f in nodes}  # noqa: B023
        target = {f: found[f].bytes * (n.shards // 2) / n.shards for f, n in nodes.items()}
        # Off by so many bytes: dimension, key, spread below which the key's own rows go left, bytes wanted of those.
        options: dict[int, list[tuple[float, str, int, int, float]]] = {f: [] for f in nodes}
        for attempt in range(len(DIMENSIONS)):
            names = {f: order[f][attempt] for f in nodes if not options[f] or min(options[f])[0] > tolerance}
            if not names:
                break
            for f, (key, before, own) in _located(meta, leaf, names, target).items():
                rest = target[f] - before
                options[f] += [(rest, names[f], key, 0, rest), (abs(own - rest), names[f], key + 1, 0, rest)]
        best = {f: min(o) for f, o in options.items()}
        # Where every dimension has a heavy key at its cut, that key's rows are parted.
        split = {f: (o[1], o[2] - (o[0] != o[4]), o[4]) for f, o in best.items() if o[0] > 5 * tolerance}
        if split:
            inside = {f: (d, key) for f, (d, key, _) in split.items()}
            for f, (key, before, own) in _located(meta, leaf, {f: "spread" for f in split}, {f: rest for f, (_, _, rest) in split.items()}, inside).items():
                d, at, rest = split[f]
                best[f] = min(best[f], (abs(rest - before), d, at, key, rest), (abs(before + own - rest), d, at, key + 1, rest))
        cuts = {f: o[1:4] for f, o in best.items()}
        following = []
        for f, n in nodes.items():
            n.dimension, n.at, n.inner = cuts[f]
            n.children = [Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)]
            following += n.children
        level = following
    return root


def slots(rows: DataFrame, group: str, order: list[str], bucket: Column) -> DataFrame:
    """Append slot: 0, 1, 2 and so on within each group, by bucket and then order."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    return numbered.join(counts, [group, "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_bucket", "_k", "_before")


def shard(df: DataFrame, shards: int = 24, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    meta = written(coordinates(df, doc, text, lang))
    buckets = max(1, meta.count() // (shards * SLOT_ROWS))
    placed = written(meta.select("doc_id", "size", "text_crc32", "spread", tree(meta, shards).column().alias("shard")))
    bucket = F.floor(F.col("spread") * F.lit(float(buckets)) / float(1 << KEY_BITS))
    return slots(placed, "shard", ["spread", "doc_id", "text_crc32"], bucket).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
