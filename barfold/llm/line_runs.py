"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends, A-Z lower-cased; keys of LEAST code points or more count. The keys
of all batches so far are kept as runs: tables of 128-bit hashes, bucketed and sorted by hash. A new batch is first
summed up to one row for each hash with its smallest id, then anti-joined with one run after the other (sorted against
sorted, so only the batch is shuffled, once); what is left is new and becomes a run of level 0. FANOUT runs of a level
are merged into one of the next, so a hash is rewritten once for each level and a batch meets few runs.

A line goes if its key is in an earlier batch, or in this batch under a smaller id. Batches are ranges of ids in
ascending order, so over one table the smallest id of all keeps its lines. Lines that go come back to their document as a
list of positions, and the text is put together from the stretches between them: work stays linear in the lines.

Built-in functions only. Hashes are summed up before they are shuffled, and joins of lines with owners have a unique
side, so Spark can split a line that a third of all documents hold. Lines of one text meet only in its list of positions.
Runs are tables of the catalog with files in the shared folder, written by jobs that can be repeated; they are dropped
from the catalog when the store is closed.

Defined cases: a null or empty text is one empty line; rows with the same id are one document, so none of them loses a
line to another; a row without id counts as after all ids (as one document, with the id 2^63 - 1 if that occurs); an empty
table gives an empty one. Columns named like those that are added give way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm.shared import new_folder, written

#: Shortest key, in code points, that is dropped.
LEAST = 10
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches that one table is cut into.
BATCHES = 4
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(_BLANKS))
    # lower() is much faster than translate(), and the same where all characters have one byte.
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The hashes of all lines seen so far, as levelled runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._made: list[str] = []

    def _store(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = hashes.select(*HASH).repartition(self.parts, *HASH)
        dealt.write.bucketBy(self.parts, *HASH).sortBy(*HASH).option("path", new_folder(self.spark)).saveAsTable(name)
        self._made.append(name)
        return name

    def runs(self) -> list[str]:
        """Names of the runs, the oldest first."""
        return [name for level in reversed(self.levels) for name in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows whose hash is in no run."""
        for name in self.runs():
            hashes = hashes.join(self.spark.table(name), HASH, "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Take in hashes that are in no run yet, and compact levels that are full."""
        run, level = self._store(hashes), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0]).select(*HASH)
            for name in self.levels[level][1:]:  # bucket by bucket; hashes of runs differ
                merged = merged.join(self.spark.table(name), HASH, "full_outer")
            run, self.levels[level] = self._store(merged), []
            level += 1

    def close(self) -> None:
        for name in self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch_of(ids: DataFrame, batches: int) -> Column:
    """Number of the range of ids that a row's ord falls into; ranges hold about as many rows each."""
    if batches < 2:
        return F.lit(0)
    cuts = ids.agg(F.percentile_approx("ord", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("ord") > cut).cast("int")
    return number


def dropped_lines(rows: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """rows (ord, t1, t2, text) -> (ord, t1, t2, dropped): positions, from 0, of the lines that go; rows without any are left out."""
    spark = rows.sparkSession
    here = rows.withColumn("batch", _batch_of(rows.select("ord"), batches))
    each = here.select("batch", "ord", "t1", "t2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = line_key(F.col("line"))
    # Two hashes with different seeds make 128 bits.
    long = each.withColumn("key", key).filter(F.length("key") >= LEAST)
    hashed = long.select("batch", "ord", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), "key").alias("h2"))
    folder = new_folder(spark)
    hashed.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(hashed.schema).parquet(folder)

    runs, out = LineRuns(spark, fanout), []
    try:
        for number in range(batches):
            batch = lines.filter(F.col("batch") == number).drop("batch")
            firsts = batch.groupBy(*HASH).agg(F.min("ord").alias("first"))
            new = written(runs.unseen(firsts))
            owned = batch.join(new, HASH, "left")
            gone = owned.filter(F.col("first").isNull() | (F.col("first") < F.col("ord")))
            out.append(written(gone.groupBy("ord", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))))
            if number + 1 < batches:
                runs.add(new)
    finally:
        runs.close()
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines that are not in dropped (ascending positions), joined by newlines."""
    lines = _lines(text)
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    stretch = F.transform(F.sequence(F.lit(1), F.size(dropped) + 1), lambda k: F.slice(lines, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1))
    return F.array_join(F.flatten(stretch), "\n")


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """df with its text less the repeated lines, and with n_lines (before) and n_dropped."""
    added = ["n_lines", "n_dropped"]
    kept = [c for c in df.columns if c.lower() not in added]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = {"_ord": F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(_LAST)), "_t1": F.xxhash64(t), "_t2": F.xxhash64(F.lit(77), t)}
    rows = df.select(*[keys[f"_{c}"].alias(c) for c in ("ord", "t1", "t2")], t.alias("text"))
    gone = dropped_lines(rows, batches, fanout).select(F.col("ord").alias("_ord"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("dropped").alias("_dropped"))
    out = df.select(*[f"`{c}`" for c in kept]).withColumns(keys).join(gone, list(keys), "left")
    whole = F.when(F.col("_dropped").isNull(), t).otherwise(kept_text(t, F.col("_dropped")))
    return out.select(
        *[whole.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.size(_lines(t)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
