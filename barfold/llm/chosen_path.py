"""MinHash near-dedup: a chosen-path set similarity join of shingle sets, and the components of its links.

Documents become sets of hashed word shingles; documents with equal sets are one class, joined through one row of it,
so copies are never expanded into pairs. Each class gets SLOTS minwise hashes. A tree begins with one slot: sets with
the same value there share a node. A node with at most `limit` sets (and bounded shingles) is compared exhaustively in
its task; a larger one branches: its path picks one further slot, and a second one with probability 1/threshold - 1, so
that a pair at the threshold is expected to stay together in one child. Trees are repeated. They share the SLOTS, and
each branching can part a pair, so the chance to miss a pair at the threshold is worked out for the depth that was
reached, over all numbers of slots in which the pair may agree. While it is above MISS, the sets that have been in a
branching node go through as many further rounds of trees as it takes, all at once, with hash functions of their own:
chances of rounds multiply.

Large groups of near copies would never branch apart. So each large node also has a pivot, compared exactly with all its
sets: those within the threshold are linked to it. As 1 - Jaccard is a metric, a linked set whose distance to the pivot
is below that of the nearest unlinked one less the threshold's distance can have no link to an unlinked set, and all its
others lead to sets linked with the same pivot: it needs no further comparison here. The rest, never the pivot, branches
on, as many levels in one pass as the largest node is expected to need.

Exhaustive nodes first drop pairs whose minwise estimate is six standard errors below the threshold, then compare full
sets. Sets that can't reach the threshold with anything in the node, as too few of their shingles occur in another set,
are peeled off; the others are compared by what they lack of the node's common shingles and have of its rare ones, so a
group of thousands made from one template costs little. Pairs already linked through others are skipped; every link is
confirmed on full sets.

Links are few beside documents (a spanning set for each node), and their components come from rounds of smallest-label
joins over tables in the shared folder.

Defined cases: a null or empty text has an empty set and no links; rows with the same id share a component, whatever
their texts; a row without id takes no part and keeps a null component; an empty table gives an empty one. Only the id
and the text are read, so names of other columns don't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.shared import written
from barfold.llm.text import BLANK, expand, mixed, pieces, shingles, stream

SLOTS = 64
#: Most sets, and most shingles together, that one task compares exhaustively.
LIMIT = 8192
LIMIT_SHINGLES = 4_000_000
#: Most levels that sets of large nodes go down in one pass.
STEPS = 6
#: Up to this many documents (16 bytes each) are picked out by a broadcast; more by a shuffled join.
BROADCAST_IDS = 500_000

#: Most chance to miss a pair at the threshold.
MISS = 1e-6
#: Standard errors below the threshold from which on a minwise estimate rules a pair out.
ERRORS = 6


def seeds(number: int) -> np.ndarray:
    """Hash functions of a round of trees."""
    return stream(SLOTS, 23 + 1000 * number) | np.uint64(1)


def minwise(members: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The SLOTS smallest values under as many hash functions, 31 bits each."""
    if len(members) < 20_000:
        return ((members[:, None] * by[None, :]) >> np.uint64(33)).min(axis=0).astype(np.int32)
    return np.array([((members * s) >> np.uint64(33)).min() for s in by], np.int32)


def _sets(batch_text: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, _, piece in pieces(batch_text):
        starts, ends = piece.words(BLANK)
        hashes = piece.hashes(starts, ends, folded=True) if len(starts) else np.zeros(0, np.uint64)
        first = piece.per_row(starts)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            yield i + k, np.unique(shingles(hashes[a:b], width))


def sketches(df: DataFrame, width: int, doc: str, text: str, number: int = 0) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, slots): set size, a 128-bit key of the set and its minwise hashes of a round."""
    by = seeds(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, keys, slots = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros((n, SLOTS), np.int32)
            for row, members in _sets(batch.column(1), width):
                size[row] = len(members)
                if len(members):
                    keys[:, row] = _keys(members)
                    slots[row] = minwise(members, by)
            edges = pa.array(np.arange(n + 1, dtype=np.int32) * SLOTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(edges, pa.array(slots.reshape(-1)))],
                names=["doc_id", "n_shingles", "k1", "k2", "slots"],
            )

    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, slots array<int>")


def _keys(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = members.sum(dtype=np.uint64).astype(np.int64)
    return int(one), int(mixed(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _picked(df: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows (rep, text, k1, k2) of the documents that stand for the wanted classes (rep, first, k1, k2)."""
    rows = df.select(F.col(f"`{doc}`").cast("long").alias("first"), F.col(f"`{text}`").alias("text"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "first").select("rep", "text", "k1", "k2")


def _full_sets(df: DataFrame, wanted: DataFrame, width: int, doc: str, text: str) -> DataFrame:
    """(rep, members, size) of the wanted classes, as sorted hashes; computed again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets, pending = [], [], 0
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for row, members in _sets(batch.column(1), width):
                # An id may have rows with other sets.
                if len(members) and _keys(members) == keys[row]:
                    keep.append(row)
                    sets.append(members)
                    pending += len(members)
                if pending > 500_000:
                    yield _batch(batch, keep, sets)
                    keep, sets, pending = [], [], 0
            if keep:
                yield _batch(batch, keep, sets)

    def _batch(batch, keep, sets):
        edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets).view(np.int64)))],
            names=["rep", "members"],
        )

    return _picked(df, wanted, doc, text).mapInArrow(run, "rep long, members array<long>").withColumn("size", F.size("members"))


def _joined(labels: np.ndarray, near: np.ndarray, label: int) -> None:
    """All sets with a label that one of `near` has get this one."""
    known = np.unique(labels[near])
    labels[np.isin(labels, known)] = label


def likely_groups(slots: np.ndarray, least: float) -> list[np.ndarray]:
    """Sets connected by pairs whose estimated similarity is at least `least`."""
    n = len(slots)
    labels = np.arange(n)
    for a in range(n - 1):
        rest = np.flatnonzero(labels[a + 1 :] != labels[a]) + a + 1
        if len(rest):
            near = rest[(slots[rest] == slots[a]).mean(axis=1) >= least]
            if len(near):
                _joined(labels, near, labels[a])
    order = np.argsort(labels, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)
    return [g for g in groups if len(g) > 1]


def _peeled(row: np.ndarray, element: np.ndarray, size: np.ndarray, per_cent: int) -> np.ndarray:
    """Which sets may be linked at all: enough of their elements occur in another set that may be, too."""
    alive = np.ones(len(size), bool)
    while True:
        here = alive[row]
        count = np.bincount(element[here], minlength=int(element.max(initial=-1)) + 1)
        shared = np.bincount(row[here & (count[element] > 1)], minlength=len(size))
        # A union has at least as many elements as the set itself.
        left = alive & (100 * shared >= per_cent * size)
        if (left == alive).all():
            return alive
        alive = left


def exact_links(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """A spanning set of all links between the sets: a pair already linked through others is not compared.

    Sets are told apart by exceptions: elements that most sets have and they lack, and rare ones that they have. For
    two sets, common elements less those that either lacks, and with the exceptions that both have, make the shared."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    some = np.flatnonzero(_peeled(row, element, size, per_cent))
    if len(some) < 2:
        return []
    place = np.full(len(sets), -1)
    place[some] = np.arange(len(some))
    here = place[row] >= 0
    row, element, size, n = place[row[here]], element[here], size[some], len(some)
    count = np.bincount(element)
    common = np.flatnonzero(2 * count > n)
    which = np.full(len(count), -1)
    which[common] = np.arange(len(common))
    often = which[element] >= 0
    lacking = len(common) - np.bincount(row[often], minlength=n)
    rows, exceptions = [row[~often]], [element[~often]]
    step = max(1, (1 << 24) // max(1, len(common)))
    first = np.searchsorted(row, np.arange(n + 1))  # rows are in ascending order
    for a in range(0, n, step):
        b = min(n, a + step)
        has = np.zeros((b - a, len(common)), bool)
        part = slice(first[a], first[b])
        has[row[part][often[part]] - a, which[element[part][often[part]]]] = True
        lack_row, lack = np.nonzero(~has)
        rows.append(lack_row + a)
        exceptions.append(common[lack])
    rows, exceptions = np.concatenate(rows), np.concatenate(exceptions)
    order = np.argsort(exceptions, kind="stable")
    posting, start = rows[order], np.searchsorted(exceptions[order], np.arange(len(count) + 1))
    order = np.argsort(rows, kind="stable")
    own, own_start = exceptions[order], np.searchsorted(rows[order], np.arange(n + 1))

    labels, out = np.arange(n), []
    for a in range(n - 1):
        rest = np.flatnonzero(labels[a + 1 :] != labels[a]) + a + 1
        if not len(rest):
            continue
        mine = own[own_start[a] : own_start[a + 1]]
        met = posting[expand(start[mine], start[mine + 1] - start[mine])]
        both = np.bincount(met, minlength=n)[rest]
        shared = len(common) - lacking[a] - lacking[rest] + both
        near = rest[100 * shared >= per_cent * (size[rest] + size[a] - shared)]
        if len(near):
            # One link for each group that joins.
            _, one = np.unique(labels[near], return_index=True)
            out += [(int(some[a]), int(some[b])) for b in near[one].tolist()]
            _joined(labels, near, labels[a])
    return out


def trees_for(threshold: float, miss: float = MISS, levels: int = 3) -> int:
    """Trees of a round: independent ones would miss a pair at the threshold with at most this chance within levels."""
    second, lost = 1 / threshold - 1, 0.0
    for _ in range(levels - 1):  # chance that no branch below keeps the pair together
        one = 1 - threshold * (1 - lost)
        lost = one * (1 - second + second * one)
    return math.ceil(math.log(miss) / math.log(1 - threshold * (1 - lost)))


def missed(threshold: float, trees: int, branchings: int) -> float:
    """Chance that a round misses a pair at the threshold in nodes that are small after so many branchings, over all
    numbers of slots in which the pair may agree; pairs that their estimate rules out are missed."""
    second, least, starts, out = 1 / threshold - 1, _ruled_out(threshold) * SLOTS, min(trees, SLOTS), 0.0
    for agree in range(SLOTS + 1):
        chance = math.comb(SLOTS, agree) * threshold**agree * (1 - threshold) ** (SLOTS - agree)
        if agree < least:
            out += chance
            continue
        lost = 0.0
        for _ in range(branchings):
            one = 1 - agree / SLOTS * (1 - lost)
            lost = one * (1 - second + second * one)
        for a in range(max(0, starts - SLOTS + agree), min(agree, starts) + 1):  # trees that the pair begins together
            part = math.comb(agree, a) * math.comb(SLOTS - agree, starts - a) / math.comb(SLOTS, starts)
            out += chance * part * lost ** (a * trees // starts)
    return out


def _ruled_out(threshold: float) -> float:
    """Minwise estimate under which a pair is not compared."""
    return threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / SLOTS)


def _children(level: int, steps: int, threshold: float) -> F.Column:
    """The nodes that a set (node, slots) goes on to, some levels down: at each by one further slot of its node, by a
    second one for some nodes."""

    def down(node: F.Column, at: int) -> F.Column:
        first = F.pmod(F.xxhash64(node, F.lit(at)), F.lit(SLOTS))
        second = F.pmod(F.xxhash64(node, F.lit(-at)), F.lit(SLOTS))
        more = F.pmod(F.xxhash64(node, F.lit(10_000 + at)), F.lit(1_000_000)) < int(1_000_000 * (1 / threshold - 1))

        def child(slot: F.Column) -> F.Column:
            return F.xxhash64(node, slot, F.element_at("slots", slot.cast("int") + 1))

        return F.when(more & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))

    out = F.array("node")
    for k in range(steps):
        out = F.flatten(F.transform(out, lambda node, at=level + k: down(node, at)))
    return out


def links(df: DataFrame, per_cent: int = 85, width: int = 5, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, trees: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, rep), (classes: rep, first), (links between reps: a, b).

    A rep numbers a class of equal sets, first is its smallest id. Links are confirmed, and enough for the components."""
    threshold = per_cent / 100
    keys = ["n_shingles", "k1", "k2"]
    sketch = written(sketches(df, width, doc, text))
    full = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.min_by("slots", "doc_id").alias("slots")).withColumn("rep", F.monotonically_increasing_id()))
    rows = sketch.select("doc_id", *keys).join(classes.select("rep", *keys), keys, "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    several, rows = _shared_ids(rows)
    known = classes.select("rep", F.lit(0).alias("number"), "n_shingles", "slots")
    count = trees_for(threshold) if trees is None else trees

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of these classes."""
        wanted = written(classes.select("rep", "first", "k1", "k2").join(ids.distinct(), "rep"))
        sets = _full_sets(df, wanted, width, doc, text)
        # Rows that repeat an id and its text say the same.
        return written(sets if several is None else sets.groupBy("rep").agg(F.first("members").alias("members"), F.first("size").alias("size")))

    def again(ids: DataFrame, numbers: range) -> DataFrame:
        """known of just these classes, with the hash functions of other rounds."""
        wanted = written(classes.select("rep", "first", "k1", "k2", "n_shingles").join(ids, "rep"))
        texts = _picked(df, wanted.select("rep", "first", "k1", "k2"), doc, text)
        out = None
        for number in numbers:
            fresh = sketches(texts, width, "rep", "text", number).withColumnRenamed("doc_id", "rep")
            part = wanted.join(fresh, ["rep", *keys]).dropDuplicates(["rep"]).select("rep", F.lit(number).alias("number"), "n_shingles", "slots")
            out = part if out is None else out.unionByName(part)
        return written(out)

    edges, done, chance, some = [], 1, 1.0, known
    while True:
        found, deep, depth = _round(some, sets_of, per_cent, limit, count)
        edges += found
        once = missed(threshold, count, depth)
        chance *= once if done == 1 else once**extra
        # Pairs that no branching could part are found by one round.
        if deep is None or chance <= MISS or once >= 1:
            break
        extra = max(1, math.ceil(math.log(MISS / chance) / math.log(once)))
        some = again(deep, range(done, done + extra))
        done += extra
    if several is not None:
        edges.append(several)
    for part in edges[1:]:
        edges[0] = edges[0].unionByName(part)
    return rows, classes.select("rep", "first"), written(edges[0].filter("a <> b").distinct())


def _shared_ids(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Links between the classes of one id (None: no id is repeated); rows, with empty ones in a class of their id."""
    per_id = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n"))
    more = written(per_id.filter("n > 1").drop("n"))
    if more.isEmpty():
        return None, rows
    small = F.broadcast(more) if more.count() <= BROADCAST_IDS else more
    joined = rows.join(small, "doc_id", "left")
    same = joined.filter("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    return written(same), joined.select("doc_id", "n_shingles", F.coalesce("rep", "least").alias("rep"))


def _round(known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], per_cent: int, limit: int, count: int) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Links that the trees of known (rep, number, n_shingles, slots) find, the sets (rep) that have been in a branching
    node, and the branchings."""
    starts = [F.xxhash64("number", F.lit(t), F.element_at("slots", t % SLOTS + 1)) for t in range(count)]
    nodes = known.select("rep", "number", "n_shingles", F.explode(F.array(*starts)).alias("node"))
    small, edges, level, deep, members = [], [], 0, None, None
    while True:
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
        crowded = written(sizes.filter((F.col("n") > limit) | (F.col("total") > LIMIT_SHINGLES)).filter("n > 1"))
        most = crowded.agg(F.count("*").alias("nodes"), F.max("n").alias("n"), F.max("total").alias("total")).first()
        if not most.nodes:
            small.append(nodes.select("node", "rep", "number"))
            break
        # Only large nodes are looked up; there are at most rows / limit of them.
        names = crowded.select("node")
        names = F.broadcast(names) if most.nodes <= BROADCAST_IDS else names
        small.append(written(nodes.join(names, "node", "left_anti").select("node", "rep", "number")))
        large = written(nodes.join(names, "node", "left_semi"))
        here = large.select("rep").distinct()
        if deep is None:
            deep = written(here)
            members = sets_of(deep)
        over = max(most.n / limit, most.total / LIMIT_SHINGLES)
        steps = min(STEPS, max(1, math.ceil(math.log(over) / -math.log(per_cent / 100))))
        found, rest = _pivots(large, known, members, per_cent, level + 1, steps)
        level += steps
        edges.append(found)
        nodes = written(rest)
    for part in small[1:]:
        small[0] = small[0].unionByName(part)
    return [*edges, _exhaustive(small[0], known, sets_of, per_cent)], deep, level


def _pivots(large: DataFrame, known: DataFrame, members: DataFrame, per_cent: int, level: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """Links of the sets of large nodes to their node's pivot; the nodes that sets which may have others go on to."""
    far = 1 - per_cent / 100
    pivots = large.groupBy("node").agg(F.min_by(F.struct("rep", "number"), F.xxhash64("rep", F.lit(level))).alias("p"))
    pivots = written(pivots.select("node", F.col("p.rep").alias("pivot"), F.col("p.number").alias("number")))
    # An estimate so low means a distance of more than 2 * far with near certainty: no need of the sets.
    least = min(0.3, 1 - 2 * far - 6 * math.sqrt(max(0.0, (1 - 2 * far) * 2 * far) / SLOTS))
    few = pivots.count() <= BROADCAST_IDS // 16
    theirs = pivots.join(known.select(F.col("rep").alias("pivot"), "number", F.col("slots").alias("pivot_slots")), ["pivot", "number"]).drop("number")
    theirs = F.broadcast(theirs) if few else theirs
    same = F.aggregate(F.zip_with("slots", "pivot_slots", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    seen = large.join(known.select("rep", "number", "slots"), ["rep", "number"]).join(theirs, "node")
    guess = written(seen.select("node", "rep", "number", "n_shingles", "pivot", (same / SLOTS).alias("guess"), _children(level, steps, per_cent / 100).alias("children")))
    near = guess.filter(F.col("guess") > least).select("rep", "pivot").distinct()
    full = members.select(F.col("rep").alias("pivot"), F.col("members").alias("pivot_members"), F.col("size").alias("pivot_size"))
    sized = near.join(members, "rep").join(full, "pivot")
    shared = F.size(F.array_intersect("members", "pivot_members"))
    exact = sized.select("rep", "pivot", shared.alias("shared"), (F.col("size") + F.col("pivot_size")).alias("both"))
    measured = written(
        guess.join(exact, ["rep", "pivot"], "left").select(
            "node", "rep", "number", "n_shingles", "pivot", "children",
            F.coalesce(1 - F.col("shared") / (F.col("both") - F.col("shared")), F.lit(2 * far)).alias("d"),
            F.coalesce(100 * F.col("shared") >= per_cent * (F.col("both") - F.col("shared")), F.lit(False)).alias("linked"),
        )
    )
    nearest = measured.groupBy("node").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("nearest"))
    nearest = F.broadcast(nearest) if few else nearest
    needed = ~F.col("linked") | (F.col("d") >= F.col("nearest") - far - 1e-9)
    rest = measured.join(nearest, "node").filter((F.col("rep") != F.col("pivot")) & needed)
    rest = rest.select(F.explode("children").alias("node"), "rep", "number", "n_shingles").distinct()
    return measured.filter("linked").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")), rest


def _exhaustive(small: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], per_cent: int) -> DataFrame:
    """Links within nodes of bounded size."""
    least = _ruled_out(per_cent / 100)

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, reps, group = [], [], []
            for row in range(batch.num_rows):
                flat = batch.column(0)[row].values
                rep = flat.field("rep").to_numpy()
                slots = flat.field("slots").flatten().to_numpy().reshape(len(rep), SLOTS)
                order = np.argsort(rep)
                for found in likely_groups(slots[order], least):
                    some = np.sort(rep[order][found])
                    key.append(int(mixed(stream(len(some), 5) * mixed(some.astype(np.uint64))).sum(dtype=np.uint64).astype(np.int64)))
                    reps.append(some.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(reps, pa.list_(pa.int64()))], names=["key", "reps"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                flat = batch.column(0)[row].values
                rep = flat.field("rep").to_numpy()
                sets = [s.values.to_numpy().view(np.uint64) for s in flat.field("members")]
                for x, y in exact_links(sets, per_cent):
                    a.append(min(int(rep[x]), int(rep[y])))
                    b.append(max(int(rep[x]), int(rep[y])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # Nodes hold at most `limit` sets, so the lists are bounded; most nodes have one set, which needs no slots.
    named = small.groupBy("node").agg(F.collect_list(F.struct("rep", "number")).alias("sets")).filter(F.size("sets") > 1)
    each = named.select("node", F.explode("sets").alias("s")).select("node", "s.*")
    listed = each.join(known.select("rep", "number", "slots"), ["rep", "number"]).groupBy("node").agg(F.collect_list(F.struct("rep", "slots")).alias("sets"))
    groups = listed.select("sets").mapInArrow(guessed, "key long, reps array<long>").groupBy("key").agg(F.first("reps").alias("reps"))
    groups = written(groups)
    members = sets_of(groups.select(F.explode("reps").alias("rep")))
    rows = groups.select("key", F.explode("reps").alias("rep")).join(members, "rep")
    return rows.groupBy("key").agg(F.collect_list(F.struct("rep", "members")).alias("sets")).select("sets").mapInArrow(confirmed, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, component): the smallest rep reachable, for all reps of links (a < b).

    Each round links every rep to the smallest one it sees, then follows those labels once more; labels only fall, and
    the rounds end when none does."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(seen, "a").select("a", "label", F.least("label", "theirs").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        after = written(lower.join(jump, "next", "left").select("a", F.least("next", "far").alias("next"), "label"))
        changed = not after.filter("next <> label").isEmpty()
        labels = after.select("a", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("a").alias("rep"), F.col("label").alias("component"))


def near_duplicates(df: DataFrame, per_cent: int = 85, width: int = 5, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, trees: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (the smallest of its component)."""
    rows, classes, edges = links(df, per_cent, width, doc, text, limit, trees)
    named = components(edges).join(classes, "rep")
    least = named.groupBy("component").agg(F.min("first").alias("linked"))
    # A class without links is a component of its own.
    linked = named.select("rep", "component").join(least, "component").select("rep", "linked")
    out = rows.join(classes, "rep", "left").join(linked, "rep", "left")
    component = F.coalesce("linked", "first", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
