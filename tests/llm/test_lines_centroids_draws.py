"""Line dedup, centroid clustering and resampling against brute force on small tables of odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barfold.llm import centroids, line_runs, resample
from barfold.llm.text import pieces

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# Line dedup


def brute_lines(rows):
    first, out = {}, []
    order = lambda d: (1 << 63) - 1 if d is None else d
    split = [[(line, lower(line.strip(" \t\n\x0b\x0c\r"))) for line in (t or "").split("\n")] for _, t in rows]
    for (d, _), lines in zip(rows, split, strict=True):
        for _, key in lines:
            if len(key) >= 10:
                first[key] = min(first.get(key, order(d)), order(d))
    for (d, _), lines in zip(rows, split, strict=True):
        kept = [line for line, key in lines if len(key) < 10 or first[key] == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed=3, n=70):
    rng = random.Random(seed)
    common = ["All rights reserved 2024", "  all RIGHTS reserved 2024\t", "ÉCOLE nationale", "école nationale", "short", "", "ninechars", "tencharsss", "a line of its own, twice", "日本語日本語日本語日"]
    rows = [(k, "\n".join(rng.choice([*common, f"line number {rng.randint(0, 40)} here"]) for _ in range(rng.randint(1, 12)))) for k in range(n)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "trailing line here\n"), (204, "\ntrailing line here"), (205, "\x00odd\x00 line of text\r"), (206, "\r\x0bODD\x00 line"), (207, "long line " * 50_000 + "\n" + "x\n" * 30_000)]
    rows += [rows[5], rows[5], (6, "another text under six\nAll rights reserved 2024"), (None, "All rights reserved 2024\nonly without an id"), (None, "only without an id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = line_rows()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, ord string, n_lines int").repartition(5)
    out = line_runs.dedup_lines(df, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "ord", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_of_an_empty_table_and_of_one_document(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "the same line\nthe same line")] * 40
    out = line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 40 and {(r.n_lines, r.n_dropped) for r in out} == {(2, 0)}


def test_runs_are_compacted_by_level(spark):
    store = line_runs.LineRuns(spark, fanout=2)
    try:
        for k in range(5):
            hashes = spark.range(10 * k, 10 * k + 15).selectExpr("id AS h1", "-id AS h2")
            new = store.unseen(hashes)
            assert new.count() == (15 if k == 0 else 10)
            store.add(spark.createDataFrame(new.collect(), new.schema))
        assert [len(level) for level in store.levels] == [1, 0, 1]
        assert sorted(r.h1 for name in store.runs() for r in spark.table(name).collect()) == list(range(55))
    finally:
        store.close()


def test_runs_are_joined_without_shuffling_them(spark):
    """A run is read by buckets: only the batch is exchanged, once for all runs."""
    store = line_runs.LineRuns(spark, fanout=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(2):
            store.add(spark.range(100 * k, 100 * k + 100).selectExpr("id AS h1", "id AS h2"))
        plan = store.unseen(spark.range(500).selectExpr("id AS h1", "id AS h2", "id AS first"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.close()


# Centroids


def brute_clusters(rows, k, rounds, width, scale, seed):
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    points = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, p)), j) for j, p in enumerate(points)) for _, x in kept]

    for _ in range(rounds):
        nearest = assign()
        for j in range(len(points)):
            mine = [x for (_, x), (_, c) in zip(kept, nearest) if c == j]
            if mine:
                points[j] = [sum(v) // len(mine) for v in zip(*mine)]
    nearest = assign()
    total = [sum(d for d, c in nearest if c == j) for j in range(len(points))]
    return sorted(((i, c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, nearest)), key=str)


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (5, width))
    rows = [(k, [float(v) for v in np.float32(middles[k % 5] + rng.normal(0, 0.6, width))]) for k in range(n)]
    rows += [rows[0], rows[0], (7, rows[3][1]), (None, rows[2][1]), (900, [0.0] * width), (901, [0.0] * width)]
    rows += [(902, None), (903, []), (904, [1.0] * (width - 1)), (905, [float("nan")] * width), (906, [float("inf"), *[0.0] * (width - 1)]), (907, [None, *[0.0] * (width - 1)])]
    return rows


@pytest.mark.parametrize("k, rounds, n", [(8, 10, 150), (3, 2, 60), (40, 3, 10)])
def test_clusters_equal_brute_force(spark, k, rounds, n):
    rows = vectors(k, n, 6)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)
    found = centroids.summary(*centroids.cluster(df, k=k, rounds=rounds, width=6))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_clusters(rows, k, rounds, 6, 1024, 3)


def test_matrix_updates_stay_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 20), 1 << 20, (50, 7))
    df = spark.createDataFrame([(k, [int(v) for v in row]) for k, row in enumerate(x)], "vec_id long, x array<int>")
    points = [[int(v) for v in row] for row in x[:4]]
    state = centroids.begin(df, points)
    for step in range(3):
        delta = [[0] * 7 for _ in points]
        delta[step % 4][step] = 12345 - step
        delta[3][6] = -7
        points = [[a + b for a, b in zip(p, d)] for p, d in zip(points, delta)]
        state = centroids.update(state, points, delta)
    dots = np.array([r.dots for r in state.orderBy("vec_id").collect()])
    assert (dots == x @ np.array(points).T).all()


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0])]):
        assert centroids.summary(*centroids.cluster(spark.createDataFrame(rows, schema))).count() == 0
    with pytest.raises(Exception, match="a component beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], schema), width=2)


# Resampling


def brute_draw(rows, target, per_cent=5, least=20, seed=42):
    def features(text):
        w = WORDS.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % resample.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = [0] * resample.BUCKETS, [0] * resample.BUCKETS
    made = [(d, *features(text)) for d, text in rows]
    for _, _, f in made:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + resample.BUCKETS) / ((s[b] + 1) * (T + resample.BUCKETS)))) for b in range(resample.BUCKETS)]
    out = []
    for d, n, f in made:
        weight = sum(gain[b] for b in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: per_cent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def draw_rows(seed=5, n=160):
    rng = random.Random(seed)
    words = ["The", "of", "É", "日本", "x" * 80, "y" * 64, *("w%d" % k for k in range(60))]
    rows = [(k, rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    rows += [(500, None), (501, ""), (502, "..."), (503, "word " * 40_000), (504, "z" * 100_000), (505, "only two"), (None, rows[3][1]), (None, None)]
    return [*rows, rows[0], rows[0], rows[1]]


@pytest.mark.parametrize("per_cent, pivots", [(5, 32), (40, 3), (100, 2), (0, 4)])
def test_draws_equal_brute_force(spark, per_cent, pivots):
    rows, target = draw_rows(), ["w1 w2 w3 the of", "w5 É w5", None, ""]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, score int, row string").repartition(4)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(df, items, per_cent=per_cent, pivots=pivots).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(rows, target, per_cent)


def test_draws_of_tied_rows(spark):
    """A third of all rows is one row: as many of its copies win as the cut takes."""
    rows = draw_rows(n=60) + [(9, "w1 " * 30)] * 40
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w1",)], "text string"), per_cent=30, pivots=2)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_draw(rows, ["w1 w1"], 30)


def test_draws_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    few = resample.resample(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), none)
    assert {(r.doc_id, r.n_features, r["rank"]) for r in few.collect()} == {(1, 3, None), (None, 0, None)}


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_quickselect_finds_every_place(spark, k):
    rng = random.Random(k)
    rows = [(rng.randint(0, 5), rng.randint(0, 20), n) for n in range(1000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long")
    assert resample.kth_key(df, k, pivots=5) == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[k - 1]


def test_crcs_of_spans():
    texts = ["", "a", "É" * 40, "x" * 64, "x" * 65, "ab " * 100]
    for _, _, piece in pieces(pa.array(texts)):
        starts, ends = piece.words(np.isin(np.arange(256), [32]))
        raw = [piece.data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert resample.word_crcs(piece.data, starts, ends).tolist() == [zlib.crc32(b) for b in raw]
        joined = resample.shifted(resample.word_crcs(piece.data, starts[:-1], ends[:-1]), (ends - starts)[1:]) ^ resample.word_crcs(piece.data, starts[1:], ends[1:])
        assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(raw, raw[1:])]
