"""Run queries beside their oracle SQL and compare: ``python -m verification.check [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from barfold.session import local_session
from verification import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _text(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(_text(r[n]) for n in order) for r in rows), sorted(columns)


def compare(spark, con, sf_dir: str, name: str) -> str:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours, cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return f"rows  {name}: {len(ours)} rows, {t1 - t0:.1f}s"
    rel = con.sql(ORACLES[name])
    theirs, their_cols = _rows(rel.columns, rel.fetchall())
    t2 = time.time()
    timing = f"{len(ours)} rows, {t1 - t0:.1f}s / {t2 - t1:.1f}s"
    if cols != their_cols:
        return f"FAIL  {name}: columns {cols} / {their_cols}"
    if ours != theirs:
        diff = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"FAIL  {name}: {timing}, oracle {len(theirs)} rows, {len(diff)} differ, e.g. {diff[:2]}"
    return f"{'ok   ' if ours else 'EMPTY'} {name}: {timing}"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session("check"), connect(sf_dir), 0
    for name in names:
        try:
            line = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {name}: {type(e).__name__} {str(e)[:700]}"
        bad += line.startswith(("FAIL", "ERROR"))
        print(line, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
