"""Spark result against the SQL counterpart on DuckDB. Also a script: python tests/compare.py SF [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def canon(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (0.0 if v == 0 else v)
        return v

    return sorted((tuple(cell(v) for v in row) for row in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


def check(spark, con, key: str, sf: str) -> str:
    """'' if equal, else what differs. Without SQL only the run itself is checked."""
    from wakeline.catalog import ORACLES, QUERIES

    df = QUERIES[key](spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    got = canon([tuple(row) for row in df.select(*cols).collect()])
    if key not in ORACLES:
        return "" if got else "no rows"
    rel = con.sql(ORACLES[key])
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    order = ", ".join(f'"{c}"' for c in cols)
    want = canon(con.sql(f"SELECT {order} FROM ({ORACLES[key]})").fetchall())
    if got == want:
        return "" if got else "EMPTY on both sides"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(cols, got[0], want[0]) if type(a) is not type(b)]
    return f"{len(bad)} of {len(got)} differ, types {types}, cols {cols}, e.g. {bad[:2]}"


def main() -> None:
    from wakeline.catalog import ORACLES, QUERIES
    from wakeline.session import build_session

    sf, keys = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = build_session(cores=8), connect(sf)
    failed = 0
    for key in keys:
        t = time.time()
        try:
            res = check(spark, con, key, sf)
        except Exception as e:  # report and go on
            res = "ERROR " + str(e).split("\n")[0][:300]
            if len(keys) < 5:
                traceback.print_exc()
        failed += bool(res)
        print(f"{'ok ' if not res else 'BAD'} {key} {time.time() - t:.1f}s {'' if key in ORACLES else '[rows]'} {res}", flush=True)
    print(f"{len(keys)} keys, {failed} bad, {len(ORACLES)} with SQL of {len(QUERIES)}")


if __name__ == "__main__":
    main()
