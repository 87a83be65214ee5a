"""Runs queries and their SQL side by side.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    index = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in index) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when names, kinds and values agree, otherwise what differs."""
    got = fn(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    a, b = ordered(got.columns, rows), ordered(names, expected)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return f"spark {x}\n  duck {y}\n  columns {sorted(names)}"
    kinds = dict(zip(names, (str(d[1]) for d in want.description)))
    mine = {n: t for n, t in got.dtypes}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}
    off = {n: (t, kinds[n]) for n, t in mine.items() if same.get(t, t) != kinds[n]}
    return f"types {off}" if off else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from heatframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name in sys.argv[2:] or list(queries):
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, sf, queries[name], oracles[name])
                rows = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                rows, problem = queries[name](spark, sf).count(), None
        except Exception as error:  # report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:32}{rows:>8} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
