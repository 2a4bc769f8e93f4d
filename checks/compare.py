"""Run queries on Spark and their SQL on DuckDB, and compare whole results.

    python -m checks.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(v is None, type(v).__name__, v if v is not None else 0)
                                       for v in r])


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-12, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def differences(spark_df, con: duckdb.DuckDBPyConnection, statement: str) -> list[str]:
    """What differs, or nothing."""
    columns = sorted(spark_df.columns)
    expected = con.sql(statement)
    if sorted(expected.columns) != columns:
        return [f"columns {columns} != {sorted(expected.columns)}"]
    quoted = ", ".join(f'"{c}"' for c in columns)
    right = _sorted(con.sql(f"SELECT {quoted} FROM ({statement})").fetchall())
    left = _sorted([tuple(r) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect()])
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    found = []
    for a, b in zip(left, right):
        wrong = [f"{c}: {x!r} != {y!r}" for c, x, y in zip(columns, a, b) if not _same(x, y)]
        if wrong:
            found.append(f"{a}: " + "; ".join(wrong))
    return found[:3] + ([f"{len(found)} rows differ"] if found else [])


def main(argv: list[str]) -> int:
    from checks.oracle import all_oracles
    from checks.queries import all_queries
    from gondola.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = all_queries(), all_oracles()
    print("without SQL:", sorted(set(queries) - set(oracles)))
    print("SQL only:", sorted(set(oracles) - set(queries)))
    spark, con = local_session("compare"), connect(sf_dir)
    bad = 0
    for name, query in queries.items():
        if argv[1:] and not name.startswith(tuple(argv[1:])):
            continue
        start = time.time()
        try:
            wrong = differences(query(spark, sf_dir), con, oracles[name])
        except Exception as error:  # report every query, not only the first failure
            wrong = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - start:.2f}s", *wrong,
              sep="\n     " if wrong else " ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
