"""Runs a registered query and its check SQL side by side and compares names, types' kinds and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def check_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "hour"):
        return x.isoformat()
    return x


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple((type(v).__name__, v) for v in (_cell(r[i]) for i in order)) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    left = _normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = _normal([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{[(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]} in {a}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from civiclake.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = check_engine(sf_dir)
    wanted = sys.argv[1:]
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                diff = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            diff = f"ERROR {str(e)[:1500]}"
        bad += diff is not None and not diff.startswith("rows only")
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - start:.2f}s {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
