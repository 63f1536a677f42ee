"""Run registered queries on Spark and in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd


def canonical(rows: list[tuple]) -> list[tuple]:
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, float):
            return (2, f"{v:.6g}")
        if isinstance(v, int):
            return (3, str(v))
        return (4, str(v))

    return sorted(tuple(norm(v) for v in row) for row in rows)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from polislake.plans.bindings import BASE_TABLES

    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float, int, str]:
    import __spark_entry__ as entry

    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", took, len(got), ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return "COLUMNS", took, len(got), f"spark {cols} duckdb {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in raw]
    a, b = canonical(got), canonical(want)
    if a == b:
        return "ok", took, len(got), ""
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:2]
    only_b = [x for x in b if x not in in_a][:2]
    return "DIFF", took, len(got), f"{len(a)} vs {len(b)}; cols {cols}\n   spark {only_a}\n   duck  {only_b}"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from polislake.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name in sorted(entry.queries()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        print("...", name, end="\r", flush=True)
        try:
            status, took, n, note = compare(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            status, took, n, note = "ERROR", 0.0, 0, str(exc)[:700]
        if status in ("ok", "rows-only") and n == 0:
            note = "(EMPTY)"
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:10s} {took:6.2f}s {n:8d} {name} {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(sys.argv[1:]), 1))
