"""Run queries against DuckDB on the same tables and compare the rows.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return ("i", value)
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


SAME_TYPE = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_notes(df, cursor):
    """Columns whose types differ between the engines."""
    other = {d[0]: str(d[1]) for d in cursor.description}
    return [f"{n}: {t} / {other[n]}" for n, t in df.dtypes if SAME_TYPE.get(t) != other.get(n)]


def compare(spark, con, plan, sql, sf):
    """Return (rows, seconds, problem or None)."""
    start = time.time()
    df = plan(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got), took, None
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), took, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return len(got), took, f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    notes = type_notes(df, cursor)
    if notes:
        print("     types", notes)
    if bad:
        return len(got), took, f"{len(bad)} rows differ, first {bad[0]}"
    return len(got), took, None


def main():
    from __spark_entry__ import oracle_sql, queries
    from scoreloom.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    con = connect(args.sf)
    plans, sqls = queries(), oracle_sql()
    failed = []
    for name in args.names or plans:
        try:
            n, took, problem = compare(spark, con, plans[name], sqls.get(name), args.sf)
        except Exception as e:  # report and go on
            n, took, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:32s} {n:7d} {took:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
        spark.catalog.clearCache()
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
