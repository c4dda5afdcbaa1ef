"""Run the registered queries beside their SQL and compare the rows.

Usage: python tests/check_queries.py [folder] [name …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from labelspark.session import local_session  # noqa: E402


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


def duck(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def compare(spark, con, name, query, sql, folder):
    """None if equal, else a text on the difference."""
    df = query(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoop" in plan:
        return "pairs every row with every row"
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    want = relation.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    for x, y in zip(a, b):
        if x != y:
            return f"{str(x)[:600]}\n   vs {str(y)[:600]}"
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, query, sql.get(name), folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        kind = "ok  " if problem is None else "BAD "
        print(kind, name, "" if name in sql else "(rows only)", f"{time.time() - started:.1f}s", problem or "", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
