"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare schema, rows and values.

    python tests/oracle_compare.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FAMILY = {"int8": "int", "int16": "int", "int32": "int", "int64": "int", "double": "float", "float": "float"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted("\x1f".join(cell(v) for v in r) for r in zip(*cols))


def compare(name, spark_table, duck_table) -> str | None:
    a_names, a = rows(spark_table)
    b_names, b = rows(duck_table)
    if a_names != b_names:
        return f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    types = lambda t: {f.name: FAMILY.get(str(f.type), str(f.type)) for f in t.schema}
    ta, tb = types(spark_table), types(duck_table)
    bad = {n: (ta[n], tb[n]) for n in a_names if ta[n] != tb[n] and "timestamp" not in ta[n] and "null" not in tb[n]
           and "string" not in ta[n]}
    if bad:
        return f"types {bad}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        show = "\n   ".join(f"{x.split(chr(31))}\n   {y.split(chr(31))}" for x, y in diff[:2])
        return f"{len(diff)} of {len(a)} rows differ\n   {show}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tamis.session import build_session

    spark = build_session("oracle", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, sql = entry.queries(), entry.oracle_sql()
    con = duck(args.sf)
    failed = []
    wanted = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    for name in wanted:
        start = time.time()
        try:
            got = queries[name](spark, args.sf).toArrow()
            took = time.time() - start
            problem = None
            if name in sql:
                t2 = time.time()
                want = con.sql(sql[name]).to_arrow_table()
                problem = compare(name, got, want)
                note = f"sql {time.time() - t2:.1f}s"
            else:
                note = "rows only"
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} {got.num_rows} rows {took:.1f}s {note}", flush=True)
            if problem:
                failed.append(name)
                print("  ", problem, flush=True)
        except Exception as e:
            failed.append(name)
            text = str(e).strip().splitlines()
            print(f"FAIL {name} {type(e).__name__}: {' | '.join(text[:3])[:700]}", flush=True)
            if args.names:
                traceback.print_exc(limit=-4)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
