"""Run registered queries against their SQL on DuckDB and compare values.

python tests/compare.py [sf_dir] [query ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def canonical(columns, rows):
    """Rows with columns in name order, as a sorted list of comparable tuples."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return (0, "")
        if isinstance(value, bool):
            return (1, str(value))
        if isinstance(value, (int, float)):
            return (2, repr(float(value)))
        return (3, str(value))

    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def oracle_rows(con, sql):
    found = con.execute(sql)
    return canonical([d[0] for d in found.description], found.fetchall())


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def connect(sf_dir):
    con = duckdb.connect()
    for table in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{sf_dir}/{table}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{source}')")
    return con


def main():
    from tallyward.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = get_session("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = []
    for name in names:
        started = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - started
            if name not in oracle:
                print(f"{name:32} {took:6.1f}s rows {len(got[1])} (no SQL)", flush=True)
                continue
            want = oracle_rows(con, oracle[name])
            ok = got == want
        except Exception as error:
            print(f"{name:32} ERROR {str(error)[:1500]}", flush=True)
            failed.append(name)
            continue
        print(f"{name:32} {took:6.1f}s rows {len(got[1])} {'ok' if ok else 'MISMATCH'}", flush=True)
        if not ok:
            failed.append(name)
            print("  columns", got[0], want[0])
            print("  only spark", [r for r in got[1] if r not in want[1]][:3])
            print("  only sql  ", [r for r in want[1] if r not in got[1]][:3])
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
