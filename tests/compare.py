"""Runs registered queries beside their DuckDB SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf_dir) -> tuple[bool, str, int]:
    df = query(spark, sf_dir)
    mine = df.collect()
    if sql is None:
        return True, "rows only", len(mine)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}", len(mine)
    types = {d[0]: str(d[1]) for d in cursor.description}
    other = {f.name: (SAME_TYPE.get(f.dataType.simpleString()), types[f.name]) for f in df.schema}
    other = {name: pair for name, pair in other.items() if pair[0] != pair[1]}
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a != b:
        return False, f"{len(mine)} rows against {len(theirs)}; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}", len(mine)
    if other:
        return False, f"types {other}", len(mine)
    return True, "equal", len(mine)


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from conftest import make_session

    spark, con, failed = make_session(), connect(sf_dir), 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, note, n = compare(spark, con, query, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note, n = False, f"{type(error).__name__}: {str(error)[:600]}", 0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {n:7d} rows {time.time() - start:6.2f}s {'' if ok else note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
