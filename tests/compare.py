"""Run registered queries on Spark and their SQL on DuckDB and compare row by row.

Usage: python tests/compare.py <sf dir> [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def spark_session(threads: str = "8"):
    from pyspark.sql import SparkSession

    from eviflow.session import configured

    builder = configured(SparkSession.builder.master(f"local[{threads}]")).config("spark.sql.shuffle.partitions", "8").config("spark.eviflow.partitions", threads)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) for one query."""
    start = time.time()
    df = query(spark, sf_dir)
    got_cols = df.columns
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows in {took:.1f}s (no SQL)"
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"{name}: columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    types_ok = True
    if got and want:
        for c in got_cols:
            x = next((r[c] for r in got if r[c] is not None), None)
            y = next((r[want_cols.index(c)] for r in want if r[want_cols.index(c)] is not None), None)
            if x is not None and y is not None and type(x) is not type(y):
                types_ok = False
                print(f"   {name}.{c}: {type(x).__name__} vs {type(y).__name__}")
    if a == b and types_ok:
        return bool(got), f"{name}: ok, {len(got)} rows in {took:.1f}s"
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{name}: DIFF {len(got)} vs {len(want)} rows\n   only spark {extra}\n   only sql   {missing}"


def main():
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = spark_session(), oracle(sf_dir)
    bad = []
    for name in names:
        try:
            ok, message = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, message = False, f"{name}: ERROR {type(error).__name__} {str(error)[:700]}"
        print(("  " if ok else "!! ") + message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")


if __name__ == "__main__":
    main()
