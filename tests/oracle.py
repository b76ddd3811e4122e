"""Run registered queries beside their oracle SQL and compare them without regard to row order.

Usage: python tests/oracle.py [--sf 0.01] [--conf key=value ...] [name-prefix ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def compare(spark, con, sf_dir, name, query, sql):
    """Empty string when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    if "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString():
        return "the plan compares all rows with all rows"
    got_cols, got = spark_rows(df)
    if sql is None:
        return "" if got else "no rows"
    want_cols, want = duck_rows(con, sql)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if not got and not want:
        return "both empty"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"rows {len(got)} vs {len(want)}; first difference {str(bad)[:700]}"
    return ""


def session(cores="8", partitions="8"):
    from pyspark.sql import SparkSession

    from gridlake.session import configure

    spark = (
        configure(SparkSession.builder)
        .master(f"local[{cores}]")
        .appName("gridlake-tests")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    while argv[:1] == ["--conf"]:
        key, value = argv[1].split("=", 1)
        spark.conf.set(key, value)
        argv = argv[2:]
    sqls, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok  " if not problem else "FAIL"
        kind = "" if name in sqls else " (rows only)"
        print(f"{mark} {time.time() - start:6.1f}s {name}{kind} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
