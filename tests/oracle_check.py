"""Compare every registered query with its DuckDB counterpart: ``python -m tests.oracle_check [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 4)) for v in row)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    have = sorted(d[0] for d in result.description)
    if have != names:
        return f"columns {names} and {have}"
    order = [[d[0] for d in result.description].index(c) for c in names]
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not _same(g, w)]
    inexact = sum(g != w for g, w in zip(got, want, strict=True))
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    return f"(only the last place differs in {inexact} rows)" if inexact else ""


def _same(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b, strict=True):
        if type(x) is not type(y):
            return False
        if isinstance(x, float) and not (math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) or x != x and y != y):
            return False
        if not isinstance(x, float) and x != y:
            return False
    return True


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), oracle_sql()
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, query, oracle.get(name), sf_dir)
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if not verdict or verdict[0] == '(' else 'FAIL'} {kind:4} {time.time() - start:6.1f}s {name} {verdict}", flush=True)


if __name__ == "__main__":
    main()
