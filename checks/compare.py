"""Run registered queries beside their DuckDB SQL and compare rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kinds(df: pd.DataFrame) -> dict[str, str]:
    out = {}
    for c in df.columns:
        values = df[c].dropna()
        out[c] = type(values.iloc[0]).__name__ if len(values) else "none"
        if out[c].startswith(("int", "Int")):
            out[c] = "int"
        if out[c].startswith("float"):
            out[c] = "float"
    return out


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(
        tuple("~" if v is None or v != v else repr(v) if isinstance(v, float) else str(v) for v in r)
        for r in df.astype(object).itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    gk, wk = kinds(got), kinds(want)
    for c in gk:
        if gk[c] != wk[c]:
            return f"type of {c}: {gk[c]} != {wk[c]}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in args[1:] or QUERIES:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in ORACLE:
                problem = compare(got, con.execute(ORACLE[name]).fetchdf())
            else:
                problem = None if len(got) else "no rows"
            word = "ok" if name in ORACLE else "rows-only"
        except Exception as e:  # report and go on with the next query
            t1 = time.time()
            problem, word = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += problem is not None
        print(f"{name:28s} {'FAIL ' + problem if problem else word:10s} "
              f"rows={len(got) if 'got' in dir() else 0} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s",
              flush=True)
        spark.catalog.clearCache()
    missing = sorted(set(ORACLE) - set(QUERIES))
    print("failed", failed, "oracle without query", missing, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
