"""Run registered queries beside their SQL on DuckDB and compare columns, types and all values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def rows_of(names: list[str], records) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in records)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.sql(sql)
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {n: DUCK_TYPES.get(str(t), str(t)) for n, t in zip(result.columns, result.types, strict=True)}
    if mine != theirs:
        return f"schema: {set(mine.items()) ^ set(theirs.items())}"
    got = rows_of(list(mine), df.collect())
    expected = rows_of(result.columns, result.fetchall())
    if got == expected:
        return None
    extra, lacking = got - expected, expected - got
    return (f"{sum(extra.values())} of {sum(got.values())} rows differ ({sum(expected.values())} expected); "
            f"columns {sorted(mine)}; got {list(extra)[:2]}; expected {list(lacking)[:2]}")


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from shelfcast.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark: SparkSession = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            sql = oracle_sql().get(name)
            problem = difference(df, con, sql) if sql else f"(rows only) {len(df.collect())} rows"
        except Exception as error:
            problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        verdict = "ok" if problem is None or problem.startswith("(rows") else "DIFFERS"
        bad += verdict != "ok"
        print(f"{verdict:8}{time.time() - began:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")


if __name__ == "__main__":
    main()
