"""Compare catalogue queries with their SQL checks: names, types, row counts and values."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_KINDS = {
    "int32": "int", "int64": "int", "double": "float", "float": "float", "bool": "bool", "string": "text",
    "large_string": "text", "date32[day]": "date",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(t) -> str:
    s = str(t)
    if s.startswith("timestamp"):
        return "time, zoned" if "tz=" in s else "time"
    return _KINDS.get(s, s)


def _rows(table) -> pd.DataFrame:
    df = table.select(sorted(table.column_names)).to_pandas(timestamp_as_object=True)
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str), ignore_index=True)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences, empty when equal."""
    got, want = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    problems = [
        f"type of {n}: {got.schema.field(n).type} != {want.schema.field(n).type}"
        for n in got.column_names
        if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
        or str(got.schema.field(n).type).startswith("int") and got.schema.field(n).type != want.schema.field(n).type
    ]
    if got.num_rows != want.num_rows:
        return [*problems, f"rows {got.num_rows} != {want.num_rows}"]
    a, b = _rows(got), _rows(want)
    for c in a.columns:
        differs = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if differs.any():
            i = differs.idxmax()
            problems.append(f"{int(differs.sum())} values of {c}, first {a[c][i]!r} != {b[c][i]!r}")
    return problems


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from gaugelake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        # a session with Spark's defaults, as another program may hand in
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duck(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = compare(fn(spark, sf), con, sqls[name]) if name in sqls else ["no SQL"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n     " if problems else " ")
    print("failed:", bad)
