"""Comparison of a query with its DuckDB oracle: names, row count and values."""

import glob
import os
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def agree(df, con, sql):
    cursor = con.execute(sql)
    names, theirs = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(n) for n in sorted(names)]
    back = [names.index(n) for n in sorted(names)]
    ours = sorted(repr([r[i] for i in at]) for r in df.collect())
    assert ours == sorted(repr([r[i] for i in back]) for r in theirs)
