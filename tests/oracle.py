"""Side-by-side comparison of a query with its SQL on DuckDB."""

import glob
import math
import os

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)

    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


def same(spark, query, sql, sf_dir=SF):
    got = query(spark, sf_dir)
    want = connect(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(want.fetchall(), names)
