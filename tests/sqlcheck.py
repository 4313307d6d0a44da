"""Holds a query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb

from correctness import rows_of


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def same(spark, sf_dir, query, sql):
    mine = query(spark, sf_dir).toPandas()
    theirs = connect(sf_dir).execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
