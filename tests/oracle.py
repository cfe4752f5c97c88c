"""Compares a query with its statement in DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        if files and os.path.exists(files[0]):
            con.execute(f"create view {name} as select * from read_parquet({files})")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    plain = lambda x: None if x is None or x != x else str(x)
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=str)


def same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
