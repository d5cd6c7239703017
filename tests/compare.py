"""Rows of a query against rows of its SQL, in any order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of_sql(db, sql):
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(normal(r[k]) for k in by) for r in found.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
