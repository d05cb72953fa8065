"""Compare a registered query with its SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(norm, value))
    if hasattr(value, "is_finite"):
        return round(float(value), 5)
    return value


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(norm(v) for v in row) for row in frame.select(*names).collect()), key=repr)


def expected(db, sql):
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(norm(row[k]) for k in order) for row in found.fetchall()), key=repr)
