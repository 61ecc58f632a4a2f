"""Compare a query's rows with its SQL in DuckDB, regardless of order."""

import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(query, sql, spark, folder, connection):
    df = query(spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = connection.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(got_names) == sorted(names)
    columns = sorted(names)
    assert rows_of(columns, got_names, got) == rows_of(columns, names, cur.fetchall())
    return len(got)
