"""Compare a query with its SQL over the same tables, as sets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    rows = lambda cols, data: sorted(tuple(shown(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
