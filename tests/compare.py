"""Run a registered query and its SQL oracle, and compare their rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    if hasattr(value, "normalize"):
        return repr(float(value))
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in frame.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = [columns.index(n) for n in sorted(columns)]
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(columns), sorted(rows)
