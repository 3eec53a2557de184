"""Compare Spark results with DuckDB the way a reader would: by column name, in any row order."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql: str):
    result = con.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())


def difference(spark_side, duck_side) -> str | None:
    """None when equal, else a few words and the first differing rows."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} against {duck_side[0]}"
    a, b = spark_side[1], duck_side[1]
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}: {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    types = [{type(v) for r in side for v in (r[i],) if v is not None} for side in (a, b) for i in range(len(spark_side[0]))]
    n = len(spark_side[0])
    for i in range(n):
        if types[i] and types[n + i] and types[i] != types[n + i]:
            return f"type of {spark_side[0][i]}: {types[i]} against {types[n + i]}"
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb], [x for x in b if x not in sa]
        return f"{len(only_a)} rows differ: {only_a[:2]} {only_b[:2]}"
    return None
