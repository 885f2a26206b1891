"""Run a registered query in Spark and its oracle in DuckDB and compare them."""

from __future__ import annotations

import datetime
import decimal

import duckdb

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows(names: list[str], data) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, df.collect())


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    return rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """First difference between a Spark result and an oracle result, None if equal."""
    got_names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} vs {len(want)} rows; columns {got_names}; only Spark {only_got}; only oracle {only_want}"
