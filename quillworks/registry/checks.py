"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillworks.registry.bindings import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-15 00:00:00"


def check(name: str, *tables: str, sql: str | None = None):
    """Register a query over the logical tables of a folder, with its oracle if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables) if tables else sql.strip()
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, which every client prints alike."""
    casts = {
        f.name: F.col(f.name).cast("string" if isinstance(f.dataType, T.DateType) else "double")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DateType, T.DecimalType))
    }
    return df.withColumns(casts) if casts else df


def timestamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


def mean6(total: str, count: str) -> str:
    """Oracle: mean of two-decimal rates in millionths, half away from zero, 0 without rows."""
    return (
        f"COALESCE((CAST({total} * 100 AS HUGEINT) * 20000 + CAST({count} AS HUGEINT))"
        f" // (2 * CAST(NULLIF({count}, 0) AS HUGEINT)), 0)"
    )


def shown(mean: str) -> str:
    """Oracle: millionths as a rate with two decimals."""
    return f"CAST((({mean}) + 5000) // 10000 AS DOUBLE) / 100.0"


def stable_id_sql(*parts: str) -> str:
    """Oracle: the identifier that ``scalars.stable_id`` derives from its parts."""
    digest = f"md5(concat_ws('|', {', '.join(parts)}))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    pieces = ", ".join(f"substring({digest}, {start}, {length})" for start, length in cuts)
    return f"concat_ws('-', {pieces})"


def stripped(text: str) -> str:
    """Oracle: text without blank characters at both ends."""
    blanks = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
    return f"trim({text}, concat({', '.join(f'chr({c})' for c in blanks)}))"


def quoted(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("'", "''") + "'"
