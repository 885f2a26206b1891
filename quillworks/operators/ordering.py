"""Sorts, limits and top rows per group.

Every order ends with the primary key, so equal sort values give the same result
on every run, and a global sort can split a value that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_first(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(key))


def by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.orderBy(F.asc(name), F.asc(key))


def top_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First rows of the whole table: each task keeps ``limit`` rows before they meet."""
    return df.orderBy(*order).limit(limit)


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """First rows of every group with their rank.

    The rank filter lets Spark cut each group to ``limit`` rows before the
    shuffle, so a group with most of the rows arrives as a few rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def latest_per_group(df: DataFrame, group: list[str], order: list[str], *columns: str) -> DataFrame:
    """The newest row of every group, by aggregation with partial maxima."""
    newest = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("newest")
    return df.groupBy(*group).agg(newest).select(
        *group, *[F.col(f"newest.{c}").alias(c) for c in columns]
    )
