"""Shared parts of the batch workflows.

A workflow takes a batch of requests and the present tables and returns an
:class:`Outcome`: every request with the reason for its refusal (NULL when it was
accepted), the tables after the batch, and rows to append. Nothing is written
here; see ``sources.sinks``.

Requests are ordered by (request_time, request_id). Which request wins a key is
found by a minimum or maximum over that order, computed with partial aggregation
and joined back, never by sorting all requests of a key in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.session import shared_folder

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    decided: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    appended: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.decided.filter(F.col("reason").isNull())

    @property
    def rejected(self) -> DataFrame:
        return self.decided.filter(F.col("reason").isNotNull())


def unstaged(df: DataFrame) -> DataFrame:
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """Stage that writes the decisions once to the cluster's checkpoint folder.

    Pass it to a workflow whose decisions feed several written tables. The folder
    is the one named in ``spark.checkpoint.dir``, reachable by all executors.
    """
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        raise ValueError("spark.checkpoint.dir is not set")
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Stage that writes the rows once as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order() -> Column:
    return F.struct("request_time", "request_id")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that applies, NULL if none does."""
    (condition, reason), *rest = checks
    return reduce(lambda acc, check: acc.when(check[0], check[1]), rest, F.when(condition, reason))


def with_roles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the role of their user; NULL for an unknown user."""
    return requests.join(users.select("user_id", "role"), "user_id", "left")


def by_roles(requests: DataFrame, users: DataFrame, roles: list[str]) -> DataFrame:
    """Requests whose user has one of the roles."""
    allowed = users.filter(F.col("role").isin(*roles)).select("user_id")
    return requests.join(allowed, "user_id", "left_semi")


def role_gate(requests: DataFrame, users: DataFrame, roles: list[str]) -> DataFrame:
    """Requests marked ``forbidden`` unless their user has one of the roles."""
    allowed = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    return with_roles(requests, users).withColumn("reason", F.when(~allowed, "forbidden"))


def overwrite(table: DataFrame, changes: DataFrame, key: list[str], column: str, new: str) -> DataFrame:
    """Table with ``column`` replaced by ``new`` of the matching change, at most one per key."""
    return (
        table.join(changes.select(*key, new), key, "left")
        .withColumn(column, F.coalesce(F.col(new), F.col(column)))
        .select(*table.columns)
    )
