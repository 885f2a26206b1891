"""Sinks: append with defaults, snapshot versions, chart payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.sources.catalogue import TABLES


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Rows completed to the full column list of a table.

    A missing or NULL value takes the default of its column (identifier, current
    time, status); nullable columns without a default become NULL. A required
    column without a default must be supplied.
    """
    columns = []
    for c in TABLES[table].columns:
        given = c.name in rows.columns
        if not given and c.default is None and not c.nullable:
            raise ValueError(f"{table}.{c.name} has no default and was not supplied")
        value = F.col(c.name).cast(c.type) if given else F.lit(None).cast(c.type)
        if c.default is not None and not (given and c.nullable):
            value = F.coalesce(value, F.expr(c.default).cast(c.type))
        columns.append(value.alias(c.name))
    return rows.select(*columns)


def append_rows(rows: DataFrame, table: str, path: str, batch: str | int) -> None:
    """Add completed rows to the Parquet files of a table.

    The rows of one ``batch`` lie in a folder of their own, which a repeated attempt
    replaces, so a retry does not append them again. :func:`read_appended` reads all batches.
    """
    with_defaults(rows, table).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_appended(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Rows of a table that :func:`append_rows` wrote."""
    return spark.read.parquet(path).select(*[c.name for c in TABLES[table].columns])


def write_version(snapshot: DataFrame, path: str, version: int | str) -> str:
    """Write a snapshot beside the versions it was computed from; returns its path.

    A version that was written before is replaced by the same content, so a
    repeated attempt is harmless. A mark of one row follows when all files are there.
    """
    target = f"{path.rstrip('/')}/version={version}"
    snapshot.write.mode("overwrite").parquet(target)
    mark = snapshot.sparkSession.range(1).select(F.lit(str(version)).alias("version"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/marks/mark={version}")
    return target


def read_latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest finished version under ``path``: the highest number, else the last name.

    Only marked versions count, and only the files of the newest are read.
    """
    marks = spark.read.parquet(f"{path.rstrip('/')}/marks").select("version")
    number = F.col("version").try_cast("decimal(38,0)")
    newest = marks.agg(F.max_by("version", F.struct(number, "version"))).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/version={newest}")


def chart_payload(platforms: DataFrame, statuses: DataFrame, overview: DataFrame) -> DataFrame:
    """One JSON document per user for the charts: platforms by mean rate, statuses by name.

    Both lists hold at most one entry per enum value, so the documents stay small
    however many posts a user has.
    """
    platform_list = platforms.groupBy("user_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("mean_rate")).alias("order"),
                        "platform",
                        F.struct(
                            "platform", "post_count", "likes", "comments", "shares", "avg_rate", "total"
                        ).alias("entry"),
                    )
                )
            ),
            lambda x: x["entry"],
        ).alias("platforms")
    )
    status_list = statuses.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("status", F.col("post_count").alias("count")))).alias(
            "statuses"
        )
    )
    return (
        overview.select("user_id", (F.col("total_posts") > 0).alias("hasPosts"))
        .join(platform_list, "user_id", "left")
        .join(status_list, "user_id", "left")
        .select(
            "user_id",
            F.to_json(
                F.struct(
                    "hasPosts",
                    _or_empty(platform_list, "platforms"),
                    _or_empty(status_list, "statuses"),
                )
            ).alias("payload"),
        )
    )


def _or_empty(lists: DataFrame, column: str) -> Column:
    """The list column of a joined frame, empty where the join found nothing."""
    return F.coalesce(column, F.array().cast(lists.schema[column].dataType)).alias(column)
