"""Helpers that several operators share: staged tables, order keys, row numbers over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.session import shared_folder

#: A null identifier ranks below every other one.
NO_ID = -(2**63)
#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: a lost executor costs only the tasks that were running.
    A join between two staged tables gets an exchange on both sides, which lets
    adaptive execution split a hot key.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_id(column: str | Column) -> Column:
    """The identifier as a number to order by; null ranks lowest."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def hash_pair(column: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: equal pairs stand for equal texts."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def with_row_number(df: DataFrame, order: list[Column], name: str, purpose: str) -> DataFrame:
    """Number all rows from 0 in the given order, without ever bringing them into one task.

    Rows are range-partitioned and sorted, numbered inside their partition and written;
    one row per partition gives the offsets.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = staged(
        sorted_rows.withColumns({"_part": F.spark_partition_id(), "_local": local}), purpose
    )
    counts = table.groupBy("_part").agg(F.count("*").alias("_rows")).collect()  # one row per partition
    offsets, total = {}, 0
    for part, rows in sorted((r["_part"], r["_rows"]) for r in counts):
        offsets[part] = total
        total += rows
    spark = df.sparkSession
    bounds = spark.createDataFrame(list(offsets.items()), "_part int, _offset long")
    return (
        table.join(F.broadcast(bounds), "_part")  # as many rows as partitions
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_offset")
    )
