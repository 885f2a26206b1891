"""Rows of a key in order, however many a key has: what came before a row.

A window over the key alone would put all rows of a hot key into one task. Here rows are
range-partitioned by (key, order), so a hot key lies in many tasks, each with a stretch of its
time. A stretch is one ``chunk`` of the key: windows run inside (key, chunk), and a chunk
passes what it ends with to the next one through one row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK, LAST = "_chunk", "_last"


Order = list[str] | list[Column]


def in_chunks(rows: DataFrame, key: list[str], order: Order) -> DataFrame:
    """Rows with the number of their chunk, which grows along the order of their key.

    The number is that of the task that holds the row: write the result before it is used twice.
    """
    return rows.repartitionByRange(*key, *order).withColumn(CHUNK, F.spark_partition_id())


def stretch(key: list[str], order: Order) -> tuple[Column, Column, Column]:
    """Frames inside a chunk: rows before this one, rows up to it, and whether it is the last."""
    own = Window.partitionBy(*key, CHUNK).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return before, upto, F.lead(F.lit(False), 1, True).over(own)


def earlier_chunks(key: list[str]):
    """Frame over the closing rows of a key's chunks: those before this one."""
    return Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def summed_up(rows: DataFrame, key: list[str], order: Order, value: Column, name: str) -> DataFrame:
    """Rows in chunks, with what :func:`resolved` needs. Write them before they are used."""
    before, upto, last = stretch(key, order)
    held = F.last("_value", ignorenulls=True)
    placed = in_chunks(rows.withColumn("_value", value), key, order)
    return placed.withColumns({name: held.over(before), "_ends_with": held.over(upto), LAST: last}).drop("_value")


def resolved(placed: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows of :func:`summed_up` with ``name`` filled from earlier chunks; NULL where a key is."""
    carried = F.last("_ends_with", ignorenulls=True).over(earlier_chunks(key)).alias("_carried")
    # Only keys that lie in several chunks have something to carry: two per task, and the hot ones.
    carries = placed.filter(LAST).select(*key, CHUNK, carried).filter(F.col("_carried").isNotNull())
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return (
        placed.join(carries, [*key, CHUNK], "left")
        .withColumn(name, F.when(keyed, F.coalesce(name, "_carried")))
        .drop("_carried", "_ends_with", LAST, CHUNK)
    )


def with_last_before(
    rows: DataFrame,
    key: list[str],
    order: Order,
    value: Column,
    name: str,
    stage: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Rows with ``name``: the value of the last earlier row of their key that has one.

    ``order`` is unique within a key; descending, it makes this the first later row. ``stage`` writes the
    rows once.
    """
    return resolved(stage(summed_up(rows, key, order, value, name)), key, name)
