"""Joins whose left side may hold most of its rows under a few keys.

Adaptive execution splits a hot partition only when both sides of the join come
straight from a shuffle that the join asked for. When the right side was already
grouped or joined by the same key there is no such shuffle, and the hot key would
stay in one task. These joins spread the rows of a key over as many groups as its
row count asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task takes; a key has ceil(rows / target) groups.
TARGET_ROWS = 1_000_000
# Left rows without a key match nothing; they only have to lie apart.
KEYLESS_GROUPS = 1 << 16


def key_groups(df: DataFrame, on: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Keys that need more than one group, with the number of their groups.

    Counted exactly with map-side partial sums. A key is listed if it holds more than ``target_rows``
    rows, whatever its share, so the list has fewer than rows / target_rows entries.
    """
    return _large(df.groupBy(*on).agg(F.count("*").alias("rows")), on, target_rows)


def _large(counts: DataFrame, on: list[str], target_rows: int) -> DataFrame:
    groups = F.ceil(F.col("rows") / target_rows).cast("int").alias("groups")
    return counts.filter(F.col("rows") > target_rows).select(*on, groups)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    target_rows: int = TARGET_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with the same result as ``left.join(right, on, how)``.

    Left rows of a key are dealt to its groups by a hash of the ``spread`` columns, and
    right rows are repeated once per group of their key. Left rows with a NULL key match
    nothing and are spread as well. ``how`` is inner, left, left_semi or left_anti.
    A caller that has counted the left rows per key passes ``counts`` (key, rows); else they are read once more for it.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    if counts is None:
        groups = key_groups(left.select(*on).dropna(), on, target_rows)
    else:
        groups = _large(counts.dropna(subset=on), on, target_rows)
    no_key: Column = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    of_row = F.when(no_key, KEYLESS_GROUPS).otherwise(F.coalesce("groups", F.lit(1)))
    salted = (
        left.join(groups, on, "left")
        .withColumn("salt", F.pmod(F.xxhash64(*spread), of_row).cast("int"))
        .drop("groups")
    )
    last = F.coalesce("groups", F.lit(1)) - 1
    repeated = (
        right.join(groups, on, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("groups")
    )
    return salted.join(repeated, [*on, "salt"], how).drop("salt")
