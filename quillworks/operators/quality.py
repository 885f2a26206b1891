"""Data-quality checks driven by the catalogue.

All row checks of a table are counted in one pass over it. Reference and
uniqueness checks first count rows per key, so a key that many rows share costs
one row in the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import NULL_CHECKS, ORPHAN_CHECKS, RATE_TOLERANCE
from quillworks.functions.scalars import collated, rate, week_end
from quillworks.sources.catalogue import COLLATED_COLUMNS, TABLES, Reference, Table
from quillworks.sources.tables import union_all

Frames = dict[str, DataFrame]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _counted(df: DataFrame, conditions: dict[str, str], label: str, value: str) -> DataFrame:
    """Number of rows per named SQL condition, one row each, in one pass over the table."""
    counts = df.selectExpr(*[f"count_if({cond}) AS c{i}" for i, cond in enumerate(conditions.values())])
    entries = ", ".join(
        f"struct({_literal(name)} AS {label}, c{i} AS {value})" for i, name in enumerate(conditions)
    )
    return counts.selectExpr(f"inline(array({entries}))")


def row_counts(frames: Frames) -> DataFrame:
    """Rows per table and whether the table has any."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in frames.items()
    ]
    return union_all(counts).withColumn("ok", F.col("row_count") > 0)


def null_report(frames: Frames) -> DataFrame:
    """NULL key columns per label; an empty e-mail counts as missing."""
    parts = []
    for table in dict.fromkeys(t for _, t, _ in NULL_CHECKS):
        conditions = {}
        for label, owner, column in NULL_CHECKS:
            if owner == table:
                empty = f" OR {column} = ''" if column == "email" else ""
                conditions[label] = f"{column} IS NULL{empty}"
        parts.append(_counted(frames[table], conditions, "check_name", "null_count"))
    return union_all(parts)


def orphan_keys(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Key values of the child that no parent has, with the number of rows using them.

    A NULL key is returned too, with ``is_null`` set.
    """
    used = child.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("rows"))
    parents = parent.select(F.col(parent_column).alias("key"))
    return used.join(parents, "key", "left_anti").withColumn("is_null", F.col("key").isNull())


def orphan_counts(child: DataFrame, parent: DataFrame, reference: Reference) -> DataFrame:
    """Rows without parent: all of them, NULL keys only, and dangling keys only."""
    orphans = orphan_keys(child, parent, reference.column, reference.parent_column)
    rows = F.col("rows")
    return orphans.agg(
        F.coalesce(F.sum(rows), F.lit(0)).cast("bigint").alias("orphan_count"),
        F.coalesce(F.sum(F.when(F.col("is_null"), rows)), F.lit(0)).cast("bigint").alias("null_keys"),
        F.coalesce(F.sum(F.when(~F.col("is_null"), rows)), F.lit(0)).cast("bigint").alias("dangling"),
    )


def orphan_report(frames: Frames) -> DataFrame:
    """The labelled orphan counts; a NULL key counts as an orphan here."""
    parts = []
    for label, table, column in ORPHAN_CHECKS:
        reference = next(r for r in TABLES[table].references if r.column == column)
        counts = orphan_counts(frames[table], frames[reference.parent], reference)
        parts.append(counts.select(F.lit(label).alias("fk_check"), "orphan_count"))
    return union_all(parts)


def reference_report(frames: Frames) -> DataFrame:
    """Every declared reference whose tables are present; only dangling keys break one."""
    parts = []
    for table in _present(frames):
        for reference in table.references:
            if reference.parent in frames and reference.column in frames[table.name].columns:
                counts = orphan_counts(frames[table.name], frames[reference.parent], reference)
                name = f"{table.name}.{reference.column} -> {reference.parent}"
                parts.append(counts.select(F.lit(name).alias("reference"), "null_keys", "dangling"))
    return union_all(parts)


def duplicate_keys(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Key values that more than one row has; rows with a NULL in the key are exempt."""
    names = list(columns)
    keys = [collated(F.col(c)).alias(c) if c in COLLATED_COLUMNS else F.col(c) for c in names]
    return (
        df.dropna(subset=names)
        .groupBy(*keys)
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
    )


def uniqueness_report(frames: Frames) -> DataFrame:
    """Duplicate values of every primary and unique key whose columns are present."""
    parts = []
    for table in _present(frames):
        df = frames[table.name]
        for columns in ((table.key,), *table.unique):
            if set(columns) <= set(df.columns):
                counts = duplicate_keys(df, columns).agg(
                    F.count("*").alias("duplicate_keys"),
                    F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"),
                )
                name = f"{table.name}({', '.join(columns)})"
                parts.append(counts.select(F.lit(name).alias("unique_key"), "duplicate_keys", "surplus_rows"))
    return union_all(parts)


def _present(frames: Frames) -> list[Table]:
    return [TABLES[name] for name in frames]


def rule_conditions(table: Table, columns: list[str]) -> dict[str, str]:
    """Broken CHECK rules; a rule that evaluates to NULL passes.

    A rule over an absent column is left out, see :func:`skipped_rules`.
    """
    skipped = skipped_rules(table, columns)
    return {
        f"check: {name}": f"NOT ({condition})"
        for name, condition in table.rules.items()
        if name not in skipped
    }


def skipped_rules(table: Table, columns: list[str]) -> list[str]:
    """Names of the CHECK rules that name an absent column, as a whole word."""
    missing = [c.name for c in table.columns if c.name not in columns]
    return [
        name
        for name, condition in table.rules.items()
        if any(re.search(rf"\b{column}\b", condition) for column in missing)
    ]


def sound_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows that pass every CHECK rule of their table; the columns of the rules must be there."""
    skipped = skipped_rules(TABLES[table], df.columns)
    if skipped:
        raise ValueError(f"{table}: columns are missing for the rules {', '.join(skipped)}")
    broken = rule_conditions(TABLES[table], df.columns).values()
    return df.filter(" AND ".join(f"NOT coalesce({cond}, false)" for cond in broken)) if broken else df


def domain_conditions(table: Table, columns: list[str]) -> dict[str, str]:
    return {
        f"domain: {c.name}": f"{c.name} NOT IN ({', '.join(_literal(v) for v in c.domain)})"
        for c in table.columns
        if c.domain and c.name in columns
    }


def null_conditions(table: Table, columns: list[str]) -> dict[str, str]:
    return {
        f"not null: {c.name}": f"{c.name} IS NULL"
        for c in table.columns
        if not c.nullable and c.name in columns
    }


def length_conditions(table: Table, columns: list[str]) -> dict[str, str]:
    return {
        f"length: {c.name}": f"char_length(CAST({c.name} AS STRING)) > {c.length}"
        for c in table.columns
        if c.length and c.name in columns
    }


ROW_CHECKS = {
    "rules": rule_conditions,
    "domains": domain_conditions,
    "nulls": null_conditions,
    "lengths": length_conditions,
}


def row_check_report(frames: Frames, *kinds: str) -> DataFrame:
    """Violations per table and check, one pass per table; all kinds by default."""
    parts = []
    for table in _present(frames):
        df = frames[table.name]
        conditions: dict[str, str] = {}
        for kind in kinds or ROW_CHECKS:
            conditions |= ROW_CHECKS[kind](table, df.columns)
        if conditions:
            counted = _counted(df, conditions, "check_name", "violations")
            parts.append(counted.select(F.lit(table.name).alias("table_name"), "check_name", "violations"))
    return union_all(parts)


def rate_mismatches(logs: DataFrame, tolerance: str = RATE_TOLERANCE) -> DataFrame:
    """Snapshots whose stored rate differs from the formula; without views the rate is 0."""
    computed = F.coalesce(
        rate(F.col("likes"), F.col("comments"), F.col("shares"), F.col("views")),
        F.lit(0).cast("decimal(38,2)"),
    )
    return logs.withColumn("computed_rate", computed).filter(
        F.abs(F.col("engagement_rate") - F.col("computed_rate")) > F.lit(tolerance).cast("decimal(5,2)")
    )


def week_end_mismatches(recommendations: DataFrame) -> DataFrame:
    """Recommendations whose stored end date is not six days after the start."""
    return recommendations.filter(F.col("week_end_date") != week_end(F.col("week_start_date")))
