"""Readers: seed CSV files, Parquet tables, JDBC tables; schema evolution and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.sources.catalogue import SEED_TABLES, TABLES, Col, Table


def read_seed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Header CSV with the declared schema; an empty field is NULL, a bad row fails the read."""
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .schema(SEED_TABLES[table].schema)
        .csv(path)
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Parquet table of the catalogue; columns missing in old files read as NULL."""
    return spark.read.schema(TABLES[table].schema).parquet(f"{root.rstrip('/')}/{table}")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Table of a relational database, read in parallel ranges when a column to split by is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("bounds are needed to split a table by a column")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def add_columns(df: DataFrame, columns: tuple[Col, ...]) -> DataFrame:
    """Evolve a table: every missing column is added with its default, or NULL."""
    new = {
        c.name: F.expr(c.default or "NULL").cast(c.type)
        for c in columns
        if c.name not in df.columns
    }
    return df.withColumns(new) if new else df


def evolve(df: DataFrame, table: Table) -> DataFrame:
    """Bring an older file of a table to the present column list and order."""
    return add_columns(df, table.columns).select(*[c.name for c in table.columns])


def merge_generations(older: DataFrame, newer: DataFrame, table: Table) -> DataFrame:
    """Rows written before and after a schema change in one frame."""
    return evolve(older, table).unionByName(evolve(newer, table))


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, name, type, nullable."""
    if not tables:
        raise ValueError("no tables to describe")
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, position, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for position, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, nullable boolean"
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
