"""Sources and sinks: scans, literal rows, bulk copies, created and materialised tables, partitioned exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.changes import Refused, insert_rows


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table by name; the path is only read by Spark."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def literal_rows(spark: SparkSession, columns: list[str], values: list[list], schema: StructType) -> DataFrame:
    """Literal rows, cast to the target's types; a bad arity, name, cell or cast refuses the whole load."""
    if len(set(columns)) < len(columns):
        raise Refused("a column is named twice")
    if unknown := [c for c in columns if c not in schema.names]:
        raise Refused(f"no column {unknown}")
    for row in values:
        if len(row) != len(columns):
            raise Refused("a row's cells and the columns differ in number")
        if any(isinstance(v, (list, dict)) for v in row):
            raise Refused("cells are scalars")
    text = [[None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row] for row in values]
    rows = spark.createDataFrame(text, StructType([StructField(c, StringType()) for c in columns]))
    return rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])


def copy_rows(target: DataFrame, path: str, schema: StructType, form: str = "csv", **options) -> DataFrame:
    """Bulk append of files with named columns; a malformed row fails the whole copy."""
    named = {"header": "true", "enforceSchema": "false"} if form == "csv" else {}
    rows = target.sparkSession.read.schema(schema).options(mode="FAILFAST", **named, **options).format(form).load(path)
    return insert_rows(target, rows)


def create_table(spark: SparkSession, schema: StructType, primary_key: list[str] | None = None) -> DataFrame:
    """An empty typed table; key columns become NOT NULL."""
    fields = [StructField(f.name, f.dataType, f.nullable and f.name not in (primary_key or []), f.metadata) for f in schema.fields]
    return spark.createDataFrame([], StructType(fields))


def create_table_as(query: DataFrame, path: str, with_data: bool = True) -> DataFrame:
    """The query's rows written as a table; without data only the schema."""
    (query if with_data else query.limit(0)).write.mode("errorifexists").parquet(path)
    return query.sparkSession.read.schema(query.schema).parquet(path)


def materialize(query: DataFrame, path: str, with_data: bool = True) -> DataFrame:
    """A materialised view's contents, replaced at each refresh. The query must not read ``path``."""
    (query if with_data else query.limit(0)).write.mode("overwrite").parquet(path)
    return query.sparkSession.read.schema(query.schema).parquet(path)


def replace_view(name: str, query: DataFrame) -> DataFrame:
    """A named query; what reads the name follows."""
    query.createOrReplaceTempView(name)
    return query.sparkSession.table(name)


def import_tables(spark: SparkSession, folder: str, tables: list[str], limit_to: list[str] | None = None, except_: list[str] | None = None, prefix: str = "") -> list[str]:
    """Register tables of a store as views; ``limit_to`` and ``except_`` exclude each other."""
    if limit_to and except_:
        raise Refused("limit_to and except exclude each other")
    chosen = [t for t in tables if (not limit_to or t in limit_to) and t not in (except_ or [])]
    for t in chosen:
        scan(spark, folder, t).createOrReplaceTempView(prefix + t)
    return [prefix + t for t in chosen]


def export_partitioned(df: DataFrame, path: str, keys: list[str], order: list[str | Column], files_per_key: int | None = None) -> DataFrame:
    """A layout-aware write: one folder per key value, rows sorted inside each file.

    Unless a number of files is stated, tasks are evened out by size: a key with many
    rows is written by many tasks, and many small keys by one.
    """
    if files_per_key is None:
        named = ", ".join(f"`{k}`" for k in keys)
        dealt = df.sparkSession.sql(f"SELECT /*+ REBALANCE({named}) */ * FROM {{df}}", df=df)
    else:
        dealt = df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key)))
    dealt.sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.parquet(path)
