"""Sheets as they are stored: one row a table, one row a table's row, values by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.scope import Scope


def write(rows: DataFrame, path: str) -> None:
    """Store rows (organization_id, knowledge_base_id, document_id, document_name, table_id, sheet, headers, notes, truncated, row_index, values).

    Rows lie by a hash of their table, a large table over many files, so one table's rows are read from few of them.
    """
    about = ["organization_id", "knowledge_base_id", "document_id", "document_name", "table_id", "sheet", "headers", "notes", "truncated"]
    rows.groupBy(*about).agg(F.count("*").alias("rows")).write.parquet(f"{path}/tables")
    kept = rows.select("table_id", "row_index", "values", F.pmod(F.xxhash64("table_id"), F.lit(64)).cast("int").alias("part"))
    kept.repartition("part", F.floor(F.col("row_index") / 100_000)).sortWithinPartitions("table_id", "row_index").write.partitionBy("part").parquet(f"{path}/rows")


def listed(spark: SparkSession, path: str, scope: Scope) -> DataFrame:
    """The tables that a scope may see, in order of document and table."""
    return spark.read.parquet(f"{path}/tables").where(scope.condition()).orderBy("document_id", "table_id")


def rows_of(spark: SparkSession, path: str, table_id: str) -> DataFrame:
    """(row_index, values) of one table; the partition and the sort order keep others unread."""
    part = F.pmod(F.xxhash64(F.lit(table_id)), F.lit(64)).cast("int")
    return spark.read.parquet(f"{path}/rows").where((F.col("part") == part) & (F.col("table_id") == table_id)).select("row_index", "values").orderBy("row_index")
