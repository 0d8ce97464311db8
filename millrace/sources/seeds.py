"""CSV seeds with a header, loaded under a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.tables import layout, store


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the CSV files at `path`; a header or value that does not fit the schema fails the load."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def load_seed(
    spark: SparkSession, path: str, schema: str, table: str, full_refresh: bool = False
) -> DataFrame:
    """Replace the table's rows with the seed; `full_refresh` replaces its schema as well."""
    rows = read_seed(spark, path, schema)
    if not full_refresh and spark.catalog.tableExists(table):
        kept = spark.table(table)
        if layout(kept) != layout(rows):
            raise ValueError(f"{table} has another schema; load it with full_refresh")
    return store(spark, table, rows)
