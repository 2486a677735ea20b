"""Reading the corpus tables.

Every reader selects its columns by name before anything else happens, so that column
pruning reaches the Parquet scan and extra columns, whatever they are called, never
meet the names an operator uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Parquet table ``name`` under ``base``; only ``columns`` if any are given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df
