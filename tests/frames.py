"""Small frames for hand-computed tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-03-31 00:00:00"


def timed(spark: SparkSession, rows, schema: str, *times: str) -> DataFrame:
    """Rows whose time columns are written as text."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c)) for c in times})


def orders(spark: SparkSession, rows) -> DataFrame:
    """(point_id, account, amount, paid_at)."""
    return timed(spark, rows, "point_id int, account string, amount double, paid_at string", "paid_at")


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
