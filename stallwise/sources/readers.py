"""Batch and stream sources.

``jdbc_table``, ``socket_lines`` and ``kafka_values`` only set options on Spark's own
connectors. They need a running service, so the tests cover the transformations around
them with files and leave the connectors themselves untested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stallwise.sources.schemas import positional


def delimited(
    spark: SparkSession, path: str, schema: StructType, delimiter: str = ","
) -> DataFrame:
    """Positional text file or glob under a fixed schema; short rows are padded with NULL."""
    return spark.read.schema(schema).option("sep", delimiter).csv(path)


def numbered_columns(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Headerless CSV as ``width`` text columns c0, c1, ..."""
    return delimited(spark, path, positional(width, {}))


def headed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header row. All columns are text; ``columns`` prunes the read."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*columns) if columns else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A database table; with a partition column and bounds it is read in parallel."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return (
        spark.readStream.format("socket")
        .option("host", host)
        .option("port", port)
        .option("includeTimestamp", True)
        .load()
    )


def new_text_files(spark: SparkSession, folder: str, max_files: int = 1000, archive: str | None = None) -> DataFrame:
    """Stream of the lines of each file that appears in a folder or pattern: ``value``, ``file`` and ``file_time``.

    Each file is read once; a second start from the same checkpoint reads only what is new. With
    ``archive`` finished files move there while later batches run, so that the folder stays short.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lineage = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_time")
    return reader.text(folder).select("value", *lineage)


def stream_table(
    spark: SparkSession, path: str, schema: StructType, max_files: int = 1000
) -> DataFrame:
    """Stream over a parquet table, be it one file or a folder of files.

    A pattern that only the path itself matches makes Spark resolve either, and leaves alone
    what else begins with that path; ``max_files`` bounds each micro-batch.
    """
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(f"{head}[{last}]")
    )


def kafka_values(
    spark: SparkSession,
    servers: str,
    topics: str,
    starting: str = "latest",
    max_offsets: int | None = None,
) -> DataFrame:
    """Topic values as text with the broker time. Offsets live in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "timestamp",
    )
