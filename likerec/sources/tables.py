"""Reading and appending the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likerec.schema import REQUESTS, TABLES


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table stored as parquet under ``folder/name``; the schema is given, never inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Users, songs and likes as lazy scans."""
    return {name: load_table(spark, folder, name) for name in TABLES}


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a stored table. Spark commits the files of one write together."""
    df.write.mode("append").parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Stored requests, one JSON object per line."""
    return spark.read.schema(REQUESTS).json(path)


def stream_requests(spark: SparkSession, path: str, max_files_per_batch: int = 1000) -> DataFrame:
    """Requests as they arrive in a folder, one JSON object per line."""
    return (
        spark.readStream.schema(REQUESTS)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .json(path)
    )
