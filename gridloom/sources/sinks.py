"""Writing report tables and keeping results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(summary: DataFrame, path: str) -> DataFrame:
    """A report table as one CSV file with a header, through Spark's writer; returns the table. Reports are a few rows."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return summary


def write_stack(long: DataFrame, path: str, partitions_by: str = "grid_id") -> None:
    """Long rows as Parquet, partitioned by grid and sorted by cell, so that later reads prune and arrays build cheaply."""
    long.sortWithinPartitions("cell", "t").write.mode("overwrite").partitionBy(partitions_by).parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    return df.persist()
