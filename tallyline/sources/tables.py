"""Parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt evenly to ``partitions`` tasks, for heavy per-row work on a
    table that Spark cannot split (few, large row groups); None leaves it alone."""
    return df.repartition(partitions) if partitions else df
