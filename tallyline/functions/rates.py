"""Throughput of a batch: records per second."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_per_second(n: Column, batch_ms: int) -> Column:
    """``n * 1000 / batch_ms`` as DOUBLE."""
    return (n * F.lit(1000)).cast("double") / F.lit(float(batch_ms))
