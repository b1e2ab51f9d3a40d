"""Call records: from text lines, or as a view over an ``events`` table.

Call schema: ``vote_id BIGINT, phone_number BIGINT, contestant_number INT,
timestamp INT``. The batch forms add ``ts`` (arrival time) and ``batch_id``
(``floor((ts - origin) / batch_seconds)``), which stand for the micro-batch a
call arrived in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.calls import CALL_FIELDS, parse_call_line, render_call
from tallyline.functions.time import bucket_index, epoch_micros

CALL_SCHEMA = T.StructType([
    T.StructField("vote_id", T.LongType()),
    T.StructField("phone_number", T.LongType()),
    T.StructField("contestant_number", T.IntegerType()),
    T.StructField("timestamp", T.IntegerType()),
])


@dataclass(frozen=True)
class CallViewSpec:
    """How an ``events`` row becomes a call.

    Fixed values of the call view over ``events``: batches are counted from
    2024-01-01 00:00:00 UTC (epoch second 1704067200); the contestant is
    ``1 + k % 8`` with ``k`` the integer at JSON path ``$.k`` of ``props``,
    so contestants 7 and 8 are invalid against six contestants.
    """

    origin_seconds: int = 1704067200
    batch_seconds: int = 3600
    contestant_modulus: int = 8
    json_path: str = "$.k"


def call_view(events: DataFrame, spec: CallViewSpec = CallViewSpec()) -> DataFrame:
    """Calls from events: ``vote_id=event_id``, ``phone_number=user_id``.

    Columns: vote_id, phone_number, contestant_number, timestamp (epoch
    seconds, INT), ts (as in the source), batch_id.
    """
    micros = epoch_micros(events, "ts")
    k = F.get_json_object("props", spec.json_path).cast("int")
    return events.select(
        F.col("event_id").cast("bigint").alias("vote_id"),
        F.col("user_id").cast("bigint").alias("phone_number"),
        (F.lit(1) + k % spec.contestant_modulus).cast("int").alias("contestant_number"),
        F.floor(micros / F.lit(1_000_000)).cast("int").alias("timestamp"),
        F.col("ts"),
        bucket_index(micros, spec.origin_seconds, spec.batch_seconds).alias("batch_id"),
    )


def call_lines(calls: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Render calls as text lines ``value`` (plus any ``keep`` columns)."""
    return calls.select(
        *keep,
        render_call(F.col("vote_id"), F.col("phone_number"), F.col("contestant_number"),
                    F.col("timestamp")).alias("value"),
    )


def parse_calls(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Strict parse: a malformed line fails the job, as in the source system."""
    parsed = parse_call_line(F.col(value), strict=True).alias("_call")
    return lines.select(*keep, parsed).select(*keep, *[f"_call.{n}" for n, _ in CALL_FIELDS])


def parse_calls_lenient(lines: DataFrame, value: str = "value",
                        keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Lenient parse: ``(calls, rejects)``; rejects keep the raw line."""
    tagged = lines.select(*keep, F.col(value).alias("_raw"),
                          parse_call_line(F.col(value), strict=False).alias("_call"))
    calls = tagged.where(F.col("_call").isNotNull()) \
        .select(*keep, *[f"_call.{n}" for n, _ in CALL_FIELDS])
    rejects = tagged.where(F.col("_call").isNull()).select(*keep, F.col("_raw").alias(value))
    return calls, rejects


def read_call_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files of call lines, one record per line (``value STRING``)."""
    return spark.read.text(path)
