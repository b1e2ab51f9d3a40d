"""Small call fixtures shaped like the shipped 40-line sample.

Our own values: 40 consecutive vote ids, one phone calling at offsets 0, 1,
3, 4, 7, 9 and 19, every other offset a distinct phone (34 phones), one call
for an invalid contestant (999) at offset 6, timestamp 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

HOT_OFFSETS = (0, 1, 3, 4, 7, 9, 19)
HOT_PHONE = 5550001000
FIRST_VOTE = 20000000

CALL_DDL = ("vote_id bigint, phone_number bigint, contestant_number int, "
            "timestamp int, batch_id bigint")


def sample_calls(lines_per_batch=10):
    calls = []
    for i in range(40):
        phone = HOT_PHONE if i in HOT_OFFSETS else 5550002000 + i
        contestant = 999 if i == 6 else 1 + (i * 7 + i // 3) % 6
        calls.append({"vote_id": FIRST_VOTE + i, "phone_number": phone,
                      "contestant_number": contestant, "timestamp": 0,
                      "batch_id": i // lines_per_batch})
    return calls


def sample_lines():
    return [f"{c['vote_id']} {c['phone_number']} {c['contestant_number']} {c['timestamp']}"
            for c in sample_calls()]


def to_df(spark, calls):
    """Calls as a DataFrame with an arrival time ``ts`` (batch start + offset
    in microseconds, so arrival order is batch then vote id)."""
    df = spark.createDataFrame([tuple(c[k] for k in ("vote_id", "phone_number",
                                                     "contestant_number", "timestamp",
                                                     "batch_id")) for c in calls], CALL_DDL)
    return df.withColumn(
        "ts", F.timestamp_micros(F.col("batch_id") * 1_000_000 + (F.col("vote_id") % 1_000_000)))
