"""The accepted-vote key/value store as a table.

The store is upsert-only with last write wins and no expiry. As a table it
is an append log of (key, value, write order); the current store is the
latest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.calls import render_call


def kv_rows(accepted: DataFrame, key: str = "vote_id",
            order: tuple[str, ...] = ("ts", "vote_id")) -> DataFrame:
    """(key, value, *order): one store write per accepted call; ``value`` is the
    space-joined record, ``key`` the string form of column ``key``."""
    value = render_call(F.col("vote_id"), F.col("phone_number"), F.col("contestant_number"),
                        F.col("timestamp"))
    extra = [c for c in order if c != "key"]
    return accepted.select(F.col(key).cast("string").alias("key"), value.alias("value"), *extra)


def latest_per_key(writes: DataFrame, order: tuple[str, ...] = ("ts", "vote_id")) -> DataFrame:
    """(key, value): the last write of every key by ``order``; of writes that
    agree in all of ``order`` the largest value wins. Put an arrival position
    into ``order`` where one is known.

    ``max_by`` over a struct of the order columns is an aggregate with a
    map-side partial step, so a key written very often still reaches the
    shuffle as one row per map task.
    """
    return writes.groupBy("key").agg(
        F.max_by("value", F.struct(*[F.col(c) for c in order], F.col("value").alias("_value"))).alias("value"))
