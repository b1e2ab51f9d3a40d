"""Contestant totals, the leaderboard and sliding-window counts of accepted calls."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.time import epoch_micros, ltz_from_micros, ntz_from_micros
from tallyline.operators.cumulative import block_of, explode_range, next_in_order, running_total
from tallyline.operators.quota import check_group_limit
from tallyline.session import materialize

CONTESTANT = "contestant_number"


def contestant_totals(accepted: DataFrame) -> DataFrame:
    """(contestant_number, total): all-time accepted calls per contestant.

    A partial count runs in every map task, so a popular contestant costs one
    row per task in the shuffle.
    """
    return accepted.groupBy(CONTESTANT).agg(F.count(F.lit(1)).alias("total"))


def leaderboard(accepted: DataFrame, top: int | None = 10) -> DataFrame:
    """Totals by descending count, ties by contestant number; first ``top``.

    With a limit Spark plans ``TakeOrderedAndProject``: each task keeps its own
    top rows, so no global sort of the totals happens.
    """
    board = contestant_totals(accepted).orderBy(F.desc("total"), F.asc(CONTESTANT))
    return board.limit(top) if top else board


def totals_by_batch(accepted: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(contestant_number, batch_id, total): a contestant's running total after
    every batch in which it gained votes (change-only form of the re-emitted
    totals).

    Calls are first counted per (contestant, batch), so the running sum sees
    one row per batch, not one per call; it is split into blocks of batches,
    so a contestant voted for in every batch is not one task's work.
    """
    per_batch = accepted.groupBy(CONTESTANT, batch).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(per_batch, [CONTESTANT], batch, "_n", "total") \
        .select(CONTESTANT, batch, "total")


def leaderboard_history(accepted: DataFrame, top: int = 10,
                        batch: str = "batch_id") -> DataFrame:
    """(batch_id, rank, contestant_number, total): the top ``top`` of the running
    totals after every batch, as a board re-emitting every contestant seen so
    far would show each batch (ties by contestant number).

    Each contestant's change points (one row per batch with new votes) are
    carried forward to the batch before its next change, or to the last batch
    with accepted calls; the output is at most one row per batch and
    contestant. Finding the next change and expanding the spans are both
    split into blocks, so a contestant with a long history, or one span
    covering most batches, is not one task's work. The per-batch top is a
    ``row_number() <= top`` limit that Catalyst trims before the shuffle.
    """
    check_group_limit(accepted, top)
    # small (one row per contestant and batch with votes) and read three times
    # below: written once, so the acceptance over the whole input runs once
    changes = materialize(totals_by_batch(accepted, batch), "contestant_totals")
    last = changes.select(F.max(batch)).scalar()
    spans = next_in_order(changes, [CONTESTANT], batch, "_next")
    filled = explode_range(spans, F.col(batch), F.coalesce(F.col("_next") - F.lit(1), last),
                           batch, [CONTESTANT, "total"])
    by_batch = Window.partitionBy(batch).orderBy(F.desc("total"), F.asc(CONTESTANT))
    return (filled.withColumn("rank", F.row_number().over(by_batch))
            .where(F.col("rank") <= top)
            .select(batch, "rank", CONTESTANT, "total"))


def sliding_window_counts(accepted: DataFrame, time_col: str, size_seconds: int,
                          slide_seconds: int, keys: tuple[str, ...] = (CONTESTANT,),
                          start_seconds: int = 0) -> DataFrame:
    """(window_start, window_end, *keys, n) over windows ``[s, s + size)`` with
    ``s`` on the slide grid (``start_seconds`` offset), as ``F.window`` does.

    Calls are counted per (pane, keys) first, a pane being a stretch of the greatest
    common divisor of size and slide, and only these counts are copied to the windows
    that hold the pane: the fan-out costs one row per pane and key rather than per
    call, for any size and slide. Window bounds keep the time column's type.
    """
    dtype = accepted.schema[time_col].dataType
    to_time = ntz_from_micros if isinstance(dtype, T.TimestampNTZType) else ltz_from_micros
    size, slide, start = (s * 1_000_000 for s in (size_seconds, slide_seconds, start_seconds))
    pane = gcd(size, slide)
    at = block_of(epoch_micros(accepted, time_col) - F.lit(start), pane)
    per_pane = (accepted.where(F.col(time_col).isNotNull()).select(at.alias("_pane"), *keys)
                .groupBy("_pane", *keys).agg(F.count(F.lit(1)).alias("_n")))
    # window k covers [k * slide, k * slide + size); with a slide over the size a pane may be in none
    begin = F.col("_pane") * F.lit(pane)
    spread = (per_pane
              .select(*keys, "_n", block_of(begin + F.lit(pane - size + slide - 1), slide).alias("_lo"),
                      block_of(begin, slide).alias("_hi")).where("_lo <= _hi")
              .select(*keys, "_n", F.explode(F.sequence("_lo", "_hi")).alias("_k")))
    counted = spread.groupBy("_k", *keys).agg(F.sum("_n").cast("bigint").alias("n"))
    first_us = F.col("_k") * F.lit(slide) + F.lit(start)
    return counted.select(
        to_time(first_us).alias("window_start"),
        to_time(first_us + F.lit(size)).alias("window_end"),
        *keys, "n")
