"""Per-phone call quotas and the contestant check.

Two acceptance rules exist and give different answers:

* **batch quota** (variant A): a phone's running call count is updated with
  the whole micro-batch first, and every call of the phone in that batch is
  accepted only if the count *after* the batch is at most ``max_votes``. Two
  calls of a fresh phone in one batch with ``max_votes=1`` are both rejected.
  Calls for invalid contestants still count against the quota.
* **arrival quota** (variant B): the first ``max_votes`` calls of a phone in
  arrival order are accepted; the contestant check runs afterwards, so a call
  for an invalid contestant also spends quota.

Both work on the batch form of a call stream: rows with ``phone_number``,
``batch_id`` and an arrival order (``ts``, ``vote_id``). The streaming forms
are in :mod:`tallyline.streaming.processors`.

Skew: one phone may place a large share of all calls. Nothing here sends a
phone's raw calls to one task. Both acceptance rules rank a phone's calls
and keep the first ``max_votes`` (+1): Catalyst plans this as a
``WindowGroupLimit`` that trims each map task's rows per phone before the
shuffle. Quotas above ``RANKED_QUOTA`` are cut off by counts instead
(:mod:`tallyline.operators.cutoff`). Running counts
first compact calls to one row per (phone, batch) with a map-side partial
count, then sum them in blocks of batches.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.cumulative import null_safe_join, running_total
from tallyline.operators.cutoff import first_calls_by_count, phones_within

PHONE = "phone_number"
BATCH = "batch_id"
#: Quotas above this are cut off by counts (:mod:`tallyline.operators.cutoff`) instead of
#: ranks; both give the same calls. Ranking leaves up to the quota times the map tasks in one task.
RANKED_QUOTA = 128


def check_group_limit(df: DataFrame, limit: int) -> None:
    """Raise if Spark would not plan ``row_number() <= limit`` as a
    ``WindowGroupLimit``, which keeps a hot phone's calls out of one task.

    Spark does so up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    (1000 unless set; :func:`tallyline.build_session` sets more). The limit
    streams over sorted input with one counter per group, so a higher
    threshold costs no memory. With -1 (switched off) there is a warning.
    """
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    current = int(df.sparkSession.conf.get(key, "1000"))
    if current == -1:
        warnings.warn(f"{key} is -1: calls of one phone are not limited before the shuffle", stacklevel=3)
    elif current < limit:
        raise ValueError(f"a quota of {limit} needs {key} of at least as much; it is {current}")


def valid_contestant(calls: DataFrame, num_contestants: int) -> DataFrame:
    """Drop calls for contestant numbers above ``num_contestants``.

    Only the upper bound is checked: 0 and negative numbers pass.
    """
    return calls.where(F.col("contestant_number") <= F.lit(num_contestants))


def phone_batch_counts(calls: DataFrame) -> DataFrame:
    """(phone_number, batch_id, calls): calls per phone per batch."""
    return calls.groupBy(PHONE, BATCH).agg(F.count(F.lit(1)).alias("calls"))


def running_phone_counts(calls: DataFrame) -> DataFrame:
    """(phone_number, batch_id, n): a phone's call count up to and including
    each batch in which it called.

    The running sum runs over the compacted (phone, batch) rows, one per
    batch rather than per call, and is split into blocks of batches so a
    phone calling in every batch is spread over several tasks.
    """
    return running_total(phone_batch_counts(calls), [PHONE], BATCH, "calls", "n") \
        .select(PHONE, BATCH, "n")


def running_call_counts(calls: DataFrame) -> DataFrame:
    """(vote_id, batch_id, n): for every call, its phone's running count after
    the call's batch (same-batch calls share one value)."""
    counts = running_phone_counts(calls)
    return (null_safe_join(calls.select("vote_id", PHONE, BATCH), counts, [PHONE, BATCH])
            .select("vote_id", BATCH, "n"))


def allowed_phone_batches(calls: DataFrame, max_votes: int) -> DataFrame:
    """(phone_number, batch_id, n) with running count ``n <= max_votes``.

    Every batch adds at least one call, so only a phone's first
    ``max_votes`` batches can qualify; ranking them first lets Catalyst plan
    a ``WindowGroupLimit`` that trims each map task's rows per phone before
    the shuffle. Above ``RANKED_QUOTA`` the running counts decide without ranks.
    """
    if max_votes > RANKED_QUOTA:
        return phones_within(calls, max_votes, PHONE, BATCH)
    check_group_limit(calls, max_votes)
    order = Window.partitionBy(PHONE).orderBy(BATCH)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = phone_batch_counts(calls).select(
        PHONE, BATCH,
        F.row_number().over(order).alias("_rank"),
        F.sum("calls").over(upto).cast("bigint").alias("n"),
    )
    return (ranked.where((F.col("_rank") <= max_votes) & (F.col("n") <= max_votes))
            .select(PHONE, BATCH, "n"))


def batch_quota_join(calls: DataFrame, max_votes: int, num_contestants: int) -> DataFrame:
    """Variant A acceptance as a join: valid-contestant calls whose phone is
    allowed in their batch (left-semi join on phone and batch).

    The allowed side has at most ``max_votes`` rows per phone. Spark
    broadcasts it only when its size (estimated from the scan, or measured by
    AQE at runtime) is under the broadcast threshold; otherwise AQE splits a
    skewed phone's partition of the call side.
    """
    allowed = allowed_phone_batches(calls, max_votes).select(PHONE, BATCH)
    return null_safe_join(valid_contestant(calls, num_contestants), allowed, [PHONE, BATCH], "left_semi")


def batch_quota(calls: DataFrame, max_votes: int, num_contestants: int,
                tie_break: str = "vote_id") -> DataFrame:
    """Variant A acceptance in one pass over the calls, no join.

    Take each phone's first ``max_votes + 1`` calls in (batch, ``tie_break``)
    order. A call in batch ``b`` among them is accepted exactly when at most
    ``max_votes`` of them lie in batches ``<= b``: if the phone's running
    count after ``b`` is within the quota, all its calls up to ``b`` are among
    the first ones and are counted; if not, all ``max_votes + 1`` first calls
    lie in batches ``<= b``. Calls outside the first ones always exceed the
    quota. The limit is planned as a ``WindowGroupLimit`` before the shuffle,
    so at most ``max_votes + 1`` calls per phone leave each map task, and
    the running count reuses the same partitioning and sort. Above ``RANKED_QUOTA``
    whole batches are accepted by their counts (:func:`batch_quota_join`).
    """
    if max_votes > RANKED_QUOTA:
        return batch_quota_join(calls, max_votes, num_contestants)
    check_group_limit(calls, max_votes + 1)
    order = Window.partitionBy(PHONE).orderBy(BATCH, tie_break)
    through_batch = (Window.partitionBy(PHONE).orderBy(BATCH)
                     .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first = (calls.withColumn("_rank", F.row_number().over(order))
             .where(F.col("_rank") <= max_votes + 1).drop("_rank"))
    counted = first.withColumn("_n", F.count(F.lit(1)).over(through_batch))
    return valid_contestant(counted.where(F.col("_n") <= max_votes).drop("_n"), num_contestants)


def first_calls(calls: DataFrame, max_votes: int,
                order: tuple[str, ...] = ("ts", "vote_id")) -> DataFrame:
    """The first ``max_votes`` calls of every phone in arrival ``order``.

    Above ``RANKED_QUOTA``, calls with a batch are cut off by counts, in the order
    (batch, *``order``), which is the same where batches follow the time.
    """
    if max_votes > RANKED_QUOTA and BATCH in calls.columns:
        return first_calls_by_count(calls, max_votes, PHONE, BATCH, order)
    check_group_limit(calls, max_votes)
    w = Window.partitionBy(PHONE).orderBy(*order)
    return (calls.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= max_votes)
            .drop("_rank"))


def arrival_quota(calls: DataFrame, max_votes: int, num_contestants: int,
                  order: tuple[str, ...] = ("ts", "vote_id")) -> DataFrame:
    """Variant B acceptance: quota first, then the contestant check.

    The order matters: filtering contestants first would let a phone's
    invalid call stop spending quota. Catalyst does not push this filter
    below the window, as contestant is not the window's partition key.
    """
    return valid_contestant(first_calls(calls, max_votes, order), num_contestants)
