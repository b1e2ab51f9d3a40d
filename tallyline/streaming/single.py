"""Acceptance for a quota of one call per phone, without Python workers.

One streaming aggregate per phone holds all that the rules need. It runs in update
mode, so a micro-batch emits the phones that called in it, and the partial aggregate of
every map task leaves one row per phone, however many calls a phone places:

* **batch rule**: the number of calls so far. A phone whose count is 1 after a batch has
  placed its only call in it; that call is accepted.
* **arrival rule**: the first call by (arrival, ``order``), arrival being the trigger time
  of the micro-batch, which all of its calls share and which a replayed batch keeps. The
  phone's first call is accepted in the batch whose trigger time it carries. The latest
  arrival is held as well, so a clock that was set back never accepts a phone twice: all
  of its calls must have arrived now.

Both agree with the keyed-state processors at ``max_votes=1`` (a NULL in ``order`` comes
first, calls without a phone are one phone's). State never expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.quota import PHONE, valid_contestant

#: Output mode in which the stream must be written.
MODE = "update"


def accept_single_calls(calls: DataFrame, variant: str, num_contestants: int,
                        order: tuple[str, ...] = ("ts", "vote_id")) -> DataFrame:
    """The accepted calls of a call stream under a quota of one, to be written in update mode."""
    if variant not in ("batch", "arrival"):
        raise ValueError(f"unknown quota variant {variant!r}")
    rest = [c for c in calls.columns if c not in (PHONE, *order)]
    now = F.current_timestamp()
    state = (calls.withColumn("_arrival", now).groupBy(PHONE)
             .agg(F.count(F.lit(1)).alias("_calls"), F.max("_arrival").alias("_last"),
                  F.min(F.struct("_arrival", *order, *rest)).alias("_first")))
    if variant == "batch":
        accepted = state.where(F.col("_calls") == 1)
    else:
        accepted = state.where((F.col("_first._arrival") == now) & (F.col("_last") == now))
    fields = [F.col(PHONE) if c == PHONE else F.col(f"_first.{c}").alias(c) for c in calls.columns]
    return valid_contestant(accepted.select(*fields), num_contestants)
