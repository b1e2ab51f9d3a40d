"""The first N calls of every phone by histograms, for large quotas.

Ranking all calls of a phone keeps N rows per phone and map task, which all meet in one
task: at N = 1000 and 200,000 map tasks, 200 million. Here nothing is ranked that a count
can decide:

1. Calls are counted per (phone, batch), and the counts summed along the batches
   (:func:`~tallyline.operators.cumulative.running_total`, in blocks). A batch that ends
   within the quota is accepted whole, one that begins beyond it is rejected whole. At
   most one batch per phone is left, in which the quota runs out.
2. Only that batch's calls go on. They are counted per ``BINS`` equal stretches of the
   batch's own time range, and the counts decide the same way, so one stretch per phone is left.
3. Its calls are ranked in two steps: within ``SALTS`` parts of the stretch first, so that calls
   with one and the same time are ranked by several tasks, then over what is left.

Calls meet the counts in joins on (phone, batch): a phone's calls are dealt by batch, and
one batch that is large by itself is split as a skewed join partition by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.time import epoch_micros
from tallyline.operators.cumulative import null_safe_join, running_total

BINS = 256
SALTS = 16


def count_cutoffs(counts: DataFrame, keys: list[str], step: str, room: Column) -> DataFrame:
    """(keys, step, _room, _whole): the steps of each key that begin within its
    quota, the calls still accepted in the step, and whether these are all of it.

    ``counts`` has ``calls`` per (keys, step); ``room`` is the key's quota, a
    literal or a column that is the same in all rows of a key.
    """
    totals = running_total(counts, keys, step, "calls", "_n")
    left = room - (F.col("_n") - F.col("calls"))
    return (totals.withColumn("_left", left).where("_left > 0")
            .select(*keys, step, F.col("_left").alias("_room"), (F.col("calls") <= F.col("_left")).alias("_whole")))


def phones_within(calls: DataFrame, max_votes: int, phone: str, batch: str) -> DataFrame:
    """(phone, batch, n): the batches after which a phone's running count is within the quota."""
    counts = calls.groupBy(phone, batch).agg(F.count(F.lit(1)).alias("calls"))
    return running_total(counts, [phone], batch, "calls", "n").where(F.col("n") <= max_votes).select(phone, batch, "n")


def first_calls_by_count(calls: DataFrame, max_votes: int, phone: str, batch: str,
                         order: tuple[str, ...] = ("ts", "vote_id"), bins: int = BINS, salts: int = SALTS) -> DataFrame:
    """The first ``max_votes`` calls of every phone by (``batch``, *order), NULL first.

    ``order`` starts with the time column; NULL phones are one phone.
    """
    keys = [phone, batch]
    counts = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"))
    cut = count_cutoffs(counts, [phone], batch, F.lit(max_votes).cast("bigint"))
    met = null_safe_join(calls, cut, keys)
    whole = met.where("_whole").drop("_room", "_whole")
    # the batch in which a phone's quota runs out: one per phone
    split = met.where("not _whole").drop("_whole")

    time = epoch_micros(split, order[0])
    ranges = split.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    placed = null_safe_join(split, ranges, keys)
    at = F.call_function("div", (epoch_micros(placed, order[0]) - F.col("_lo")) * F.lit(bins),
                         F.col("_hi") - F.col("_lo") + F.lit(1))
    placed = placed.withColumn("_bin", F.coalesce(at, F.lit(-1))).drop("_lo", "_hi")
    fine = placed.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("calls"), F.max("_room").alias("_all"))
    fine_cut = count_cutoffs(fine, keys, "_bin", F.col("_all"))
    found = null_safe_join(placed.drop("_room"), fine_cut, [*keys, "_bin"])
    early = found.where("_whole").drop("_room", "_whole", "_bin")

    ranked = found.where("not _whole").drop("_whole").withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for part in ([*keys, "_bin", "_salt"], [*keys, "_bin"]):
        first = Window.partitionBy(*part).orderBy(*order)
        # the literal bound lets Spark limit each map task's rows before the shuffle
        ranked = (ranked.withColumn("_rank", F.row_number().over(first))
                  .where((F.col("_rank") <= max_votes) & (F.col("_rank") <= F.col("_room"))).drop("_rank"))
    return whole.unionByName(early).unionByName(ranked.drop("_room", "_bin", "_salt"))
