"""Running totals per key along an integer axis (batch ids), split so that a
key with a very long history is not one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(value: Column, block: int) -> Column:
    """``floor(value / block)`` of whole numbers, exact for any BIGINT."""
    value = value.cast("bigint")
    return F.call_function("div", value - F.pmod(value, F.lit(block)), F.lit(block))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL, keeping the left side's keys."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                  block: int = 1 << 14) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` with
    ``order`` up to and including this row's (rows unique per keys and order;
    a NULL ``order`` comes first; NULL keys are a key of their own).

    The axis is cut into blocks of ``block`` values. Sums within a block run
    in windows partitioned by (keys, block); the totals of earlier blocks
    come from a window over one row per (keys, block). So a key present in
    every batch is spread over its blocks instead of landing in one task. The
    per-block prefix table is small and joins back on (keys, block).
    """
    # never NULL, so the join below infers no extra filter on it and both of
    # its inputs stay the same plan (Spark then computes ``df`` once)
    blk = F.coalesce(block_of(F.col(order), block), F.lit(-(1 << 62))).alias("_blk")
    rows = df.select("*", blk)
    within = (Window.partitionBy(*keys, "_blk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    partial = rows.withColumn("_within", F.sum(value).over(within))
    earlier = (Window.partitionBy(*keys).orderBy("_blk")
               .rowsBetween(Window.unboundedPreceding, -1))
    prefix = (rows.groupBy(*keys, "_blk").agg(F.sum(value).alias("_blk_total"))
              .select(*keys, "_blk",
                      F.coalesce(F.sum("_blk_total").over(earlier), F.lit(0)).alias("_before")))
    return (null_safe_join(partial, prefix, [*keys, "_blk"])
            .withColumn(out, (F.col("_before") + F.col("_within")).cast("bigint"))
            .drop("_blk", "_within", "_before"))


def next_in_order(df: DataFrame, keys: list[str], order: str, out: str,
                  block: int = 1 << 14) -> DataFrame:
    """Add ``out`` = the next ``order`` value among rows of the same ``keys``
    (NULL for the last one); ``order`` is unique per key and never NULL.

    Blocked like :func:`running_total`: ``lead`` runs within (keys, block),
    and a row that is last in its block takes the first value of the key's
    next non-empty block, from a window over one row per (keys, block).
    """
    blk = F.coalesce(block_of(F.col(order), block), F.lit(0)).alias("_blk")
    rows = df.select("*", blk)
    within = Window.partitionBy(*keys, "_blk").orderBy(order)
    led = rows.withColumn("_next_in_blk", F.lead(order).over(within))
    later = Window.partitionBy(*keys).orderBy("_blk")
    firsts = (rows.groupBy(*keys, "_blk").agg(F.min(order).alias("_first"))
              .select(*keys, "_blk", F.lead("_first").over(later).alias("_next_blk_first")))
    return (null_safe_join(led, firsts, [*keys, "_blk"])
            .withColumn(out, F.coalesce("_next_in_blk", "_next_blk_first"))
            .drop("_blk", "_next_in_blk", "_next_blk_first"))


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str, keep: list[str],
                  chunk: int = 1 << 16) -> DataFrame:
    """One row per integer ``out`` in ``[lo, hi]`` for every row of ``df``
    (``keep`` columns carried along).

    A range is first cut into chunks of ``chunk`` values and the chunks are
    spread over tasks before they are expanded, so one long range does not
    make one task produce all of its rows.
    """
    first, last = block_of(lo, chunk), block_of(hi, chunk)
    chunks = (df.select(*keep, lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"),
                        F.explode(F.sequence(first, last)).alias("_chunk"))
              .repartition("_chunk", *keep))
    start = F.greatest(F.col("_chunk") * F.lit(chunk), F.col("_lo"))
    end = F.least(F.col("_chunk") * F.lit(chunk) + F.lit(chunk - 1), F.col("_hi"))
    return chunks.select(*keep, F.explode(F.sequence(start, end)).alias(out))
