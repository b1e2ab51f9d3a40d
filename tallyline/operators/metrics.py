"""Per-batch throughput, its summary, and idle detection.

A metric series has one row per batch id, zero-filled, so that idle batches
(no input at all) are present with ``n = 0`` and ``rate = 0``: the summary
and the idle rule both depend on those zero samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.rates import rate_per_second
from tallyline.operators.cumulative import explode_range, next_in_order, running_total
from tallyline.session import materialize
from tallyline.functions.time import ntz_from_micros

BATCH = "batch_id"


#: Widest range of batch ids that is filled with zeros.
MOST_IDS = 1 << 30


def dense_ids(spark: SparkSession, source: DataFrame, column: str,
              block: int = 1 << 16, most: int = MOST_IDS) -> DataFrame:
    """Every integer from ``min(column)`` to ``max(column)`` of ``source``, as
    a distributed one-column DataFrame named ``column``.

    The bounds are scalar subqueries, so nothing is computed until the result
    is used. The range is cut into blocks of ``block`` ids that are spread
    over tasks before each is expanded, so no single task or the driver
    builds the whole range. A range of over ``most`` ids fails: one wrong timestamp
    makes such a range, and the sparse forms (:func:`idle_runs`,
    :func:`rate_summary`) need none.
    """
    lo = source.select(F.min(column)).scalar()
    hi = source.select(F.max(column)).scalar()
    hi = F.when(hi - lo < F.lit(most), hi).when(lo.isNotNull(), F.raise_error(F.concat(
        F.lit(f"over {most} ids between "), lo.cast("string"), F.lit(" and "), hi.cast("string"))).cast("bigint"))
    return explode_range(spark.range(1), lo, hi, column, [], block)


def sparse_counts(records: DataFrame, batch: str = BATCH) -> DataFrame:
    """(batch_id, n) of batches with records only, written once."""
    return materialize(records.groupBy(batch).agg(F.count(F.lit(1)).alias("n")), "batch_counts")


def batch_counts(spark: SparkSession, records: DataFrame, batch: str = BATCH) -> DataFrame:
    """(batch_id, n): records per batch, 0 for a batch with none, over every
    batch id between the first and the last one seen.

    The per-batch counts (one row per batch) are materialized once: the spine
    bounds, the zero-fill join and any later summary read them, not the
    records.
    """
    counts = sparse_counts(records, batch)
    spine = dense_ids(spark, counts, batch)
    return (spine.join(counts, batch, "left")
            .select(batch, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def batch_rates(counts: DataFrame, batch_seconds: int, origin_seconds: int = 0,
                batch: str = BATCH) -> DataFrame:
    """(batch_id, batch_start, n, rate): throughput ``n * 1000 / batch_ms``.

    ``batch_start`` is TIMESTAMP_NTZ in UTC wall-clock time.
    """
    start_us = (F.col(batch) * F.lit(batch_seconds) + F.lit(origin_seconds)) * F.lit(1_000_000)
    return counts.select(
        batch,
        ntz_from_micros(start_us).alias("batch_start"),
        "n",
        rate_per_second(F.col("n"), batch_seconds * 1000).alias("rate"),
    )


def numbered_samples(metrics: DataFrame, batch: str = BATCH) -> DataFrame:
    """``metrics`` with ``position``: the samples' number from 1 in order of ``batch``.

    Counted in blocks of batches, so no task holds the whole series."""
    return running_total(metrics.withColumn("_one", F.lit(1)), [], batch, "_one", "position").drop("_one")


def rate_summary(metrics: DataFrame, trailing: int = 4, batch: str = BATCH,
                 rate: str = "rate") -> DataFrame:
    """One row: n_batches, max_rate, min_rate, avg_rate, stddev_rate.

    The last ``trailing`` samples (by batch id; batches without a row are zero samples)
    are left out, then zero rates are dropped; the deviation uses the ``n - 1``
    divisor. With no samples left the count is 0 and the rest NULL.
    """
    last = metrics.select(F.max(batch)).scalar()
    kept = metrics.where(F.col(batch) <= last - F.lit(trailing)).where(F.col(rate) != 0)
    return kept.agg(
        F.count(rate).alias("n_batches"),
        F.max(rate).alias("max_rate"),
        F.min(rate).alias("min_rate"),
        F.avg(rate).alias("avg_rate"),
        F.stddev_samp(rate).alias("stddev_rate"),
    )


def idle_batches(metrics: DataFrame, run: int = 3, batch: str = BATCH,
                 rate: str = "rate") -> DataFrame:
    """(batch_id): batches at which the last ``run`` samples sum to zero, with
    more than ``run`` samples seen so far.

    Each sample is sent to the ``run`` batch ids whose look-back covers it
    and summed there: one aggregation with map-side combine instead of a
    window over the whole, unpartitioned series.
    """
    first = metrics.select(F.min(batch)).scalar()
    spread = (metrics
              .select(batch, rate, F.explode(F.sequence(F.lit(0), F.lit(run - 1))).alias("_o"))
              .select((F.col(batch) + F.col("_o")).alias("_at"), F.col(rate).alias("_rate")))
    ends = metrics.select(F.max(batch)).scalar()
    judged = spread.groupBy("_at").agg(F.sum("_rate").alias("_sum"),
                                       F.count(F.lit(1)).alias("_seen"))
    return (judged.where((F.col("_seen") == run) & (F.col("_sum") == 0)
                         & (F.col("_at") >= first + F.lit(run)) & (F.col("_at") <= ends))
            .select(F.col("_at").cast("bigint").alias(batch)))


def gap_runs(counts: DataFrame, batch: str = BATCH, n: str = "n") -> DataFrame:
    """(start, length): the maximal stretches of batch ids without records, between the
    first and the last id of ``counts``, whose rows may be missing or 0 for such batches.

    Found from neighbouring busy ids, in blocks, so the cost is that of the rows there
    are, however far apart their ids lie. NULL ids are left out.
    """
    known = counts.where(F.col(batch).isNotNull())
    ends = known.agg(F.min(batch).alias("lo"), F.max(batch).alias("hi"))
    busy = known.where(F.col(n) != 0).select(F.col(batch).cast("bigint").alias("at"))
    # the ids just outside stand for the edges of the series
    edges = ends.where("lo is not null").select(F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("at"))
    marks = next_in_order(busy.unionByName(edges), [], "at", "next")
    return marks.where(F.col("next") - F.col("at") > 1).select(
        (F.col("at") + 1).alias("start"), (F.col("next") - F.col("at") - 1).alias("length"))


def idle_runs(counts: DataFrame, run: int = 3, batch: str = BATCH, n: str = "n") -> DataFrame:
    """(first, last): the stretches of batch ids at which the last ``run`` samples are
    zero, with more than ``run`` samples seen; one row per idle stretch."""
    lo = counts.select(F.min(batch)).scalar()
    first = F.greatest(F.col("start") + F.lit(run - 1), lo + F.lit(run))
    last = F.col("start") + F.col("length") - 1
    return (gap_runs(counts, batch, n).select(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))
            .where(F.col("first") <= F.col("last")))


def idle_ids(counts: DataFrame, run: int = 3, batch: str = BATCH, n: str = "n") -> DataFrame:
    """(batch_id): as :func:`idle_batches`, from counts without zero rows."""
    return explode_range(idle_runs(counts, run, batch, n), F.col("first"), F.col("last"), batch, [])


#: Columns of a rate summary.
SUMMARY_COLUMNS = ("n_batches", "max_rate", "min_rate", "avg_rate", "stddev_rate")

# Fixed value: the printed summary format of the source system (count as a
# two-wide integer, doubles in Java's shortest round-trip form).
SUMMARY_FORMAT = "effective batch number:%2d max: %s min: %s average: %s stddev: %s "


def summary_line(stats: DataFrame) -> DataFrame:
    """(line): the summary row of :func:`rate_summary` as one printed line."""
    return stats.select(F.format_string(
        SUMMARY_FORMAT, F.col("n_batches"),
        *[F.col(c).cast("string") for c in ("max_rate", "min_rate", "avg_rate", "stddev_rate")],
    ).alias("line"))


def rate_summary_when_idle(metrics: DataFrame, trailing: int = 4, run: int = 3,
                           batch: str = BATCH, rate: str = "rate") -> DataFrame:
    """:func:`rate_summary`, but only once the series has gone idle: more than
    ``run`` samples and the last ``run`` all zero. Otherwise no row, as a
    summariser polling the metric table reports nothing yet."""
    last = metrics.select(F.max(batch)).scalar()
    idle_now = idle_batches(metrics, run, batch, rate).select(
        (F.max(batch) == last).alias("_idle")).scalar()
    return rate_summary(metrics, trailing, batch, rate).where(F.coalesce(idle_now, F.lit(False)))
