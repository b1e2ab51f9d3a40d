"""Proportional stratified interleaving of rows into shards.

The rows of every source are put into a seeded random order; row r of n gets the
fractional rank (2 r - 1) / (2 n). Sorted by fractional rank, the sources are
spread evenly over the whole order, so a cut into stretches of equal length gives
shards that each hold the sources in the proportions of the whole table, with row
counts at most one apart. With ``phased`` it gets (r - 1 + u) / n instead, where u
from 0 to 1 is a seeded hash of the source: sources of few rows, which else all
meet at 1/2, or at 1/4 and 3/4, are then spread over all buckets and shards.

No source and no stretch is ordered in one task. Both orders are made of buckets:
a random order falls evenly into buckets of the hash, a fractional order into
buckets of the rank. Counts per bucket are summed up to the buckets before it, and
only rows of one bucket are ranked together, about ``bucket_rows`` of them.

Defined results: NULL is a source of its own. Repeated rows are rows of their own;
rows that agree in every selected column are interchangeable and share a bucket.
An empty table gives an empty result. With fewer rows than shards some shards are
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import materialize

SEED = 20_240_601
BUCKET_ROWS = 4096


def _prefix(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``before``: rows in the buckets before, ``whole``: rows of all buckets of ``keys``."""
    over = Window.partitionBy(*keys)
    earlier = over.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
            .withColumn("whole", F.sum("rows").over(over)).drop("rows"))


def interleave(df: DataFrame, id_col: str, stratum_col: str, shards: int, seed: int = SEED,
               bucket_rows: int = BUCKET_ROWS, phased: bool = False) -> DataFrame:
    """``df`` plus ``shard`` INT (from 0) and ``slot`` BIGINT (gapless from 0 in
    each shard). ``df`` should hold ids, sources and small columns, not texts."""
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # a struct keeps the caller's columns apart from those made here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    stratum, ident = F.col(f"row.`{stratum_col}`"), F.col(f"row.`{id_col}`")
    rows = materialize(rows.select("row", stratum.cast("string").alias("stratum"),
                                   F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident, "row"), 1).alias("mix")), "shard-rows")
    total = rows.count()
    buckets = max(1, total // bucket_rows)
    place = F.floor(F.shiftright("mix", 10) / F.lit(float(1 << 53)) * buckets).cast("bigint")
    rows = rows.withColumn("bucket", place)
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = _prefix(counts, ["stratum"], ["bucket"])
    tie: list[Column] = [F.col("mix"), F.xxhash64("row")]
    ranked = rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("stratum", "bucket").orderBy(*tie)))
    same = ranked["stratum"].eqNullSafe(offsets["stratum"]) & (ranked["bucket"] == offsets["bucket"])
    earlier = F.col("before") + F.col("rank") - 1
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), ranked["stratum"]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    fraction = (earlier + phase) / F.col("whole") if phased else (2 * earlier + 1) / (2 * F.col("whole"))
    spread = materialize(ranked.join(offsets, same).select(
        "row", "mix", ranked["stratum"].alias("stratum"), fraction.alias("fraction")), "shard-ranks")

    spread = spread.withColumn("bucket", F.least(
        F.floor(F.col("fraction") * buckets).cast("bigint"), F.lit(buckets - 1)))
    # one row per bucket in one task: rows / bucket_rows of them
    starts = _prefix(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), [], ["bucket"])
    order = Window.partitionBy("bucket").orderBy(
        "fraction", F.xxhash64(F.lit(seed), "stratum"), F.col("stratum").asc_nulls_first(), *tie)
    placed = spread.withColumn("rank", F.row_number().over(order)).join(starts, "bucket")
    at = F.col("before") + F.col("rank") - 1
    shard = F.expr(f"(before + rank - 1) * {shards} div whole")
    first = F.expr(f"(shard * whole + {shards - 1}) div {shards}")
    return (placed.withColumn("at", at).withColumn("shard", shard)
            .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot")))
