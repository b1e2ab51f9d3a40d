"""Connected components of a large edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import materialize


def _facts(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    moved = both.where("v > u").join(low, "u")
    return moved.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them (``v < u``
    in every input row)."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (BIGINT columns ``u``, ``v``),
    where ``root`` is the smallest node that can be reached.

    Every round is two grouped minima and a join on the same key; no node's
    neighbours are gathered in one place, and each round's edges are written to
    the shared folder, which cuts the lineage. Rounds grow with the logarithm of
    the longest path.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                                   F.least("u", "v").alias("v")).distinct(), "edges")
    facts = _facts(now)
    for _ in range(max_rounds):
        if not facts[0]:
            break
        now = materialize(_small_star(_large_star(now)), "stars")
        before, facts = facts, _facts(now)
        if facts == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
