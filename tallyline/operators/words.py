"""Word count per batch of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import space_tokens


def word_counts(lines: DataFrame, line: str = "line", batch: str = "batch_id") -> DataFrame:
    """(batch_id, word, n): tokens of every line (single-space split, trailing
    empty tokens dropped), counted per batch.

    Partial counts are combined in each map task, so a frequent word reaches
    the shuffle once per task.
    """
    words = lines.select(batch, F.explode(space_tokens(F.col(line))).alias("word"))
    return words.groupBy(batch, "word").agg(F.count(F.lit(1)).alias("n"))
