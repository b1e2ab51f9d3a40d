"""Text sources for the word count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import split_lines


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, one row per line (``value STRING``)."""
    return spark.read.text(path)


def document_lines(documents: DataFrame, text: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line of each document (``line STRING`` plus ``keep``).

    The whole text is split, so a document's words never run across a line
    break, as when the text is read from a line-oriented stream.
    """
    return documents.select(*keep, F.explode(split_lines(F.col(text))).alias("line"))
