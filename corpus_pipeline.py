"""A training corpus from raw documents: rules, toxicity, near-duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Each stage's rows are written as Parquet to the shared folder
and read again as the next one's ``docs``. All stages but the last return the
columns they were given, so extra columns pass through whatever their names.

Every stage handles NULLs, empty and repeated rows and empty tables as its operator
states: texts without words fail the quality rules; toxicity keeps what scores below
0.5; of every group of near-duplicates the row with the smallest id stays (a NULL
id last); every remaining row is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import packing, quality_rules, simhash, toxicity
from tallyline.llm.common import documents
from tallyline.llm.queries import END_ID, TOKENIZER
from tallyline.session import materialize
from tallyline.sources import read_table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base check and are probably of good quality."""
    return quality_rules.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are probably not toxic, by a model trained on the labelled
    documents of the folder that may be used for training."""
    labels = toxicity.training_labels(read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.fit(documents(spark, sf_dir), labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows packed into sequences: one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("quality_rules", rules_stage), ("toxicity", toxicity_stage), ("simhash", dedup_stage),
          ("packing", packing_stage)]

#: Trained models and tokenizer libraries have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
