"""A key/value table that a running stream keeps up to date, by copy on write.

Keys are dealt to ``buckets`` by hash. A micro-batch reads the buckets that its keys fall
into, merges its rows in, and writes these buckets anew; all others stay where they are. A
version is a list that says for every bucket which attempt wrote it last. The list is
written before the version is committed in the table's :class:`Ledger`, so readers see
a whole version or the one before, and an attempt that was lost is never read. A replayed
batch finds its version there and changes nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.streaming.ledger import Ledger

BUCKET = "bucket"


def last_write(value_cols: list[str], order: list[str]) -> Callable[[], list[Column]]:
    """Of all rows of a key the one that is last by ``order`` (of equal ones the largest)."""
    def columns() -> list[Column]:
        row = F.max(F.struct(*order, *value_cols))
        return [row[c].alias(c) for c in (*value_cols, *order)]
    return columns


def summed(value_cols: list[str]) -> Callable[[], list[Column]]:
    """The sums of whole-number columns."""
    return lambda: [F.sum(c).cast("bigint").alias(c) for c in value_cols]


class KeyedStore:
    """``keys`` identify a row; ``merge`` gives the aggregates that make one row of all rows of a key.

    ``schema`` lists the key columns first, then the columns that ``merge`` gives.
    """

    def __init__(self, spark: SparkSession, table: str, schema: str, keys: list[str],
                 merge: Callable[[], list[Column]], buckets: int = 64):
        self.spark, self.ledger, self.keys, self.merge, self.buckets = spark, Ledger(spark, table), keys, merge, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def _places(self) -> dict[int, str]:
        last = self.ledger.last()
        if last is None:
            return {}
        return {int(b): a for b, a in json.loads(self.ledger.folder("versions", last.attempt).read()).items()}

    def _read(self, places: dict[int, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.ledger.table}/data/{attempt}/{BUCKET}={b}" for b, attempt in places.items()]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The current rows."""
        return self._read(self._places())

    @property
    def source(self) -> int:
        """How far the batches of the table that is followed have been merged in."""
        last = self.ledger.last()
        return -1 if last is None else last.source

    def update(self, changes: DataFrame, batch: int, source: int = -1, keep: Column | None = None) -> bool:
        """Merge ``changes`` (columns of the schema) in as version ``batch``; rows of
        the touched buckets for which ``keep`` is not true are left out. Returns whether
        it wrote: a version that is there already stays as it is."""
        last = self.ledger.last()
        if last is not None and batch <= last.last:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = changes.select(*self.schema.fieldNames())
        places = self._places()
        # at most one number per bucket
        touched = sorted(r[0] for r in rows.select(bucket.alias(BUCKET)).distinct().collect())
        attempt, path = self.ledger.new_folder()
        old = self._read({b: places[b] for b in touched if b in places})
        merged = old.unionByName(rows).groupBy(*self.keys).agg(*self.merge()).withColumn(BUCKET, bucket)
        if keep is not None:
            merged = merged.where(keep)
        if touched:
            # one file per bucket: a bucket's rows come from one task
            merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
            written = self.ledger.folder("data", attempt).listed()
            for b in touched:
                places.pop(b, None)
                if f"{BUCKET}={b}" in written:
                    places[b] = attempt
        self.ledger.folder("versions", attempt).create(json.dumps(places))
        self.ledger.commit(batch, batch, attempt, source)
        return True

    def vacuum(self, older_than_s: float = 3600.0) -> int:
        """Delete versions older than the current one and what only they use, when
        they are ``older_than_s`` seconds old; returns the folders deleted."""
        every, now = self.ledger.all_commits(), time.time()
        last = self.ledger.last()
        for c, at in every.items():
            if c != last and now - at >= older_than_s:
                self.ledger.folder("commits", c.name).delete()
                self.ledger.folder("versions", c.attempt).delete()
        used = {c.attempt for c in self.ledger.all_commits()}
        used |= {a for c in self.ledger.all_commits()
                 for a in json.loads(self.ledger.folder("versions", c.attempt).read()).values()}
        gone = [n for n, at in self.ledger.folder("data").listed().items() if n not in used and now - at >= older_than_s]
        for name in gone:
            self.ledger.folder("data", name).delete()
        return len(gone)
