"""Replays of a stored ``events`` table through streaming queries.

The table is written once, one folder per interval of event time (rows without
a time first). The folders then arrive in the stream's source folder one after
another, and after each arrival the queries run on what is new
(``availableNow``) and stop: one micro-batch per interval, of any number of
files, and a restart from the checkpoint between any two.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.time import bucket_index, epoch_micros
from tallyline.session import DEFAULT_CONF, tables_root
from tallyline.sources.calls import CallViewSpec, call_lines, call_view
from tallyline.streaming.ledger import Folder
from tallyline.streaming.pipeline import EVENTS_SCHEMA

ONCE = {"availableNow": True}
INTERVAL = "interval"
LINES_SCHEMA = T.StructType([T.StructField("value", T.StringType())])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Replay:
    """Staged folders in order of arrival, and the folders of the streams."""

    root: str
    arrivals: tuple[str, ...]

    @property
    def source(self) -> str:
        """What the streams read: all files of the folders that have arrived."""
        return f"{self.root}/source/*"

    @property
    def ticks(self) -> str:
        """One file per interval, whether or not calls arrived in it."""
        return f"{self.root}/ticks"

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def stage_events(events: DataFrame, interval_seconds: int, tables: tuple[str, ...],
                 spec: CallViewSpec = CallViewSpec()) -> Replay:
    """Write ``events`` by interval and make the folders of ``tables``, under
    the shared folder of this application's tables."""
    fields = EVENTS_SCHEMA.fieldNames()
    at = bucket_index(epoch_micros(events, "ts"), spec.origin_seconds, interval_seconds)
    return _staged(events.select(*fields, at.alias(INTERVAL)), EVENTS_SCHEMA, tables, "parquet")


def stage_lines(events: DataFrame, interval_seconds: int, tables: tuple[str, ...],
                spec: CallViewSpec = CallViewSpec()) -> Replay:
    """As :func:`stage_events`, the calls as text files of call lines."""
    at = bucket_index(epoch_micros(events, "ts"), spec.origin_seconds, interval_seconds)
    calls = call_view(events, spec).withColumn(INTERVAL, at)
    return _staged(call_lines(calls, (INTERVAL,)).select("value", INTERVAL), LINES_SCHEMA, tables, "text")


def _staged(rows: DataFrame, schema: T.StructType, tables: tuple[str, ...], form: str) -> Replay:
    spark = rows.sparkSession
    root = os.path.join(tables_root(spark), f"replay-{uuid.uuid4().hex}")
    staged = f"{root}/staged"
    rows.write.partitionBy(INTERVAL).format(form).save(staged)
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(INTERVAL, T.LongType())])).format(form)
    # one value per interval of the table's time range
    found = read.load(staged).select(INTERVAL).distinct().orderBy(F.asc_nulls_first(INTERVAL)).collect()
    for name in ("source", "ticks", *tables):
        Folder(spark, root, name).make()
    names = ["__HIVE_DEFAULT_PARTITION__" if r[0] is None else str(r[0]) for r in found]
    return Replay(root, tuple(f"{staged}/{INTERVAL}={n}" for n in names))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that keyed state
    needs; the settings of ``spark`` stay as they are."""
    session = spark.newSession()
    session.conf.set(STATE_STORE, DEFAULT_CONF[STATE_STORE])
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    return session


def run_replay(spark: SparkSession, replay: Replay, start: list[Callable[[], StreamingQuery]],
               idle_intervals: int = 0) -> None:
    """Let every folder arrive in turn, and a tick with it, and after each run the
    queries that ``start`` gives, one after another, to their end; then as many
    intervals with a tick alone."""
    for k, folder in enumerate([*replay.arrivals, *[None] * idle_intervals]):
        if folder is not None:
            Folder(spark, folder).move_to(Folder(spark, replay.root, "source", f"arrival-{k:06d}"))
        Folder(spark, replay.ticks, f"tick-{k:06d}").create("tick\n")
        for begin in start:
            begin().awaitTermination()


def run_live(spark: SparkSession, replay: Replay, begin: Callable[[], StreamingQuery]) -> None:
    """Start a query that runs on, let every folder arrive when the one before it
    has been processed, and stop it."""
    query = begin()
    try:
        for k, folder in enumerate(replay.arrivals):
            Folder(spark, folder).move_to(Folder(spark, replay.root, "source", f"arrival-{k:06d}"))
            query.processAllAvailable()
    finally:
        query.stop()
