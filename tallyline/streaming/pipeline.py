"""Structured Streaming wiring: sources, quota acceptance, metrics and word counts.

* ``start_acceptance``: call stream -> per-phone quota (state store) -> contestant check
  -> the accepted table, and the number of calls of the same micro-batch -> the metric table.
* ``start_batch_metrics``: records and rate of any other stream's batches.
* ``start_word_counts``: text lines -> per-batch word counts.

Every sink writes a table of committed batches (:mod:`tallyline.streaming.ledger`): readers
see a batch when it is whole, nothing is renamed, and a batch replayed after a failure runs
again (its state must be committed) but leaves what readers may have read already. Batch
ids belong to one query, so a table records the id of the query that writes it and refuses any
other. What is derived from the accepted table follows its commits
(:mod:`tallyline.streaming.follow`). Checkpoints and outputs belong in the shared folder named by
``spark.checkpoint.dir`` (see :func:`tallyline.session.checkpoint_root`).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.rates import rate_per_second
from tallyline.functions.time import epoch_micros, ltz_from_micros
from tallyline.operators import metrics, words
from tallyline.operators.quota import valid_contestant
from tallyline.sources.calls import CallViewSpec, call_view, parse_calls, parse_calls_lenient
from tallyline.streaming.ledger import FAN, Ledger
from tallyline.streaming.processors import (
    ArrivalQuotaProcessor,
    BatchQuotaProcessor,
    trim_calls,
)

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

CALL_STREAM_SCHEMA = T.StructType([
    T.StructField("vote_id", T.LongType()),
    T.StructField("phone_number", T.LongType()),
    T.StructField("contestant_number", T.IntegerType()),
    T.StructField("timestamp", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])

ACCEPTED_SCHEMA = T.StructType(CALL_STREAM_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])

METRICS_SCHEMA = T.StructType([
    T.StructField("batch_start", T.TimestampType()),
    T.StructField("n", T.LongType()),
    T.StructField("rate", T.DoubleType()),
    T.StructField("batch_id", T.LongType()),
])

# ---------------------------------------------------------------- sources

def _line_reader(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def call_line_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                     strict: bool = True) -> DataFrame:
    """Call lines from text files arriving in ``path``.

    ``strict=True`` fails the query on a malformed line, as the source
    system does; ``strict=False`` drops such lines (see
    :func:`rejected_line_stream` to keep them). ``ts`` is the arrival time:
    the micro-batch's trigger time, the same for every call of a batch, so
    windows run over batch time.
    """
    lines = _line_reader(spark, path, max_files_per_trigger)
    calls = parse_calls(lines) if strict else parse_calls_lenient(lines)[0]
    return calls.withColumn("ts", F.current_timestamp())


def rejected_line_stream(spark: SparkSession, path: str,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """The malformed lines of the same files (``value STRING``), for a side
    table next to a lenient :func:`call_line_stream`."""
    return parse_calls_lenient(_line_reader(spark, path, max_files_per_trigger))[1]


def event_call_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                      spec: CallViewSpec = CallViewSpec()) -> DataFrame:
    """Calls from parquet files of ``events`` rows arriving in ``path``; ``ts``
    is the event time as TIMESTAMP (watermarks need it)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    view = call_view(reader.parquet(path), spec)
    return view.select("vote_id", "phone_number", "contestant_number", "timestamp",
                       ltz_from_micros(epoch_micros(view, "ts")).alias("ts"))


def read_accepted(spark: SparkSession, accepted_dir: str) -> DataFrame:
    """Batch read of the accepted table (``batch_id`` is the micro-batch)."""
    return Ledger(spark, accepted_dir).read(ACCEPTED_SCHEMA)


# ---------------------------------------------------------------- operators

TRIMMED_BATCH_SCHEMA = T.StructType([*CALL_STREAM_SCHEMA.fields, T.StructField("_calls", T.LongType())])


def accept_calls(calls: DataFrame, variant: str, max_votes: int, num_contestants: int,
                 order: tuple[str, ...] = ("ts", "vote_id"), pretrim: bool = True,
                 state_ttl_ms: int | None = None) -> DataFrame:
    """Quota per phone with keyed state, then the contestant check.

    ``variant="batch"``: a phone's calls of a micro-batch are accepted only
    if its running count after the batch is within the quota.
    ``variant="arrival"``: the phone's first ``max_votes`` calls in arrival
    order are accepted.

    ``pretrim`` cuts every map task's input to a few calls per phone before the
    shuffle by phone (:func:`trim_calls`), the streaming counterpart of the
    batch forms' map-side group limit. ``state_ttl_ms`` (off by default, as
    in the source system) lets a phone's count expire after that much
    processing time without calls, bounding state by active phones. Spark
    then runs no-data micro-batches to evict expired state, so a run-once
    (``availableNow``) query only finishes with
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``.
    """
    if variant not in ("batch", "arrival"):
        raise ValueError(f"unknown quota variant {variant!r}")
    rows = calls.select(*CALL_STREAM_SCHEMA.fieldNames())
    if pretrim:
        schema = TRIMMED_BATCH_SCHEMA if variant == "batch" else CALL_STREAM_SCHEMA
        rows = rows.mapInArrow(trim_calls(variant, max_votes, order), schema)
    if variant == "batch":
        processor = BatchQuotaProcessor(max_votes, CALL_STREAM_SCHEMA, trimmed=pretrim,
                                        ttl_ms=state_ttl_ms)
    else:
        processor = ArrivalQuotaProcessor(max_votes, CALL_STREAM_SCHEMA, order,
                                          ttl_ms=state_ttl_ms)
    time_mode = "ProcessingTime" if state_ttl_ms else "None"
    out = rows.groupBy("phone_number").transformWithState(
        processor, CALL_STREAM_SCHEMA, "Append", time_mode)
    return valid_contestant(out, num_contestants)


# ---------------------------------------------------------------- sinks

def write_batch(df: DataFrame, table_dir: str, batch_id: int) -> bool:
    """Write ``df`` as batch ``batch_id`` of the table, all of it or nothing
    (:meth:`tallyline.streaming.ledger.Ledger.append`), and merge old batches where due.
    Returns whether it wrote."""
    table = Ledger(df.sparkSession, table_dir)
    wrote = table.append(df, batch_id)
    if wrote and batch_id % FAN == FAN - 1:
        table.compact()
        table.vacuum()
    return wrote


def bind_table(spark: SparkSession, table_dir: str, query_id: str) -> None:
    """Record that query ``query_id`` writes ``table_dir``; raise if another does."""
    Ledger(spark, table_dir).bind(query_id)


def _start_table(stream: DataFrame, rows, table_dir: str, checkpoint: str, trigger: dict | None,
                 name: str | None, mode: str = "append", after=None) -> StreamingQuery:
    """Write ``rows(batch, batch_id)`` of every micro-batch to ``table_dir``, then
    call ``after(query, batch_id)``, as part of the same batch."""
    started = threading.Event()
    query: list[StreamingQuery] = []
    Ledger(stream.sparkSession, table_dir).make()

    def sink(df: DataFrame, batch_id: int) -> None:
        if not started.wait(300):
            raise TimeoutError("the streaming query did not report its id")
        bind_table(df.sparkSession, table_dir, query[0].id)
        write_batch(rows(df, batch_id), table_dir, batch_id)
        if after:
            after(query[0], batch_id)

    query.append(_start(stream.writeStream.outputMode(mode).foreachBatch(sink), checkpoint, trigger, name))
    started.set()
    return query[0]


def _start(writer, checkpoint: str, trigger: dict | None, name: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start()


#: Name of the observed number of calls that reach the quota in a micro-batch.
SEEN = "calls_seen"


def counted(calls: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """``calls`` with their number observed, for ``metrics_dir`` of :func:`start_acceptance`.

    ``ticks`` is any stream that has new rows at every trigger (a clock). With it
    micro-batches run on time whether or not calls have come, so an idle one counts 0.
    """
    if ticks is None:
        return calls.observe(SEEN, F.count(F.lit(1)).alias("n"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in calls.schema.fields]
    both = (calls.withColumn("_tick", F.lit(False))
            .unionByName(ticks.select(*nothing, F.lit(True).alias("_tick"))))
    return both.observe(SEEN, F.count_if(~F.col("_tick")).alias("n")).where(~F.col("_tick")).drop("_tick")


def clock(spark: SparkSession) -> DataFrame:
    """A stream with a new row every second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()


def observed(query: StreamingQuery, name: str = SEEN) -> int:
    """The number observed by the micro-batch of ``query`` that is running, once its
    rows have been written. (Spark reports it with the batch's progress, which comes
    too late to be part of the batch. A map task that runs again counts again.)"""
    return query._jsq.streamingQuery().lastExecution().observedMetrics().apply(name).getLong(0)


def metric_line(n: int, rate: float) -> str:
    """The printed line of a micro-batch."""
    return f"records: {n} rate: {rate}"


def start_acceptance(accepted: DataFrame, accepted_dir: str, checkpoint: str,
                     trigger: dict | None = None, name: str | None = None, mode: str = "append",
                     metrics_dir: str | None = None, batch_ms: int = 1000, show=None) -> StreamingQuery:
    """Append each micro-batch's accepted calls to the accepted table. ``mode`` is the
    stream's output mode: "update" for :func:`~tallyline.streaming.single.accept_single_calls`.

    With ``metrics_dir`` the calls that this very micro-batch read (:func:`counted`) are
    one row of that table, under the same batch id, before the batch is
    recorded as done: (batch_start, n, rate = n * 1000 / batch_ms). ``show`` is called
    with a line of text for each."""
    def measure(query: StreamingQuery, batch_id: int) -> None:
        n = observed(query)
        spark = accepted.sparkSession
        row = spark.range(1).select(F.current_timestamp().alias("batch_start"), F.lit(n).cast("bigint").alias("n"),
                                    rate_per_second(F.lit(n), batch_ms).alias("rate"))
        bind_table(spark, metrics_dir, query.id)
        write_batch(row, metrics_dir, batch_id)
        if show:
            show(metric_line(n, n * 1000 / batch_ms))

    if metrics_dir:
        Ledger(accepted.sparkSession, metrics_dir).make()
    return _start_table(accepted, lambda df, _: df, accepted_dir, checkpoint, trigger, name, mode,
                        measure if metrics_dir else None)


def start_batch_metrics(records: DataFrame, metrics_dir: str, checkpoint: str, batch_ms: int,
                        trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """One row per micro-batch: batch_start (now), n, rate = n * 1000 / batch_ms."""
    def row(df: DataFrame, batch_id: int) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.current_timestamp().alias("batch_start"), "n",
            rate_per_second(F.col("n"), batch_ms).alias("rate"))
    return _start_table(records, row, metrics_dir, checkpoint, trigger, name)


WORDS_SCHEMA = "word string, n bigint, batch_id bigint"


def start_word_counts(lines: DataFrame, counts_dir: str, checkpoint: str,
                      trigger: dict | None = None, name: str | None = None, show=None, top: int = 10) -> StreamingQuery:
    """Word counts of each micro-batch's lines (not running totals); ``show`` is called
    with a line of text for ``top`` words of each batch."""
    def counts(df: DataFrame, batch_id: int) -> DataFrame:
        # each row of a text source is already one line
        batch_lines = df.select(F.lit(batch_id).cast("bigint").alias("batch_id"),
                                F.col("value").alias("line"))
        return words.word_counts(batch_lines).drop("batch_id")

    def shown(query: StreamingQuery, batch_id: int) -> None:
        written = Ledger(lines.sparkSession, counts_dir).read(WORDS_SCHEMA, batch_id - 1, batch_id)
        for row in written.limit(top).collect():
            show(f"{row.word} {row.n}")

    return _start_table(lines, counts, counts_dir, checkpoint, trigger, name, after=shown if show else None)


def read_word_counts(spark: SparkSession, counts_dir: str) -> DataFrame:
    """(word, n, batch_id) of all batches."""
    return Ledger(spark, counts_dir).read(WORDS_SCHEMA)


# ---------------------------------------------------------------- metric readers

def read_metric_series(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """(batch_id, batch_start, n, rate) as recorded, one row per micro-batch,
    in order of the batches."""
    return Ledger(spark, metrics_dir).read(METRICS_SCHEMA).select(
        "batch_id", "batch_start", "n", "rate").orderBy("batch_id")


def metric_series_by_time(spark: SparkSession, metrics_dir: str, interval_seconds: int,
                          batch_ms: int | None = None) -> DataFrame:
    """Recorded counts summed per ``interval_seconds`` slot of batch start
    time and zero-filled, so idle time (when no micro-batch ran) shows up
    as zero samples. Columns as :func:`tallyline.operators.metrics.batch_rates`.
    """
    recorded = read_metric_series(spark, metrics_dir)
    slot = F.floor(F.unix_micros("batch_start") / F.lit(interval_seconds * 1_000_000))
    per_slot = recorded.groupBy(slot.cast("bigint").alias("batch_id")).agg(
        F.sum("n").cast("bigint").alias("n"))
    spine = metrics.dense_ids(spark, per_slot, "batch_id")
    filled = spine.join(per_slot, "batch_id", "left").select(
        "batch_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return metrics.batch_rates(filled, interval_seconds, 0)


# ---------------------------------------------------------------- quota state

def read_phone_counts(spark: SparkSession, checkpoint: str, variant: str) -> DataFrame:
    """(phone_number, n): the count that :func:`accept_calls` holds for every phone, as
    of the last finished micro-batch of the query with this checkpoint: all calls
    under the batch rule, accepted ones (before the contestant check) under the arrival rule."""
    name = {"batch": "calls", "arrival": "accepted"}[variant]
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return state.select(F.col("key.phone_number").alias("phone_number"), F.col("value.n").alias("n"))
