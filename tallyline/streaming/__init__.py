"""Streaming forms: keyed quota state, chained queries, idempotent sinks."""

from tallyline.streaming.processors import ArrivalQuotaProcessor, BatchQuotaProcessor, trim_calls
from tallyline.streaming.pipeline import (
    CALL_STREAM_SCHEMA,
    EVENTS_SCHEMA,
    TRIMMED_BATCH_SCHEMA,
    accept_calls,
    bind_table,
    call_line_stream,
    clock,
    counted,
    event_call_stream,
    metric_series_by_time,
    read_accepted,
    read_metric_series,
    read_phone_counts,
    read_word_counts,
    rejected_line_stream,
    start_acceptance,
    start_batch_metrics,
    start_word_counts,
    write_batch,
)
from tallyline.streaming.follow import Leaderboard, RateSummary, VoteStore, WindowCounts, start_follower
from tallyline.streaming.ledger import Folder, Ledger
from tallyline.streaming.store import KeyedStore
from tallyline.streaming.single import accept_single_calls

__all__ = [
    "accept_single_calls",
    "Folder",
    "KeyedStore",
    "Leaderboard",
    "Ledger",
    "RateSummary",
    "VoteStore",
    "WindowCounts",
    "start_follower",
    "clock",
    "counted",
    "ArrivalQuotaProcessor",
    "BatchQuotaProcessor",
    "CALL_STREAM_SCHEMA",
    "EVENTS_SCHEMA",
    "TRIMMED_BATCH_SCHEMA",
    "accept_calls",
    "bind_table",
    "call_line_stream",
    "event_call_stream",
    "metric_series_by_time",
    "read_accepted",
    "read_metric_series",
    "read_phone_counts",
    "read_word_counts",
    "rejected_line_stream",
    "start_acceptance",
    "start_batch_metrics",
    "start_word_counts",
    "trim_calls",
    "write_batch",
]
