"""DataFrame -> DataFrame operators. None of them collects to the driver."""

from tallyline.operators.quota import (
    allowed_phone_batches,
    arrival_quota,
    batch_quota,
    batch_quota_join,
    first_calls,
    phone_batch_counts,
    running_call_counts,
    running_phone_counts,
    valid_contestant,
)
from tallyline.operators.boards import (
    contestant_totals,
    leaderboard,
    leaderboard_history,
    sliding_window_counts,
    totals_by_batch,
)
from tallyline.operators.metrics import (
    batch_counts,
    batch_rates,
    dense_ids,
    gap_runs,
    idle_batches,
    idle_ids,
    idle_runs,
    numbered_samples,
    rate_summary,
    rate_summary_when_idle,
    sparse_counts,
    summary_line,
)
from tallyline.operators.kv import kv_rows, latest_per_key
from tallyline.operators.words import word_counts

__all__ = [
    "allowed_phone_batches",
    "arrival_quota",
    "batch_quota",
    "batch_quota_join",
    "first_calls",
    "phone_batch_counts",
    "running_call_counts",
    "running_phone_counts",
    "valid_contestant",
    "contestant_totals",
    "leaderboard",
    "leaderboard_history",
    "sliding_window_counts",
    "totals_by_batch",
    "batch_counts",
    "batch_rates",
    "dense_ids",
    "gap_runs",
    "idle_batches",
    "idle_ids",
    "idle_runs",
    "numbered_samples",
    "sparse_counts",
    "rate_summary",
    "rate_summary_when_idle",
    "summary_line",
    "kv_rows",
    "latest_per_key",
    "word_counts",
]
