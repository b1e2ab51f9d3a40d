"""Named batch queries over a data folder of parquet tables.

Each query is ``(spark, data_dir) -> DataFrame`` and reads whole tables.
The call stream is the call view over ``events`` (see
:class:`tallyline.sources.CallViewSpec`); accepted calls come from the
arrival quota unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import boards, kv, metrics, quota, words
from tallyline.sources.calls import CallViewSpec, call_lines, call_view, parse_calls
from tallyline.sources.tables import read_table, spread
from tallyline.sources.text import document_lines


@dataclass(frozen=True)
class QueryParams:
    """Fixed query parameters: quota of 20 calls per phone, six contestants,
    1-hour batches, 5-hour windows sliding by 1 hour (the 1:5:1 shape of the
    example run), 600-second batches for idle detection, the last 4 samples
    trimmed and 3 zero samples marking idleness, top 10 on the leaderboard,
    100 documents per word-count batch, whose scan is dealt to
    ``word_partitions`` tasks if given."""

    max_votes: int = 20
    num_contestants: int = 6
    batch_seconds: int = 3600
    window_seconds: int = 5 * 3600
    slide_seconds: int = 3600
    idle_batch_seconds: int = 600
    trailing_samples: int = 4
    idle_run: int = 3
    top: int = 10
    docs_per_batch: int = 100
    word_partitions: int | None = None

    @property
    def view(self) -> CallViewSpec:
        return CallViewSpec(batch_seconds=self.batch_seconds)


P = QueryParams()


def calls(spark: SparkSession, data_dir: str, params: QueryParams = P) -> DataFrame:
    return call_view(read_table(spark, data_dir, "events"), params.view)


def accepted_arrival(spark: SparkSession, data_dir: str, params: QueryParams = P) -> DataFrame:
    return quota.arrival_quota(calls(spark, data_dir, params), params.max_votes,
                               params.num_contestants)


def accepted_batch(spark: SparkSession, data_dir: str, params: QueryParams = P) -> DataFrame:
    return quota.batch_quota(calls(spark, data_dir, params), params.max_votes,
                             params.num_contestants)


def q_parse_calls(spark, data_dir):
    """Render every call as a text line, then parse the lines back (strict)."""
    return parse_calls(call_lines(calls(spark, data_dir)))


def q_valid_contestant_calls(spark, data_dir):
    return (quota.valid_contestant(calls(spark, data_dir), P.num_contestants)
            .select("vote_id", "phone_number", "contestant_number"))


def q_running_call_counts(spark, data_dir):
    return quota.running_call_counts(calls(spark, data_dir))


def q_allowed_phones(spark, data_dir):
    return quota.allowed_phone_batches(calls(spark, data_dir), P.max_votes)


def q_batch_quota(spark, data_dir):
    return accepted_batch(spark, data_dir).select("vote_id", "contestant_number")


def q_batch_quota_join(spark, data_dir):
    """Variant A through the allowed (phone, batch) table and a semi-join."""
    return (quota.batch_quota_join(calls(spark, data_dir), P.max_votes, P.num_contestants)
            .select("vote_id", "contestant_number"))


def q_arrival_quota(spark, data_dir):
    return accepted_arrival(spark, data_dir).select("vote_id", "contestant_number")


def q_contestant_totals_by_batch(spark, data_dir):
    return boards.totals_by_batch(accepted_arrival(spark, data_dir))


def q_leaderboard(spark, data_dir):
    return boards.leaderboard(accepted_arrival(spark, data_dir), P.top)


def q_leaderboard_history(spark, data_dir):
    """The top 10 after every batch, every contestant seen so far re-emitted."""
    return boards.leaderboard_history(accepted_arrival(spark, data_dir), P.top)


def q_leaderboard_batch_quota(spark, data_dir):
    return boards.leaderboard(accepted_batch(spark, data_dir), P.top)


def q_window_contestant_counts(spark, data_dir):
    return boards.sliding_window_counts(accepted_arrival(spark, data_dir), "ts",
                                        P.window_seconds, P.slide_seconds)


def q_window_counts_batch_quota(spark, data_dir):
    return boards.sliding_window_counts(accepted_batch(spark, data_dir), "ts",
                                        P.window_seconds, P.slide_seconds)


def q_vote_kv_latest(spark, data_dir):
    """Store writes keyed by phone (so keys repeat); the last write wins."""
    writes = kv.kv_rows(accepted_arrival(spark, data_dir), key="phone_number")
    return kv.latest_per_key(writes)


def q_vote_kv_store(spark, data_dir):
    """The accepted-vote store keyed by vote id, variant A acceptance."""
    return kv.latest_per_key(kv.kv_rows(accepted_batch(spark, data_dir), key="vote_id"))


def _metric_series(spark, data_dir, batch_seconds):
    spec = CallViewSpec(batch_seconds=batch_seconds)
    view = call_view(read_table(spark, data_dir, "events"), spec)
    counts = metrics.batch_counts(spark, view.select("batch_id"))
    return metrics.batch_rates(counts, batch_seconds, spec.origin_seconds)


def _sparse_series(spark, data_dir, batch_seconds):
    """Counts and rates of the batches with calls only."""
    spec = CallViewSpec(batch_seconds=batch_seconds)
    view = call_view(read_table(spark, data_dir, "events"), spec)
    return metrics.batch_rates(metrics.sparse_counts(view.select("batch_id")), batch_seconds, spec.origin_seconds)


def q_batch_counts(spark, data_dir):
    return _metric_series(spark, data_dir, P.batch_seconds).select("batch_id", "n")


def q_batch_rate(spark, data_dir):
    return _metric_series(spark, data_dir, P.batch_seconds)


def q_rate_stats(spark, data_dir):
    stats = metrics.rate_summary(_sparse_series(spark, data_dir, P.batch_seconds),
                                 P.trailing_samples)
    return stats.select("n_batches", *[F.round(c, 9).alias(c) for c in
                                       ("max_rate", "min_rate", "avg_rate", "stddev_rate")])


def q_idle_batches(spark, data_dir):
    return metrics.idle_ids(_sparse_series(spark, data_dir, P.idle_batch_seconds), P.idle_run)


def q_idle_runs(spark, data_dir):
    """Idle stretches by first and last batch, without a row per batch."""
    return metrics.idle_runs(_sparse_series(spark, data_dir, P.idle_batch_seconds), P.idle_run)


def q_window_counts_any_slide(spark, data_dir):
    """Windows of 7 hours every 3: size and slide share no common pane but an hour."""
    return boards.sliding_window_counts(accepted_arrival(spark, data_dir), "ts", 7 * 3600, 3 * 3600)


def q_word_counts(spark, data_dir):
    docs = read_table(spark, data_dir, "documents").select(
        F.expr(f"doc_id div {P.docs_per_batch}").alias("batch_id"), "text")
    return words.word_counts(document_lines(spread(docs, P.word_partitions), keep=("batch_id",)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_calls": q_parse_calls,
    "valid_contestant_calls": q_valid_contestant_calls,
    "running_call_counts": q_running_call_counts,
    "allowed_phones": q_allowed_phones,
    "batch_quota": q_batch_quota,
    "batch_quota_join": q_batch_quota_join,
    "arrival_quota": q_arrival_quota,
    "contestant_totals_by_batch": q_contestant_totals_by_batch,
    "leaderboard": q_leaderboard,
    "leaderboard_history": q_leaderboard_history,
    "leaderboard_batch_quota": q_leaderboard_batch_quota,
    "window_contestant_counts": q_window_contestant_counts,
    "window_counts_batch_quota": q_window_counts_batch_quota,
    "vote_kv_latest": q_vote_kv_latest,
    "vote_kv_store": q_vote_kv_store,
    "batch_counts": q_batch_counts,
    "batch_rate": q_batch_rate,
    "rate_stats": q_rate_stats,
    "idle_batches": q_idle_batches,
    "idle_runs": q_idle_runs,
    "window_counts_any_slide": q_window_counts_any_slide,
    "word_counts": q_word_counts,
}
