"""Named queries that send a whole stored table through the streaming forms.

Calls of ``INTERVAL_SECONDS`` of event time arrive together as one micro-batch,
with a restart from the checkpoint after each (:mod:`tallyline.streaming.replay`).
The streams run while the query is built; the returned DataFrame reads the table
they wrote.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import streaming as S
from tallyline.functions.calls import render_call_debug
from tallyline.functions.time import ntz_from_micros
from tallyline.operators import metrics
from tallyline.plans.oracle import ORACLE_SQL as BATCH_SQL
from tallyline.plans.oracle import _RENDER, ARRIVAL_ACCEPTED, BATCH_ACCEPTED, RUNNING, calls_sql
from tallyline.plans.queries import P, _metric_series, calls
from tallyline.session import tables_root
from tallyline.sources.calls import call_lines, parse_calls, read_call_lines
from tallyline.sources.tables import read_table
from tallyline.streaming.replay import ONCE, Replay, run_live, run_replay, stage_events, stage_lines, stream_session

INTERVAL_SECONDS = 5 * 86_400
#: Intervals without calls at the end of a replay with a clock.
IDLE_INTERVALS = 4


def _acceptance(session: SparkSession, replay: Replay, variant: str, ticks: bool = False):
    """Acceptance of a replay; the calls of each micro-batch go to its metric table."""
    def begin():
        stream = S.event_call_stream(session, replay.source)
        clock = session.readStream.text(replay.ticks) if ticks else None
        accepted = S.accept_calls(S.counted(stream, clock), variant, P.max_votes, P.num_contestants)
        return S.start_acceptance(accepted, replay.table("accepted"), replay.checkpoint("accepted"), ONCE,
                                  metrics_dir=replay.table("metrics"), batch_ms=INTERVAL_SECONDS * 1000)
    return begin


def _replay(spark: SparkSession, data_dir: str) -> Replay:
    return stage_events(read_table(spark, data_dir, "events"), INTERVAL_SECONDS, ())


def _accepted(spark: SparkSession, data_dir: str, variant: str) -> DataFrame:
    replay = _replay(spark, data_dir)
    run_replay(spark, replay, [_acceptance(stream_session(spark), replay, variant)])
    return S.read_accepted(spark, replay.table("accepted")).select("vote_id", "contestant_number", "batch_id")


def q_stream_arrival_quota(spark, data_dir):
    """The arrival rule with keyed state: accepted calls and their micro-batch."""
    return _accepted(spark, data_dir, "arrival")


def q_stream_batch_quota(spark, data_dir):
    """The batch rule with keyed state: accepted calls and their micro-batch."""
    return _accepted(spark, data_dir, "batch")


def _accepted_single(spark: SparkSession, data_dir: str, variant: str) -> DataFrame:
    """A quota of one call per user and contestant (the contestant is part of the phone)."""
    replay = _replay(spark, data_dir)
    session = stream_session(spark)
    line = F.col("phone_number") * 8 + F.col("contestant_number")

    def begin():
        stream = S.event_call_stream(session, replay.source).withColumn("phone_number", line)
        return S.start_acceptance(S.accept_single_calls(stream, variant, P.num_contestants), replay.table("accepted"),
                                  replay.checkpoint("accepted"), ONCE, mode="update")

    run_replay(spark, replay, [begin])
    return S.read_accepted(spark, replay.table("accepted")).select("vote_id", "contestant_number", "batch_id")


def q_stream_arrival_quota_jvm(spark, data_dir):
    """The arrival rule for a quota of one as a streaming aggregate, without Python workers."""
    return _accepted_single(spark, data_dir, "arrival")


def q_stream_batch_quota_jvm(spark, data_dir):
    """The batch rule for a quota of one as a streaming aggregate, without Python workers."""
    return _accepted_single(spark, data_dir, "batch")


def _follow(spark: SparkSession, replay: Replay, step, name: str):
    """A follower of the accepted table, started anew after every batch of acceptance."""
    return lambda: S.start_follower(spark, replay.table("accepted"), step, replay.checkpoint(name), ONCE)


def q_stream_window_counts(spark, data_dir):
    """Sliding windows over the accepted table, followed after every batch of
    acceptance: each window once, when it has ended; the last ones at the replay's end."""
    replay = _replay(spark, data_dir)
    windows = S.WindowCounts(spark, replay.table("accepted"), replay.table("windows"),
                             P.window_seconds * 1000, P.slide_seconds * 1000)
    run_replay(spark, replay, [_acceptance(stream_session(spark), replay, "arrival"),
                               _follow(spark, replay, windows.step, "windows")])
    windows.step(flush=True)
    return windows.read().select(*[ntz_from_micros(F.unix_micros(c)).alias(c) for c in ("window_start", "window_end")],
                                 "contestant_number", "n")


def q_vote_store_live(spark, data_dir):
    """The accepted-vote store of a running acceptance, keyed by phone: keys are written
    again within a batch and over batches, and the last write wins."""
    replay = _replay(spark, data_dir)
    votes = S.VoteStore(spark, replay.table("accepted"), replay.table("votes"), key="phone_number", buckets=16)
    run_replay(spark, replay, [_acceptance(stream_session(spark), replay, "arrival"),
                               _follow(spark, replay, votes.step, "votes")])
    return votes.read()


def q_stream_leaderboard(spark, data_dir):
    """The leaderboard after every batch of acceptance."""
    replay = _replay(spark, data_dir)
    board = S.Leaderboard(spark, replay.table("accepted"), replay.table("board"), P.top)
    run_replay(spark, replay, [_acceptance(stream_session(spark), replay, "arrival"),
                               _follow(spark, replay, board.step, "board")])
    return board.read()


def _phone_counts(spark: SparkSession, data_dir: str, variant: str) -> DataFrame:
    replay = _replay(spark, data_dir)
    session = stream_session(spark)
    run_replay(spark, replay, [_acceptance(session, replay, variant)])
    return S.read_phone_counts(session, replay.checkpoint("accepted"), variant)


def q_phone_counts_state(spark, data_dir):
    """The arrival rule's state read back: accepted calls per phone, before the contestant check."""
    return _phone_counts(spark, data_dir, "arrival")


def q_phone_counts_state_batch(spark, data_dir):
    """The batch rule's state read back: all calls per phone."""
    return _phone_counts(spark, data_dir, "batch")


def q_stream_call_lines(spark, data_dir):
    """Call lines as text files, read as a stream that runs on at a processing-time
    interval; the time of arrival is the batch's."""
    replay = stage_lines(read_table(spark, data_dir, "events"), INTERVAL_SECONDS, ())
    session = stream_session(spark)

    def begin():
        stream = S.call_line_stream(session, replay.source)
        return S.start_acceptance(S.accept_calls(stream, "arrival", P.max_votes, P.num_contestants),
                                  replay.table("accepted"), replay.checkpoint("accepted"), {"processingTime": "100 milliseconds"})

    run_live(spark, replay, begin)
    return S.read_accepted(spark, replay.table("accepted")).select("vote_id", "contestant_number", "batch_id")


def _heartbeat_metrics(spark: SparkSession, data_dir: str) -> Replay:
    replay = _replay(spark, data_dir)
    run_replay(spark, replay, [_acceptance(stream_session(spark), replay, "arrival", ticks=True)], IDLE_INTERVALS)
    return replay


def q_stream_heartbeat_counts(spark, data_dir):
    """Calls and rate of every micro-batch of acceptance itself, driven by a clock that
    goes on for four intervals after the last calls: idle batches count zero."""
    replay = _heartbeat_metrics(spark, data_dir)
    return S.read_metric_series(spark, replay.table("metrics")).select("batch_id", "n", "rate")


def q_stream_rate_summary(spark, data_dir):
    """The rate summary merged batch by batch, with the last four samples held back."""
    replay = _replay(spark, data_dir)
    summary = S.RateSummary(spark, replay.table("metrics"), replay.table("summary"), P.trailing_samples, P.idle_run)
    accept = _acceptance(stream_session(spark), replay, "arrival", ticks=True)

    def follow():
        return S.start_follower(spark, replay.table("metrics"), summary.step, replay.checkpoint("summary"), ONCE)

    run_replay(spark, replay, [accept, follow], IDLE_INTERVALS)
    return summary.read().select("n_batches", *[F.round(c, 9).alias(c) for c in
                                                ("max_rate", "min_rate", "avg_rate", "stddev_rate")],
                                 F.lit(summary.idle()).alias("idle"))


def _metric_table(spark: SparkSession, data_dir: str) -> DataFrame:
    replay = stage_events(read_table(spark, data_dir, "events"), INTERVAL_SECONDS, ("metrics",))
    session = stream_session(spark)

    def begin():
        return S.start_batch_metrics(S.event_call_stream(session, replay.source), replay.table("metrics"),
                                     replay.checkpoint("metrics"), INTERVAL_SECONDS * 1000, ONCE)

    run_replay(spark, replay, [begin])
    return S.read_metric_series(spark, replay.table("metrics"))


def q_stream_batch_counts(spark, data_dir):
    """Calls and rate of every micro-batch, as the metric stream stores them."""
    return _metric_table(spark, data_dir).select("batch_id", "n", "rate")


def q_stream_rate_stats(spark, data_dir):
    """The stored metric table read back and summarised."""
    stats = metrics.rate_summary(_metric_table(spark, data_dir), P.trailing_samples)
    return stats.select("n_batches", *[F.round(c, 9).alias(c) for c in
                                       ("max_rate", "min_rate", "avg_rate", "stddev_rate")])


def q_call_files(spark, data_dir):
    """Calls written as text files of call lines, read and parsed (strict)."""
    path = os.path.join(tables_root(spark), f"call-lines-{uuid.uuid4().hex}")
    call_lines(calls(spark, data_dir)).write.text(path)
    return parse_calls(read_call_lines(spark, path))


def q_call_debug(spark, data_dir):
    """Every call in the debug form, one text per call."""
    fields = [F.col(c) for c in ("vote_id", "phone_number", "contestant_number", "timestamp")]
    return calls(spark, data_dir).select("vote_id", render_call_debug(*fields).alias("line"))


def q_metric_order(spark, data_dir):
    """The samples of the metric series in order of their key, numbered from 1."""
    return metrics.numbered_samples(_metric_series(spark, data_dir, P.batch_seconds)).select("position", "batch_id", "n")


REPLAYS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "call_debug": q_call_debug,
    "metric_order": q_metric_order,
    "vote_store_live": q_vote_store_live,
    "stream_leaderboard": q_stream_leaderboard,
    "phone_counts_state": q_phone_counts_state,
    "phone_counts_state_batch": q_phone_counts_state_batch,
    "stream_call_lines": q_stream_call_lines,
    "stream_heartbeat_counts": q_stream_heartbeat_counts,
    "stream_rate_summary": q_stream_rate_summary,
    "stream_arrival_quota": q_stream_arrival_quota,
    "stream_batch_quota": q_stream_batch_quota,
    "stream_arrival_quota_jvm": q_stream_arrival_quota_jvm,
    "stream_batch_quota_jvm": q_stream_batch_quota_jvm,
    "stream_window_counts": q_stream_window_counts,
    "stream_batch_counts": q_stream_batch_counts,
    "stream_rate_stats": q_stream_rate_stats,
    "call_files": q_call_files,
}

_MICRO_BATCHES = """micro AS (
  SELECT batch_id AS cut, row_number() OVER (ORDER BY batch_id NULLS FIRST) - 1 AS batch_id, n
  FROM (SELECT batch_id, count(*) AS n FROM calls GROUP BY batch_id))"""

_RATES = f"""rates AS (
  SELECT batch_id, n, CAST(n * 1000 AS DOUBLE) / {INTERVAL_SECONDS * 1000} AS rate FROM micro)"""


def _accepted_sql(steps: str, table: str) -> str:
    return f"""WITH {calls_sql(INTERVAL_SECONDS)}, {steps}, {_MICRO_BATCHES}
SELECT a.vote_id, a.contestant_number, m.batch_id
FROM {table} a JOIN micro m ON a.batch_id IS NOT DISTINCT FROM m.cut"""


_BEATS = f"""beats AS (
  SELECT batch_id, n, CAST(n * 1000 AS DOUBLE) / {INTERVAL_SECONDS * 1000} AS rate FROM micro
  UNION ALL SELECT (SELECT max(batch_id) FROM micro) + k, 0, 0.0 FROM range(1, {IDLE_INTERVALS + 1}) r(k))"""

#: One line per user and contestant, and a quota of one call.
_SINGLE = f"""lines AS (
  SELECT vote_id, contestant_number, ts, batch_id, phone_number * 8 + contestant_number AS line FROM calls),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY batch_id NULLS FIRST, ts NULLS FIRST, vote_id) AS rk,
         count(*) OVER (PARTITION BY line ORDER BY batch_id NULLS FIRST
                        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM lines),
firsts AS (SELECT * FROM ranked WHERE rk = 1 AND contestant_number <= {P.num_contestants}),
lone AS (SELECT * FROM ranked WHERE n = 1 AND contestant_number <= {P.num_contestants})"""

REPLAY_SQL: dict[str, str] = {
    "stream_arrival_quota": _accepted_sql(ARRIVAL_ACCEPTED, "acc"),
    "stream_batch_quota": _accepted_sql(f"{RUNNING}, {BATCH_ACCEPTED}", "batch_acc"),
    "stream_arrival_quota_jvm": _accepted_sql(_SINGLE, "firsts"),
    "stream_batch_quota_jvm": _accepted_sql(_SINGLE, "lone"),
    "stream_window_counts": BATCH_SQL["window_contestant_counts"],
    "stream_batch_counts": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {_MICRO_BATCHES}, {_RATES}
SELECT batch_id, n, rate FROM rates""",
    "stream_rate_stats": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {_MICRO_BATCHES}, {_RATES}
SELECT count(rate) AS n_batches, round(max(rate), 9) AS max_rate, round(min(rate), 9) AS min_rate,
       round(avg(rate), 9) AS avg_rate, round(stddev_samp(rate), 9) AS stddev_rate
FROM rates WHERE batch_id <= (SELECT max(batch_id) FROM rates) - {P.trailing_samples} AND rate <> 0""",
    "call_files": BATCH_SQL["parse_calls"],
    "call_debug": f"""WITH {calls_sql()}
SELECT vote_id, 'call : ' || concat_ws('-', vote_id, phone_number, contestant_number, "timestamp") AS line FROM calls""",
    "metric_order": BATCH_SQL["batch_counts"].replace(
        "SELECT batch_id, n FROM series", "SELECT row_number() OVER (ORDER BY batch_id) AS position, batch_id, n FROM series"),
    "vote_store_live": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {ARRIVAL_ACCEPTED}
SELECT CAST(phone_number AS VARCHAR) AS key,
       arg_max({_RENDER}, row(batch_id, ts, vote_id)) AS value
FROM acc GROUP BY phone_number""",
    "stream_leaderboard": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {ARRIVAL_ACCEPTED}, {_MICRO_BATCHES},
totals AS (
  SELECT m.batch_id, a.contestant_number, count(*) AS total
  FROM micro m JOIN acc a ON a.batch_id <= m.cut GROUP BY 1, 2),
ranked_totals AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY total DESC, contestant_number) AS place FROM totals)
SELECT contestant_number, total, batch_id FROM ranked_totals WHERE place <= {P.top}""",
    "phone_counts_state": f"""WITH {calls_sql()}, {ARRIVAL_ACCEPTED}
SELECT phone_number, count(*) AS n FROM ranked WHERE rk <= {P.max_votes} GROUP BY phone_number""",
    "phone_counts_state_batch": f"""WITH {calls_sql()}
SELECT phone_number, count(*) AS n FROM calls GROUP BY phone_number""",
    "stream_call_lines": f"""WITH {calls_sql(INTERVAL_SECONDS)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY phone_number ORDER BY batch_id, vote_id) AS rk FROM calls),
acc AS (SELECT * FROM ranked WHERE rk <= {P.max_votes} AND contestant_number <= {P.num_contestants}), {_MICRO_BATCHES}
SELECT a.vote_id, a.contestant_number, m.batch_id FROM acc a JOIN micro m ON a.batch_id = m.cut""",
    "stream_heartbeat_counts": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {_MICRO_BATCHES}, {_BEATS}
SELECT batch_id, n, rate FROM beats""",
    "stream_rate_summary": f"""WITH {calls_sql(INTERVAL_SECONDS)}, {_MICRO_BATCHES}, {_BEATS}
SELECT count(rate) AS n_batches, round(max(rate), 9) AS max_rate, round(min(rate), 9) AS min_rate,
       round(avg(rate), 9) AS avg_rate, round(stddev_samp(rate), 9) AS stddev_rate,
       (SELECT sum(rate) = 0 FROM beats WHERE batch_id > (SELECT max(batch_id) FROM beats) - {P.idle_run}) AS idle
FROM beats WHERE batch_id <= (SELECT max(batch_id) FROM beats) - {P.trailing_samples} AND rate <> 0""",
}
