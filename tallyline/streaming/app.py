"""The vote application and the word count as ready-made sets of streaming
queries, plus a command line.

``start_vote_pipeline`` takes the batch, window and slide lengths in
milliseconds, like the original application's three arguments, and starts:
acceptance (quota + contestant check -> ``accepted/``, records and rate of the same
batch -> ``metrics/``) and what follows its commits: the leaderboard (top 10 after every
batch -> ``leaderboard/``), sliding-window counts (-> ``windows/``), the vote store (->
``votes/``) and the rate summary (-> ``summary/``). Outputs and checkpoints live under one
folder, by default inside ``spark.checkpoint.dir``. With ``--print`` each batch prints its
records and rate, the leaderboard and the windows that ended.

Command line::

    python -m tallyline.streaming.app votes SOURCE [--variant batch|arrival]
        [--batch-ms 1000 --window-ms 5000 --slide-ms 1000] [--max-votes 1]
        [--contestants 6] [--out DIR] [--once] [--max-files-per-trigger N] [--print]
    python -m tallyline.streaming.app words SOURCE [--batch-ms 1000] [--out DIR] [--once]
        [--max-files-per-trigger N] [--print]
    python -m tallyline.streaming.app summary METRICS_DIR [--interval-s 1]
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyline.operators.metrics import rate_summary_when_idle, summary_line
from tallyline.session import build_session, checkpoint_root
from tallyline.streaming import pipeline as P
from tallyline.streaming.follow import Leaderboard, RateSummary, Show, VoteStore, WindowCounts, start_follower
from tallyline.streaming.single import MODE, accept_single_calls


@dataclass
class Pipeline:
    """Started queries by name, and the output folder."""

    root: str
    queries: dict[str, StreamingQuery] = field(default_factory=dict)

    def await_all(self) -> None:
        for q in self.queries.values():
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()


def start_vote_pipeline(spark: SparkSession, source: str, out_root: str | None = None,
                        variant: str = "batch", batch_ms: int = 1000, window_ms: int = 5000,
                        slide_ms: int = 1000, max_votes: int = 1, num_contestants: int = 6,
                        top: int = 10, once: bool = False,
                        max_files_per_trigger: int | None = None,
                        strict: bool = True, show: Show | None = None) -> Pipeline:
    """Start the vote application on text files of call lines in ``source``.

    ``once=True`` processes what is there and stops (``availableNow``),
    running the followers after acceptance has finished; otherwise all
    queries run side by side, triggered every ``batch_ms`` (windows: every ``slide_ms``),
    also while no calls come. ``show`` is called with the lines to print after each batch.
    """
    root = out_root or os.path.join(checkpoint_root(spark), "votes")
    table = {n: os.path.join(root, n) for n in ("accepted", "metrics", "leaderboard", "windows", "votes", "summary")}
    check = {n: os.path.join(root, "_checkpoints", n) for n in table}
    trigger = {"availableNow": True} if once else {"processingTime": f"{batch_ms} milliseconds"}
    pipe = Pipeline(root)

    calls = P.call_line_stream(spark, source, max_files_per_trigger, strict)
    calls = P.counted(calls, None if once else P.clock(spark))
    if max_votes == 1:
        accepted, mode = accept_single_calls(calls, variant, num_contestants), MODE
    else:
        accepted, mode = P.accept_calls(calls, variant, max_votes, num_contestants), "append"
    pipe.queries["accepted"] = P.start_acceptance(accepted, table["accepted"], check["accepted"], trigger, mode=mode,
                                                  metrics_dir=table["metrics"], batch_ms=batch_ms, show=show)
    if once:
        pipe.queries["accepted"].awaitTermination()

    board = Leaderboard(spark, table["accepted"], table["leaderboard"], top, show)
    votes = VoteStore(spark, table["accepted"], table["votes"])
    summary = RateSummary(spark, table["metrics"], table["summary"])
    windows = WindowCounts(spark, table["accepted"], table["windows"], window_ms, slide_ms, show)
    for name, step, follows in (("leaderboard", board.step, "accepted"), ("votes", votes.step, "accepted"),
                                ("summary", summary.step, "metrics")):
        pipe.queries[name] = start_follower(spark, table[follows], step, check[name], trigger)
    slides = trigger if once else {"processingTime": f"{slide_ms} milliseconds"}
    pipe.queries["windows"] = windows.start(check["windows"], slides, live=not once)
    return pipe


def start_word_count(spark: SparkSession, source: str, out_root: str | None = None,
                     batch_ms: int = 1000, once: bool = False,
                     max_files_per_trigger: int | None = None, show: Show | None = None) -> Pipeline:
    """Per-batch word counts of text lines arriving in ``source``; ``show`` gets ten of each batch."""
    root = out_root or os.path.join(checkpoint_root(spark), "words")
    trigger = {"availableNow": True} if once else {"processingTime": f"{batch_ms} milliseconds"}
    pipe = Pipeline(root)
    pipe.queries["words"] = P.start_word_counts(
        P._line_reader(spark, source, max_files_per_trigger), os.path.join(root, "counts"),
        os.path.join(root, "_checkpoints", "words"), trigger, show=show)
    return pipe


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m tallyline.streaming.app")
    sub = parser.add_subparsers(dest="cmd", required=True)
    votes = sub.add_parser("votes")
    votes.add_argument("source")
    votes.add_argument("--variant", choices=["batch", "arrival"], default="batch")
    votes.add_argument("--batch-ms", type=int, default=1000)
    votes.add_argument("--window-ms", type=int, default=5000)
    votes.add_argument("--slide-ms", type=int, default=1000)
    votes.add_argument("--max-votes", type=int, default=1)
    votes.add_argument("--contestants", type=int, default=6)
    votes.add_argument("--out")
    votes.add_argument("--once", action="store_true")
    votes.add_argument("--max-files-per-trigger", type=int)
    votes.add_argument("--print", action="store_true", dest="show")
    words = sub.add_parser("words")
    words.add_argument("source")
    words.add_argument("--batch-ms", type=int, default=1000)
    words.add_argument("--out")
    words.add_argument("--once", action="store_true")
    words.add_argument("--max-files-per-trigger", type=int)
    words.add_argument("--print", action="store_true", dest="show")
    summary = sub.add_parser("summary")
    summary.add_argument("metrics_dir")
    summary.add_argument("--interval-s", type=int, default=1)
    args = parser.parse_args(argv)

    spark = build_session()
    if args.cmd == "votes":
        pipe = start_vote_pipeline(spark, args.source, args.out, args.variant, args.batch_ms,
                                   args.window_ms, args.slide_ms, args.max_votes,
                                   args.contestants, once=args.once,
                                   max_files_per_trigger=args.max_files_per_trigger,
                                   show=print if args.show else None)
        pipe.await_all()
    elif args.cmd == "words":
        start_word_count(spark, args.source, args.out, args.batch_ms, once=args.once,
                         max_files_per_trigger=args.max_files_per_trigger,
                         show=print if args.show else None).await_all()
    else:
        series = P.metric_series_by_time(spark, args.metrics_dir, args.interval_s)
        for row in summary_line(rate_summary_when_idle(series)).collect():
            print(row.line)


if __name__ == "__main__":
    main()
