"""Tables that follow the commits of another table: vote store, leaderboard, windows, rate summary.

A follower keeps its state in a table of its own and records with every version how far
it has read its source. A step reads the committed batches after that, merges them in and
commits; a step that is lost leaves the version before it, so the same batches are read
again. Steps are called by a small stream over the names of the source's commits
(:func:`start_follower`), which carries no data, or by a clock.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.time import bucket_index, ltz_from_micros
from tallyline.operators.kv import kv_rows
from tallyline.operators.metrics import SUMMARY_COLUMNS
from tallyline.streaming import pipeline
from tallyline.streaming.ledger import FAN, Ledger
from tallyline.streaming.store import KeyedStore, last_write, summed

BOARD_SCHEMA = "contestant_number int, total bigint, batch_id bigint"
WINDOWS_SCHEMA = "window_start timestamp, window_end timestamp, contestant_number int, n bigint, batch_id bigint"
Show = Callable[[str], None]


def start_follower(spark: SparkSession, source_dir: str, step: Callable[[], None], checkpoint: str,
                   trigger: dict | None = None, name: str | None = None, ticks: DataFrame | None = None) -> StreamingQuery:
    """Call ``step`` whenever the table at ``source_dir`` has new commits (or ``ticks`` new rows)."""
    Ledger(spark, source_dir).make()
    signals = spark.readStream.format("text").load(f"{source_dir}/commits") if ticks is None else ticks
    return pipeline._start(signals.writeStream.foreachBatch(lambda df, _: step()), checkpoint, trigger, name)


def show_rows(df: DataFrame, show: Show, top: int = 10) -> None:
    """The first ``top`` rows, one line each."""
    for row in df.limit(top).collect():
        show(" ".join(str(v) for v in row))


def _new_batches(source: Ledger, after: int) -> int | None:
    """The last committed batch, if there is any after ``after``."""
    last = source.last()
    return last.last if last is not None and last.last > after else None


def _version(ledger: Ledger) -> int:
    last = ledger.last()
    return -1 if last is None else last.last


@dataclass
class VoteStore:
    """Key -> rendered call of an accepted table; the last write of a key wins.

    Writes are ordered by micro-batch, then by arrival inside it (time, vote id)."""
    spark: SparkSession
    accepted_dir: str
    store_dir: str
    key: str = "vote_id"
    buckets: int = 64

    def __post_init__(self):
        order = ["batch_id", "ts", "vote_id"]
        self.store = KeyedStore(self.spark, self.store_dir,
                                "key string, value string, batch_id bigint, ts timestamp, vote_id bigint", ["key"],
                                last_write(["value"], order), self.buckets)

    def step(self) -> None:
        source, done = Ledger(self.spark, self.accepted_dir), self.store.source
        last = _new_batches(source, done)
        if last is None:
            return
        rows = source.read(pipeline.ACCEPTED_SCHEMA, done, last)
        changes = kv_rows(rows, self.key, ("batch_id", "ts", "vote_id"))
        version = _version(self.store.ledger) + 1
        self.store.update(changes, version, last)
        if version % FAN == FAN - 1:
            self.store.vacuum()

    def read(self) -> DataFrame:
        """(key, value): the current store."""
        return self.store.read().select("key", "value")


@dataclass
class Leaderboard:
    """Running totals per contestant of an accepted table, and the top rows after every step."""
    spark: SparkSession
    accepted_dir: str
    board_dir: str
    top: int = 10
    show: Show | None = None

    def __post_init__(self):
        self.totals = KeyedStore(self.spark, f"{self.board_dir}/totals", "contestant_number int, total bigint",
                                 ["contestant_number"], summed(["total"]), 1)
        self.boards = Ledger(self.spark, self.board_dir)

    def step(self) -> None:
        source, done = Ledger(self.spark, self.accepted_dir), self.totals.source
        last = _new_batches(source, done)
        if last is not None:
            rows = source.read(pipeline.ACCEPTED_SCHEMA, done, last)
            counts = rows.groupBy("contestant_number").agg(F.count(F.lit(1)).alias("total"))
            self.totals.update(counts, _version(self.totals.ledger) + 1, last)
        version = _version(self.totals.ledger)
        # also the board of a step that was lost after its totals
        if version >= 0 and not self.boards.has(version):
            board = self.totals.read().orderBy(F.desc("total"), F.asc("contestant_number")).limit(self.top)
            pipeline.write_batch(board, self.board_dir, version)
            if self.show:
                show_rows(board.select("total", "contestant_number"), self.show, self.top)
            if version % FAN == FAN - 1:
                self.totals.vacuum()

    def read(self) -> DataFrame:
        """(contestant_number, total, batch_id): the boards of all steps."""
        return self.boards.read(BOARD_SCHEMA)


@dataclass
class WindowCounts:
    """Counts per contestant in sliding windows of an accepted table, each written once, when it has ended.

    Calls are counted per pane, a stretch of the greatest common divisor of size and
    slide. A window that has ended is the sum of its panes; panes that belong to no later
    window are dropped, so the state holds the panes of one window and of the batches
    just read, however long the stream runs. A window has ended when the accepted table
    has a call in a later pane, or by the clock (``step(now_us)``). Batches
    come in order of ``ts``, as they do where it is the time of arrival: a call of a window that
    has been written is not counted in it any more.
    """
    spark: SparkSession
    accepted_dir: str
    windows_dir: str
    size_ms: int
    slide_ms: int
    show: Show | None = None

    def __post_init__(self):
        self.size, self.slide = self.size_ms * 1000, self.slide_ms * 1000
        self.pane = gcd(self.size, self.slide)
        self.panes = KeyedStore(self.spark, f"{self.windows_dir}/panes", "pane bigint, contestant_number int, n bigint",
                                ["pane", "contestant_number"], summed(["n"]), 1)
        self.windows = Ledger(self.spark, self.windows_dir)

    def _held_by(self):
        """First and last window that hold a pane; window k is [k slide, k slide + size)."""
        start = F.col("pane") * self.pane
        return (bucket_index(start + F.lit(self.pane - self.size + self.slide - 1), 0, 0, self.slide),
                bucket_index(start, 0, 0, self.slide))

    def step(self, now_us: int | None = None, flush: bool = False) -> None:
        written = self.windows.last()
        done = -(1 << 62) if written is None else written.source  # the last window that was written
        source, read = Ledger(self.spark, self.accepted_dir), self.panes.source
        last = _new_batches(source, read)
        if last is not None:
            rows = source.read(pipeline.ACCEPTED_SCHEMA, read, last).where("ts is not null")
            pane = bucket_index(F.unix_micros("ts"), 0, 0, self.pane)
            counts = rows.groupBy(pane.alias("pane"), "contestant_number").agg(F.count(F.lit(1)).alias("n"))
            self.panes.update(counts, _version(self.panes.ledger) + 1, last, keep=self._held_by()[1] > F.lit(done))
        if self.panes.ledger.last() is None:
            return
        first, final = self._held_by()
        latest = self.panes.read().agg(F.max("pane"), F.max(final)).first()
        if latest[0] is None:  # no call had a time
            return
        now = latest[0] * self.pane if now_us is None else max(now_us, latest[0] * self.pane)
        upto = latest[1] if flush else (now - self.size) // self.slide
        if upto <= done:
            return
        ended = (self.panes.read().where(first <= final).select("contestant_number", "n", F.explode(F.sequence(first, final)).alias("k"))
                 .where((F.col("k") > done) & (F.col("k") <= upto))
                 .groupBy("k", "contestant_number").agg(F.sum("n").cast("bigint").alias("n")))
        start = F.col("k") * F.lit(self.slide)
        rows = ended.select(ltz_from_micros(start).alias("window_start"),
                            ltz_from_micros(start + F.lit(self.size)).alias("window_end"), "contestant_number", "n")
        version = _version(self.windows) + 1
        self.windows.append(rows, version, upto)
        if self.show:
            show_rows(self.windows.read(WINDOWS_SCHEMA, version - 1).select("contestant_number", "n"), self.show)
        if version % FAN == FAN - 1:
            self.windows.compact()
            self.windows.vacuum()
            self.panes.vacuum()

    def read(self) -> DataFrame:
        """(window_start, window_end, contestant_number, n) of all windows written."""
        return self.windows.read(WINDOWS_SCHEMA).drop("batch_id")

    def start(self, checkpoint: str, trigger: dict, live: bool, name: str | None = None) -> StreamingQuery:
        """With ``live`` the clock ends windows, also while there are no calls."""
        if not live:
            return start_follower(self.spark, self.accepted_dir, self.step, checkpoint, trigger, name)
        return start_follower(self.spark, self.accepted_dir, lambda: self.step(int(time.time() * 1_000_000)),
                              checkpoint, trigger, name, pipeline.clock(self.spark))


_MOMENTS = "upto bigint, n bigint, mean double, m2 double, least double, most double, batch_id bigint"


@dataclass
class RateSummary:
    """The rate summary of a metric table, kept up to date batch by batch.

    The state is one row: count, mean, sum of squared deviations, least and greatest of
    the non-zero rates but for those of the last ``trailing`` samples, which are held back
    until later ones have come. A step reads only batches it has not taken yet
    and merges their moments in (Chan's formula); the series is never read again.
    """
    spark: SparkSession
    metrics_dir: str
    summary_dir: str
    trailing: int = 4
    run: int = 3

    def __post_init__(self):
        self.table = Ledger(self.spark, self.summary_dir)

    def _state(self):
        last = self.table.last()
        return None if last is None else self.table.read(_MOMENTS, last.last - 1).first()

    def step(self) -> None:
        source = Ledger(self.spark, self.metrics_dir)
        last, state = source.last(), self._state()
        done = -1 if state is None else state["upto"]
        if last is None or last.last - self.trailing <= done:
            return
        upto = last.last - self.trailing
        new = source.read(pipeline.METRICS_SCHEMA, done, upto).where("rate <> 0").agg(
            F.count("rate"), F.avg("rate"), F.var_pop("rate") * F.count("rate"), F.min("rate"), F.max("rate")).first()
        merged = merge_moments(tuple(state)[1:6] if state is not None else (0, None, None, None, None), tuple(new))
        row = self.spark.createDataFrame([(upto, *merged)], _MOMENTS.rsplit(",", 1)[0])
        pipeline.write_batch(row, self.summary_dir, _version(self.table) + 1)

    def read(self) -> DataFrame:
        """One row as :func:`tallyline.operators.metrics.rate_summary` gives it."""
        state = self._state()
        n, mean, m2, least, most = tuple(state)[1:6] if state is not None else (0, None, None, None, None)
        deviation = (m2 / (n - 1)) ** 0.5 if n > 1 else None
        types = T.StructType([T.StructField(c, T.LongType() if c == "n_batches" else T.DoubleType())
                              for c in SUMMARY_COLUMNS])
        return self.spark.createDataFrame([(n, most, least, mean, deviation)], types)

    def idle(self) -> bool:
        """Whether the last ``run`` samples are zero, after more than ``run`` of them."""
        source = Ledger(self.spark, self.metrics_dir)
        last = source.last()
        if last is None or last.last < self.run:
            return False
        return source.read(pipeline.METRICS_SCHEMA, last.last - self.run).agg(F.sum("rate")).first()[0] == 0


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, m2, least, most) of two samples together; an empty one has n = 0."""
    if not a[0] or not b[0]:
        return b if b[0] else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return (n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4]))
