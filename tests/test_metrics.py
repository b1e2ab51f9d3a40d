import math

import pytest
from pyspark.sql import functions as F

import model
from tallyline.operators import boards, metrics


def series(spark, rates, first=0):
    return spark.createDataFrame([(first + i, float(r)) for i, r in enumerate(rates)],
                                 "batch_id bigint, rate double")


def test_rate_summary_with_four_trailing_zeros(spark):
    row = metrics.rate_summary(series(spark, [10, 20, 40, 0, 0, 0, 0]), 4).first()
    assert row.n_batches == 3
    assert (row.max_rate, row.min_rate) == (40.0, 10.0)
    assert row.avg_rate == pytest.approx(23.333333, abs=1e-6)
    assert row.stddev_rate == pytest.approx(15.275252, abs=1e-6)


def test_rate_summary_trims_last_nonzero_with_three_zeros(spark):
    row = metrics.rate_summary(series(spark, [10, 20, 40, 0, 0, 0]), 4).first()
    assert row.n_batches == 2
    assert row.avg_rate == pytest.approx(15.0)


@pytest.mark.parametrize("rates", [[], [5], [0, 3, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6, 7, 0, 9]])
def test_rate_summary_matches_model(spark, rates):
    if not rates:
        df = spark.createDataFrame([], "batch_id bigint, rate double")
    else:
        df = series(spark, rates, first=100)
    row = metrics.rate_summary(df, 4).first()
    n, mx, mn, avg, sd = model.rate_summary(rates)
    assert row.n_batches == n
    for got, want in ((row.max_rate, mx), (row.min_rate, mn), (row.avg_rate, avg),
                      (row.stddev_rate, sd)):
        if want is None:
            assert got is None or math.isnan(got)
        else:
            assert got == pytest.approx(want)


def test_idle_detection(spark):
    got = [r.batch_id for r in
           metrics.idle_batches(series(spark, [10, 20, 40, 0, 0, 0, 0]), 3).collect()]
    assert sorted(got) == [5, 6]
    # fewer than four samples never count as idle
    assert metrics.idle_batches(series(spark, [0, 0, 0]), 3).count() == 0
    assert [r.batch_id for r in metrics.idle_batches(series(spark, [0, 0, 0, 0], 7), 3)
            .collect()] == [10]


def test_batch_counts_zero_fill_and_rates(spark):
    records = spark.createDataFrame([(3,), (3,), (5,), (9,)], "batch_id bigint")
    counts = metrics.batch_counts(spark, records)
    got = sorted((r.batch_id, r.n) for r in counts.collect())
    assert got == [(3, 2), (4, 0), (5, 1), (6, 0), (7, 0), (8, 0), (9, 1)]
    rates = metrics.batch_rates(counts, 2, 0).collect()
    assert {r.batch_id: r.rate for r in rates}[3] == 1.0
    assert {r.batch_id: str(r.batch_start) for r in rates}[3] == "1970-01-01 00:00:06"


def test_dense_ids_across_blocks(spark):
    src = spark.createDataFrame([(-5,), (13,)], "b bigint")
    got = sorted(r.b for r in metrics.dense_ids(spark, src, "b", block=4).collect())
    assert got == list(range(-5, 14))


def test_summary_line(spark):
    stats = metrics.rate_summary(series(spark, [10, 20, 40, 0, 0, 0, 0]), 4)
    line = metrics.summary_line(stats).first().line
    assert line == ("effective batch number: 3 max: 40.0 min: 10.0 average: 23.333333333333332 "
                    "stddev: 15.275252316519467 ")


def test_epoch_of_wall_clock_ignores_session_zone(spark):
    from tallyline.functions.time import epoch_micros
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.5' AS ts UNION ALL "
                       "SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.25'")
        got = [r.m for r in df.select(epoch_micros(df, "ts").alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1710037800500000, -750000]


def test_rate_summary_only_once_idle(spark):
    idle = metrics.rate_summary_when_idle(series(spark, [10, 20, 40, 0, 0, 0, 0])).collect()
    assert len(idle) == 1 and idle[0].n_batches == 3
    assert metrics.rate_summary_when_idle(series(spark, [10, 20, 40, 0, 0, 5])).count() == 0
    assert metrics.rate_summary_when_idle(series(spark, [0, 0, 0])).count() == 0


def test_metric_series_is_in_order_of_the_batches(spark, scratch):
    import datetime

    from tallyline.streaming.ledger import Ledger
    from tallyline.streaming.pipeline import METRICS_SCHEMA, read_metric_series

    at = datetime.datetime(2024, 1, 1)
    made = {"batch_id": None, "batch_start": at, "n": 1, "rate": 1.0}
    rows = [tuple({**made, "batch_id": k}.get(f.name) for f in METRICS_SCHEMA.fields) for k in range(40, 0, -1)]
    table = Ledger(spark, f"{scratch}/m")
    attempt, path = table.new_folder()
    spark.createDataFrame(rows, METRICS_SCHEMA).repartition(5).write.parquet(path)
    table.commit(1, 40, attempt)
    assert [r.batch_id for r in read_metric_series(spark, f"{scratch}/m").collect()] == list(range(1, 41))


def idle_model(ids, run=3):
    lo, hi = min(ids), max(ids)
    return [b for b in range(lo + run, hi + 1) if not any(b - k in ids for k in range(run))]


@pytest.mark.parametrize("ids", [[0], [0, 1, 9], [5, 6, 7], [0, 3, 7, 12, 13, 20], [-9, -2, 4]])
def test_idle_runs_equal_the_dense_form(spark, ids):
    counts = spark.createDataFrame([(b, 2) for b in ids], "batch_id bigint, n bigint")
    dense = metrics.batch_rates(metrics.batch_counts(spark, counts.select("batch_id")), 1)
    want = idle_model(set(ids))
    assert sorted(r.batch_id for r in metrics.idle_batches(dense).collect()) == want
    assert sorted(r.batch_id for r in metrics.idle_ids(counts).collect()) == want
    runs = metrics.idle_runs(counts).collect()
    assert sorted(b for r in runs for b in range(r["first"], r["last"] + 1)) == want


def test_gaps_at_the_edges_and_of_zero_rows(spark):
    rows = [(2, 0), (3, 0), (4, 5), (5, 0), (8, 1), (11, 0), (None, 4)]
    counts = spark.createDataFrame(rows, "batch_id bigint, n bigint")
    assert sorted(tuple(r) for r in metrics.gap_runs(counts).collect()) == [(2, 2), (5, 3), (9, 3)]
    nothing = spark.createDataFrame([(7, 0), (9, 0)], "batch_id bigint, n bigint")
    assert [tuple(r) for r in metrics.gap_runs(nothing).collect()] == [(7, 3)]
    assert metrics.gap_runs(counts.limit(0)).collect() == []
    assert metrics.idle_runs(counts.limit(0)).collect() == []


def test_one_wrong_timestamp_costs_one_row(spark):
    """A batch id 10^9 batches away: one more gap, the same summary, and no dense spine."""
    ids = [0, 1, 2, 9, 10]
    counts = spark.createDataFrame([(b, b + 1) for b in [*ids, 10**9 + 10**8]], "batch_id bigint, n bigint")
    assert sorted(tuple(r) for r in metrics.gap_runs(counts).collect()) == [(3, 6), (11, 10**9 + 10**8 - 11)]
    assert len(metrics.idle_runs(counts).collect()) == 2
    stats = metrics.rate_summary(metrics.batch_rates(counts, 1)).first()
    assert stats["n_batches"] == 5 and stats["max_rate"] == 11.0
    with pytest.raises(Exception, match="ids between"):
        metrics.batch_counts(spark, counts.select("batch_id")).count()


def test_samples_are_numbered_in_order(spark):
    ids = [40_000, 3, 17, 16_384, 16_383, -5, 90_000]
    out = metrics.numbered_samples(spark.createDataFrame([(i,) for i in ids], "batch_id bigint")).collect()
    assert {r.batch_id: r.position for r in out} == {b: k for k, b in enumerate(sorted(ids), 1)}


@pytest.mark.parametrize("size,slide,start", [(7, 3, 0), (5, 2, 1), (6, 4, 0), (4, 4, 2), (5, 1, 0)])
def test_windows_of_any_shape_equal_the_window_function(spark, size, slide, start):
    calls = spark.range(400).select(
        F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(90_000_000)) - F.lit(30_000_000)).alias("ts"),
        (F.col("id") % 3).cast("int").alias("contestant_number"))
    got = boards.sliding_window_counts(calls, "ts", size, slide, start_seconds=start)
    w = F.window("ts", f"{size} seconds", f"{slide} seconds", f"{start} seconds")
    want = calls.groupBy(w, "contestant_number").count()
    rows = lambda df, n: sorted((r[0], r[1], r["contestant_number"], r[n]) for r in df.collect())
    assert rows(got, "n") == rows(want.select("window.start", "window.end", "contestant_number", "count"), "count")
    # the calls are counted before they are copied to windows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
