"""Plan shapes that the scale design depends on, checked on the real tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import model
from tallyline.operators import quota
from tallyline.plans import QUERIES as PLANNED
from tallyline.sources.calls import call_view
from tallyline.sources.tables import read_table

DATA = "/root/testdata/sf0.01"
Q = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial_plan_lines(df):
    text = plan(df)
    body = text.split("== Initial Plan ==")[-1] if "Initial Plan" in text else text
    return [line for line in body.splitlines() if line.strip()]


def index_of(lines, pattern):
    for i, line in enumerate(lines):
        if re.search(pattern, line):
            return i
    raise AssertionError(f"{pattern!r} not in plan:\n" + "\n".join(lines))


@pytest.mark.parametrize("name", ["arrival_quota", "batch_quota", "allowed_phones"])
def test_group_limit_runs_before_the_shuffle(spark, name):
    lines = initial_plan_lines(Q[name](spark, DATA))
    final = index_of(lines, r"WindowGroupLimit .*Final")
    exchange = index_of(lines, r"Exchange hashpartitioning\(phone_number")
    partial = index_of(lines, r"WindowGroupLimit .*Partial")
    assert final < exchange < partial  # tree printed top-down: partial is below the shuffle


def test_batch_quota_is_one_scan_no_join(spark):
    text = plan(Q["batch_quota"](spark, DATA))
    assert "Join" not in text
    assert text.count("FileScan parquet") == 1


def test_pruned_scans(spark):
    text = plan(Q["allowed_phones"](spark, DATA))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    text = plan(Q["word_counts"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_no_python_in_batch_plans(spark):
    for name in PLANNED:
        text = plan(Q[name](spark, DATA))
        assert "EvalPython" not in text and "FlatMapGroupsInPandas" not in text, name


def test_partial_aggregation_before_shuffles(spark):
    for name in ("leaderboard", "word_counts", "vote_kv_latest", "window_contestant_counts"):
        assert "partial_" in plan(Q[name](spark, DATA)), name
    assert "TakeOrderedAndProject" in plan(Q["leaderboard"](spark, DATA))


def test_window_fan_out_follows_aggregation(spark):
    lines = initial_plan_lines(Q["window_contestant_counts"](spark, DATA))
    generate = index_of(lines, r"Generate explode")
    first_agg_below = index_of(lines[generate:], r"HashAggregate") + generate
    scan = index_of(lines, r"FileScan parquet")
    assert generate < first_agg_below < scan


def test_metric_queries_read_materialized_counts(spark):
    for name in ("rate_stats", "idle_batches", "batch_rate"):
        df = Q[name](spark, DATA)
        df.collect()
        assert "events.parquet" not in plan(df), name


def test_hot_phone_with_a_third_of_all_calls(spark):
    """One phone places a third of all calls: both rules still match the
    brute-force model, and the plan keeps the partial limit."""
    view = call_view(read_table(spark, DATA, "events"))
    hot = view.withColumn("phone_number",
                          F.when(F.col("vote_id") % 3 == 0, F.lit(999_999_999_9))
                          .otherwise(F.col("phone_number")))
    rows = [r.asDict() for r in hot.select("vote_id", "phone_number", "contestant_number",
                                            "batch_id", "ts").collect()]
    a = sorted(r.vote_id for r in quota.batch_quota(hot, 20, 6).select("vote_id").collect())
    b = sorted(r.vote_id for r in quota.arrival_quota(hot, 20, 6).select("vote_id").collect())
    assert a == model.batch_quota(rows, 20, 6)
    assert b == model.arrival_quota(rows, 20, 6, order=("ts", "vote_id"))
    assert "Partial" in plan(quota.arrival_quota(hot, 20, 6))


@pytest.mark.parametrize("max_votes", [1000, 5000])
def test_large_quotas_keep_the_partial_limit(spark, monkeypatch, max_votes):
    """Ranked quotas, as they are taken where calls have no batch."""
    view = call_view(read_table(spark, "/root/testdata/sf0.001", "events"))
    by_count = quota.arrival_quota(view, max_votes, 6)
    # all that is ranked has first been cut down by counts
    assert by_count.count() == quota.valid_contestant(view, 6).count()
    monkeypatch.setattr(quota, "RANKED_QUOTA", 1 << 30)
    for df in (quota.batch_quota(view, max_votes, 6), quota.arrival_quota(view, max_votes, 6)):
        lines = initial_plan_lines(df)
        assert index_of(lines, r"Exchange hashpartitioning\(phone_number") < \
            index_of(lines, r"WindowGroupLimit .*Partial")
    # every phone at sf0.001 places fewer than 1000 calls: all valid calls pass
    assert quota.arrival_quota(view, max_votes, 6).count() == \
        quota.valid_contestant(view, 6).count()
