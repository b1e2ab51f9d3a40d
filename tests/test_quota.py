import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import model
from fixtures import HOT_PHONE, sample_calls, to_df
from tallyline.operators import boards, quota


def ids(df):
    return sorted(r.vote_id for r in df.select("vote_id").collect())


@pytest.mark.parametrize("lines_per_batch,expected", [(1, 33), (10, 32), (40, 32)])
def test_batch_quota_sample(spark, lines_per_batch, expected):
    calls = sample_calls(lines_per_batch)
    got = ids(quota.batch_quota(to_df(spark, calls), 1, 6))
    assert len(got) == expected
    assert got == model.batch_quota(calls, 1, 6)


@pytest.mark.parametrize("lines_per_batch", [1, 10])
def test_arrival_quota_sample_is_batching_free(spark, lines_per_batch):
    calls = sample_calls(lines_per_batch)
    got = ids(quota.arrival_quota(to_df(spark, calls), 1, 6, order=("batch_id", "vote_id")))
    assert len(got) == 33
    assert got == model.arrival_quota(calls, 1, 6)


def test_join_form_equals_one_pass_form(spark):
    for lpb in (1, 3, 10):
        df = to_df(spark, sample_calls(lpb))
        for n in (1, 2, 3):
            assert ids(quota.batch_quota(df, n, 6)) == ids(quota.batch_quota_join(df, n, 6))


def test_hot_phone_fully_rejected_with_ten_line_batches(spark):
    calls = sample_calls(10)
    got = set(ids(quota.batch_quota(to_df(spark, calls), 1, 6)))
    hot = {c["vote_id"] for c in calls if c["phone_number"] == HOT_PHONE}
    assert not (got & hot)


def test_same_batch_fresh_phone(spark):
    calls = [
        {"vote_id": 1, "phone_number": 7, "contestant_number": 1, "timestamp": 0, "batch_id": 0},
        {"vote_id": 2, "phone_number": 7, "contestant_number": 2, "timestamp": 0, "batch_id": 0},
    ]
    df = to_df(spark, calls)
    assert ids(quota.batch_quota(df, 1, 6)) == []
    assert ids(quota.arrival_quota(df, 1, 6, order=("batch_id", "vote_id"))) == [1]


def test_invalid_contestant_spends_quota(spark):
    calls = [
        {"vote_id": 1, "phone_number": 7, "contestant_number": 999, "timestamp": 0, "batch_id": 0},
        {"vote_id": 2, "phone_number": 7, "contestant_number": 2, "timestamp": 0, "batch_id": 1},
    ]
    df = to_df(spark, calls)
    assert ids(quota.batch_quota(df, 1, 6)) == []
    assert ids(quota.arrival_quota(df, 1, 6, order=("batch_id", "vote_id"))) == []


def test_contestant_check_is_upper_bound_only(spark):
    calls = [{"vote_id": i, "phone_number": 100 + i, "contestant_number": c, "timestamp": 0,
              "batch_id": 0} for i, c in enumerate([0, -1, 6, 7])]
    df = to_df(spark, calls)
    assert ids(quota.valid_contestant(df, 6)) == [0, 1, 2]


def test_running_call_counts_sample(spark):
    calls = sample_calls(10)
    got = {r.vote_id: r.n for r in quota.running_call_counts(to_df(spark, calls)).collect()}
    assert got == model.running_counts(calls)


def test_allowed_phone_batches_sample(spark):
    calls = sample_calls(1)
    got = {(r.phone_number, r.batch_id) for r in
           quota.allowed_phone_batches(to_df(spark, calls), 2).collect()}
    counts = model.running_counts(calls)
    want = {(c["phone_number"], c["batch_id"]) for c in calls if counts[c["vote_id"]] <= 2}
    assert got == want


@pytest.mark.parametrize("lines_per_batch", [1, 10])
def test_leaderboard_sample(spark, lines_per_batch):
    calls = sample_calls(lines_per_batch)
    df = to_df(spark, calls)
    for accepted, want_ids in (
        (quota.batch_quota(df, 1, 6), model.batch_quota(calls, 1, 6)),
        (quota.arrival_quota(df, 1, 6, order=("batch_id", "vote_id")),
         model.arrival_quota(calls, 1, 6)),
    ):
        board = boards.leaderboard(accepted, 10).collect()
        want = model.totals(calls, want_ids)
        assert {r.contestant_number: r.total for r in board} == dict(want)
        totals = [r.total for r in board]
        assert totals == sorted(totals, reverse=True)


def test_window_counts_sample(spark):
    calls = sample_calls(10)
    df = to_df(spark, calls)
    accepted = quota.batch_quota(df, 1, 6)
    got = boards.sliding_window_counts(accepted, "ts", 2, 1).collect()
    want = model.window_counts(calls, model.batch_quota(calls, 1, 6), 2)
    # ts is in seconds = batch_id (plus sub-second offsets), so the window
    # starting at batch b has window_start at epoch second b.
    assert {(int(r.window_start.timestamp()), r.contestant_number): r.n for r in got} == dict(want)
    assert all((r.window_end - r.window_start).total_seconds() == 2 for r in got)


def test_window_counts_fallback_matches_builtin(spark):
    calls = sample_calls(3)
    df = quota.arrival_quota(to_df(spark, calls), 2, 6, order=("batch_id", "vote_id"))
    fast = {(r.window_start, r.contestant_number, r.n)
            for r in boards.sliding_window_counts(df, "ts", 4, 2).collect()}
    slow = {(r.window_start, r.contestant_number, r.n)
            for r in boards.sliding_window_counts(df, "ts", 3, 2).collect()}
    assert fast and slow
    from pyspark.sql import functions as F
    builtin = {(r.w.start, r.contestant_number, r.n) for r in
               df.groupBy(F.window("ts", "3 seconds", "2 seconds").alias("w"), "contestant_number")
               .agg(F.count("*").alias("n")).collect()}
    assert slow == builtin
    builtin4 = {(r.w.start, r.contestant_number, r.n) for r in
                df.groupBy(F.window("ts", "4 seconds", "2 seconds").alias("w"), "contestant_number")
                .agg(F.count("*").alias("n")).collect()}
    assert fast == builtin4


def test_totals_by_batch_sample(spark):
    calls = sample_calls(10)
    accepted_ids = model.arrival_quota(calls, 1, 6)
    got = {(r.contestant_number, r.batch_id): r.total for r in
           boards.totals_by_batch(quota.arrival_quota(to_df(spark, calls), 1, 6,
                                                      order=("batch_id", "vote_id"))).collect()}
    acc = [c for c in calls if c["vote_id"] in set(accepted_ids)]
    want = {}
    for c in acc:
        key = (c["contestant_number"], c["batch_id"])
        want[key] = sum(1 for d in acc if d["contestant_number"] == c["contestant_number"]
                        and d["batch_id"] <= c["batch_id"])
    assert got == want


call_lists = st.lists(
    st.tuples(st.integers(0, 5), st.integers(-1, 8), st.integers(0, 4)),
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=call_lists, max_votes=st.integers(1, 3))
def test_quotas_match_model(spark, rows, max_votes):
    calls = [{"vote_id": i, "phone_number": p, "contestant_number": c, "timestamp": 0,
              "batch_id": b} for i, (p, c, b) in enumerate(rows)]
    df = to_df(spark, calls)
    a = ids(quota.batch_quota(df, max_votes, 6))
    b = ids(quota.arrival_quota(df, max_votes, 6, order=("batch_id", "vote_id")))
    assert a == model.batch_quota(calls, max_votes, 6)
    assert b == model.arrival_quota(calls, max_votes, 6)
    assert ids(quota.batch_quota_join(df, max_votes, 6)) == a
    per_phone = Counter(c["phone_number"] for c in calls if c["vote_id"] in set(b))
    assert all(v <= max_votes for v in per_phone.values())
    # arrival order respects batch order here, so the batch rule accepts a subset
    assert set(a) <= set(b)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 40), st.integers(1, 5)),
                     min_size=1, max_size=30, unique_by=lambda t: (t[0], t[1])),
       block=st.integers(1, 7))
def test_blocked_running_total_matches_model(spark, rows, block):
    from tallyline.operators.cumulative import running_total
    df = spark.createDataFrame(rows, "k int, b bigint, v bigint")
    got = {(r.k, r.b): r.t for r in running_total(df, ["k"], "b", "v", "t", block).collect()}
    want = {(k, b): sum(v2 for k2, b2, v2 in rows if k2 == k and b2 <= b) for k, b, _ in rows}
    assert got == want


@pytest.mark.parametrize("lines_per_batch", [1, 10])
def test_leaderboard_history_sample(spark, lines_per_batch):
    calls = sample_calls(lines_per_batch)
    accepted_ids = set(model.arrival_quota(calls, 1, 6))
    acc = [c for c in calls if c["vote_id"] in accepted_ids]
    got = {(r.batch_id, r.rank): (r.contestant_number, r.total) for r in
           boards.leaderboard_history(quota.arrival_quota(to_df(spark, calls), 1, 6,
                                                          order=("batch_id", "vote_id")), 3)
           .collect()}
    want = {}
    first = min(c["batch_id"] for c in acc)
    last = max(c["batch_id"] for c in acc)
    for b in range(first, last + 1):
        totals = Counter(c["contestant_number"] for c in acc if c["batch_id"] <= b)
        board = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        for rank, (contestant, total) in enumerate(board, 1):
            want[(b, rank)] = (contestant, total)
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 40)), min_size=1, max_size=30,
                     unique_by=lambda t: t), block=st.integers(1, 7))
def test_next_in_order_and_explode_range(spark, rows, block):
    from pyspark.sql import functions as F
    from tallyline.operators.cumulative import explode_range, next_in_order
    df = spark.createDataFrame(rows, "k int, b bigint")
    got = {(r.k, r.b): r.nx for r in next_in_order(df, ["k"], "b", "nx", block).collect()}
    want = {(k, b): min([b2 for k2, b2 in rows if k2 == k and b2 > b], default=None)
            for k, b in rows}
    assert got == want
    spans = explode_range(df, F.col("b"), F.col("b") + F.col("k") * 3, "x", ["k", "b"], block)
    assert sorted((r.k, r.b, r.x) for r in spans.collect()) == \
        sorted((k, b, x) for k, b in rows for x in range(b, b + k * 3 + 1))


def test_null_phones_and_times_are_calls_like_any_other(spark):
    """The forms of the batch rule agree with each other and with plain counting."""
    rows = [(1, 5, 1, 0, 0), (2, None, 1, 0, 0), (3, None, 2, 0, 1), (4, 5, 3, 0, None), (5, 7, 1, 0, None),
            (6, None, 1, 0, 2), (7, 7, 2, 0, 3)]
    calls = spark.createDataFrame(rows, "vote_id bigint, phone_number bigint, contestant_number int, "
                                        "timestamp int, batch_id bigint")

    def after(vote, phone, batch):
        at = (batch is not None, batch or 0)
        return sum(1 for _, p, _, _, b in rows if p == phone and (b is not None, b or 0) <= at)

    want = {(v, b, after(v, p, b)) for v, p, _, _, b in rows}
    assert {tuple(r) for r in quota.running_call_counts(calls).collect()} == want
    allowed = sorted(v for v, _, n in want if n <= 2)
    for form in (quota.batch_quota, quota.batch_quota_join):
        assert sorted(r.vote_id for r in form(calls, 2, 6).collect()) == allowed


def test_a_quota_above_the_group_limit_is_refused(spark):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    calls = spark.createDataFrame([], "vote_id bigint, phone_number bigint, contestant_number int, ts bigint, batch_id bigint")
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        with pytest.raises(ValueError, match="windowGroupLimitThreshold"):
            quota.arrival_quota(calls, 11, 6)
    finally:
        spark.conf.set(key, before)


def test_last_write_of_a_repeated_key_does_not_depend_on_order(spark):
    from tallyline.operators.kv import latest_per_key

    writes = [("a", "1 5 2 0", 9), ("a", "1 6 2 0", 9), ("a", "1 7 2 0", 8), ("b", "2 5 2 0", 1)]
    for some in (writes, writes[::-1]):
        df = spark.createDataFrame(some, "key string, value string, ts bigint")
        got = {r.key: r.value for r in latest_per_key(df, ("ts",)).collect()}
        assert got == {"a": "1 6 2 0", "b": "2 5 2 0"}


@pytest.mark.parametrize("max_votes", [1, 3, 10, 40])
def test_counts_cut_off_as_ranks_do(spark, monkeypatch, max_votes):
    """A large quota's path on small quotas: hot phone, ties in time, no phone, no batch, no time."""
    rng = random.Random(max_votes)
    calls = []
    for i in range(600):
        phone = rng.choice([7, 7, 7, None, rng.randrange(20)])
        batch = rng.choice([None, 3, 3, 3, rng.randrange(9)])
        at = rng.choice([None, 1000, 1000, rng.randrange(3600)])
        calls.append((i, phone, 1 + i % 7, 0, batch, at))
    rows = spark.createDataFrame(calls, "vote_id bigint, phone_number bigint, contestant_number int, "
                                        "timestamp int, batch_id bigint, at bigint")
    df = rows.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    first = lambda v: (v is not None, v or 0)
    used, want = Counter(), []
    for c in sorted(calls, key=lambda c: (first(c[4]), first(c[5]), c[0])):
        used[c[1]] += 1
        if used[c[1]] <= max_votes and c[2] <= 6:
            want.append(c[0])
    monkeypatch.setattr(quota, "RANKED_QUOTA", 0)
    assert ids(quota.arrival_quota(df, max_votes, 6)) == sorted(want)
    by_count = ids(quota.batch_quota(df, max_votes, 6)), sorted(map(str, quota.allowed_phone_batches(df, max_votes).collect()))
    monkeypatch.setattr(quota, "RANKED_QUOTA", 128)
    assert by_count == (ids(quota.batch_quota(df, max_votes, 6)),
                        sorted(map(str, quota.allowed_phone_batches(df, max_votes).collect())))
