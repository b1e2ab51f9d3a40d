import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixtures import sample_calls, sample_lines
from tallyline.sources.calls import call_lines, parse_calls, parse_calls_lenient
from tallyline.operators import kv


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_parse_sample_round_trip(spark):
    got = parse_calls(lines_df(spark, sample_lines())).collect()
    want = sample_calls()
    assert [(r.vote_id, r.phone_number, r.contestant_number, r.timestamp) for r in got] == \
        [(c["vote_id"], c["phone_number"], c["contestant_number"], c["timestamp"]) for c in want]
    assert dict(parse_calls(lines_df(spark, ["1 2 3 4"])).dtypes) == {
        "vote_id": "bigint", "phone_number": "bigint", "contestant_number": "int",
        "timestamp": "int"}


def test_ten_digit_phone_and_extra_fields(spark):
    got = parse_calls(lines_df(spark, ["20000001 5550123456 3 0 extra more"])).first()
    assert (got.vote_id, got.phone_number, got.contestant_number, got.timestamp) == \
        (20000001, 5550123456, 3, 0)


@pytest.mark.parametrize("bad", ["1 2 3", "1 x 3 4", "1  2 3 4", "1 2 3 99999999999", ""])
def test_strict_parse_fails_on_malformed(spark, bad):
    with pytest.raises(PySparkException):
        parse_calls(lines_df(spark, ["1 2 3 4", bad])).collect()


def test_lenient_parse_routes_rejects(spark):
    calls, rejects = parse_calls_lenient(lines_df(spark, ["1 2 3 4", "1 2 3", "a b c d", "5 6 7 8 9"]))
    assert sorted(r.vote_id for r in calls.collect()) == [1, 5]
    assert sorted(r.value for r in rejects.collect()) == ["1 2 3", "a b c d"]


def test_render_then_parse(spark):
    df = spark.createDataFrame([(1, 5550001, 0, -3)], "vote_id bigint, phone_number bigint, "
                               "contestant_number int, timestamp int")
    line = call_lines(df).first().value
    assert line == "1 5550001 0 -3"
    back = parse_calls(call_lines(df)).first()
    assert tuple(back) == (1, 5550001, 0, -3)


def test_kv_latest_per_key(spark):
    df = spark.createDataFrame(
        [(1, 9, 1, 0, 10), (2, 9, 2, 0, 20), (3, 8, 3, 0, 5), (4, 9, 4, 0, 20)],
        "vote_id bigint, phone_number bigint, contestant_number int, timestamp int, ts bigint")
    store = kv.latest_per_key(kv.kv_rows(df, key="phone_number"))
    assert {r.key: r.value for r in store.collect()} == {"9": "4 9 4 0", "8": "3 8 3 0"}
    by_vote = kv.latest_per_key(kv.kv_rows(df.where(F.col("vote_id") < 3), key="vote_id"))
    assert {r.key: r.value for r in by_vote.collect()} == {"1": "1 9 1 0", "2": "2 9 2 0"}


def test_render_forms(spark):
    from tallyline.functions.calls import render_call_debug, render_call_line
    df = spark.createDataFrame([(20000001, 5550123456, 3, 0)], "v bigint, p bigint, c int, t int")
    row = df.select(render_call_line(*[F.col(c) for c in "vpct"]).alias("line"),
                    render_call_debug(*[F.col(c) for c in "vpct"]).alias("debug")).first()
    assert row.line == "20000001 5550123456 3 0\n"
    assert row.debug == "call : 20000001-5550123456-3-0"
