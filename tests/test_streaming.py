"""Streaming forms against the batch forms on the same input."""

import datetime
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

import model
from fixtures import HOT_PHONE, sample_calls, sample_lines
from tallyline import streaming as S
from tallyline.operators import boards, quota, words
from tallyline.sources.calls import call_view
from tallyline.sources.tables import read_table
from tallyline.sources.text import document_lines
from tallyline.streaming.replay import run_replay, stage_events

DATA = "/root/testdata/sf0.01"
ONCE = {"availableNow": True}


def stage_text(folder, chunks, start=0):
    os.makedirs(folder, exist_ok=True)
    for k, lines in enumerate(chunks, start):
        path = os.path.join(folder, f"part-{k:04d}.txt")
        with open(path, "w") as fh:
            fh.write("".join(line + "\n" for line in lines))
        os.utime(path, (1_000_000 + k, 1_000_000 + k))


@pytest.fixture(scope="module")
def event_chunks(spark, tmp_path_factory):
    """The events table cut into ten 3-day parquet files, in time order."""
    staging = os.path.join(str(tmp_path_factory.mktemp("staging")), "chunks")
    events = read_table(spark, DATA, "events")
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200 * 10**6))
                  / F.lit(86400 * 10**6))
    (events.withColumn("chunk", F.least(F.floor(day / 3), F.lit(9)).cast("int"))
     .repartition(1, "chunk").write.partitionBy("chunk").parquet(staging))
    files = []
    for k in range(10):
        [part] = glob.glob(os.path.join(staging, f"chunk={k}", "*.parquet"))
        files.append(part)
    return files


def place(files, folder, ks):
    os.makedirs(folder, exist_ok=True)
    for k in ks:
        dst = os.path.join(folder, f"events-{k:02d}.parquet")
        shutil.copy(files[k], dst)
        os.utime(dst, (2_000_000 + k, 2_000_000 + k))


def batch_view_by_chunk(spark):
    view = call_view(read_table(spark, DATA, "events"))
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200 * 10**6))
                  / F.lit(86400 * 10**6))
    return view.withColumn("batch_id", F.least(F.floor(day / 3), F.lit(9)).cast("bigint"))


def vote_ids(df):
    return sorted(r.vote_id for r in df.select("vote_id").collect())


@pytest.mark.parametrize("variant,expected,ttl", [("batch", 32, None), ("arrival", 33, None),
                                                  ("arrival", 33, 3_600_000)])
def test_line_stream_sample(spark, scratch, variant, expected, ttl):
    src = os.path.join(scratch, "in")
    lines = sample_lines()
    stage_text(src, [lines[i:i + 10] for i in range(0, 40, 10)])
    calls = S.call_line_stream(spark, src, max_files_per_trigger=1)
    out = os.path.join(scratch, "accepted")
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    if ttl:
        # with a TTL, no-data batches keep evicting state and a run-once
        # query would not finish
        spark.conf.set(key, "false")
    try:
        S.start_acceptance(S.accept_calls(calls, variant, 1, 6, state_ttl_ms=ttl), out,
                           os.path.join(scratch, "ck"), ONCE).awaitTermination()
    finally:
        spark.conf.set(key, "true")
    acc = S.read_accepted(spark, out)
    got = vote_ids(acc)
    fixture = sample_calls(10)
    want = (model.batch_quota(fixture, 1, 6) if variant == "batch"
            else model.arrival_quota(fixture, 1, 6))
    assert len(got) == expected and got == want
    assert sorted(r.batch_id for r in acc.select("batch_id").distinct().collect()) == [0, 1, 2, 3]

    assert follow(spark, scratch, out) == dict(model.totals(fixture, want))


@pytest.mark.parametrize("variant", ["arrival", "batch"])
def test_event_stream_equals_batch_with_restart(spark, scratch, event_chunks, variant):
    src = os.path.join(scratch, "events")
    out = os.path.join(scratch, "accepted")
    ck = os.path.join(scratch, "ck")

    def run():
        calls = S.event_call_stream(spark, src, max_files_per_trigger=1)
        q = S.start_acceptance(S.accept_calls(calls, variant, 20, 6), out, ck, ONCE)
        q.awaitTermination()
        return max(p["batchId"] for p in q.recentProgress)

    place(event_chunks, src, range(5))
    assert run() == 4
    place(event_chunks, src, range(5, 10))
    assert run() == 9
    got = vote_ids(S.read_accepted(spark, out))
    view = batch_view_by_chunk(spark)
    if variant == "arrival":
        want = vote_ids(quota.arrival_quota(view, 20, 6))
        assert len(want) == 2243
    else:
        want = vote_ids(quota.batch_quota(view, 20, 6))
    assert got == want
    if variant == "batch":
        # micro-batch ids are the chunk ids, so the batch form agrees per batch
        per_batch = {(r.vote_id, r.batch_id) for r in
                     S.read_accepted(spark, out).select("vote_id", "batch_id").collect()}
        assert per_batch == {(r.vote_id, r.batch_id) for r in
                             quota.batch_quota(view, 20, 6).select("vote_id", "batch_id").collect()}


def window_rows(df):
    return sorted((r.window_start, r.contestant_number, r.n) for r in df.collect())


@pytest.mark.parametrize("size,slide", [(5, 1), (5, 2), (7, 3), (1, 2)])
def test_windows_that_follow_equal_the_batch_form(spark, scratch, event_chunks, size, slide):
    src = os.path.join(scratch, "events")
    acc_dir = os.path.join(scratch, "accepted")
    place(event_chunks, src, range(10))
    hour = 3_600_000
    windows = S.WindowCounts(spark, acc_dir, os.path.join(scratch, "windows"), size * hour, slide * hour)

    def run(**trigger):
        calls = S.event_call_stream(spark, src, max_files_per_trigger=4)
        S.start_acceptance(S.accept_calls(calls, "arrival", 20, 6), acc_dir,
                           os.path.join(scratch, "ck"), ONCE).awaitTermination()
        S.start_follower(spark, acc_dir, windows.step, os.path.join(scratch, "ck_w"), ONCE).awaitTermination()

    run()
    written = windows.read().count()
    run()
    assert windows.read().count() == written  # nothing new, nothing written again
    windows.step(flush=True)
    windows.step(flush=True)
    batch = boards.sliding_window_counts(S.read_accepted(spark, acc_dir), "ts", size * 3600, slide * 3600)
    assert window_rows(windows.read()) == window_rows(batch)
    assert size < slide or windows.read().count() > written  # the last windows end with the flush


def test_batch_metrics_stream(spark, scratch):
    src = os.path.join(scratch, "in")
    lines = sample_lines()
    stage_text(src, [lines[0:10], lines[10:15], lines[15:40]])
    records = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src)
    met = os.path.join(scratch, "metrics")
    S.start_batch_metrics(records, met, os.path.join(scratch, "ck"), 1000, ONCE).awaitTermination()
    rows = sorted((r.batch_id, r.n, r.rate) for r in S.read_metric_series(spark, met).collect())
    assert rows == [(0, 10, 10.0), (1, 5, 5.0), (2, 25, 25.0)]
    by_time = S.metric_series_by_time(spark, met, 3600).collect()
    assert sum(r.n for r in by_time) == 40


def test_word_count_stream(spark, scratch):
    src = os.path.join(scratch, "in")
    chunks = [["a b  ", "  a"], ["", "   ", "a  b"], ["b b b"]]
    stage_text(src, chunks)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src)
    out = os.path.join(scratch, "words")
    shown = []
    S.start_word_counts(lines, out, os.path.join(scratch, "ck"), ONCE, show=shown.append).awaitTermination()
    got = {(r.batch_id, r.word, r.n) for r in S.read_word_counts(spark, out).collect()}
    assert len(shown) == sum(min(10, len(c)) for c in (["a", "b", ""], ["", "a", "b"], ["b"])) and "b 3" in shown
    want = set()
    for k, chunk in enumerate(chunks):
        counts = {}
        for line in chunk:
            for w in model.java_space_split(line):
                counts[w] = counts.get(w, 0) + 1
        want |= {(k, w, n) for w, n in counts.items()}
    assert got == want


def test_write_batch_runs_a_replay_and_keeps_what_readers_know(spark, scratch):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    df = spark.range(3).mapInArrow(count, "id bigint")
    assert S.write_batch(df, scratch, 7)
    files = sorted(glob.glob(os.path.join(scratch, "*", "*", "*")))
    assert not S.write_batch(df, scratch, 7)
    assert ran.value == 6
    assert sorted(glob.glob(os.path.join(scratch, "*", "*", "*"))) == files
    rows = S.Ledger(spark, scratch).read("id bigint, batch_id bigint")
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 7), (1, 7), (2, 7)]


def accept_sample(spark, src, out, ck):
    calls = S.call_line_stream(spark, src, max_files_per_trigger=1)
    S.start_acceptance(S.accept_calls(calls, "batch", 1, 6), out, ck, ONCE).awaitTermination()


def follow(spark, scratch, out):
    board = S.Leaderboard(spark, out, os.path.join(scratch, "board"))
    S.start_follower(spark, out, board.step, os.path.join(scratch, "ck_board"), ONCE).awaitTermination()
    table = board.read()
    last = table.agg(F.max("batch_id")).first()[0]
    return {r.contestant_number: r.total for r in table.where(F.col("batch_id") == last).collect()}


@pytest.mark.parametrize("partial", [False, True])
def test_replay_after_a_crash_changes_nothing_downstream(spark, scratch, partial):
    """The process dies after a batch was committed and before the stream recorded
    it; or while the batch's folder was being written."""
    src, out, ck = (os.path.join(scratch, n) for n in ("in", "accepted", "ck"))
    lines = sample_lines()
    stage_text(src, [lines[i:i + 10] for i in range(0, 40, 10)])
    accept_sample(spark, src, out, ck)
    want = model.batch_quota(sample_calls(10), 1, 6)
    totals = dict(model.totals(sample_calls(10), want))
    if not partial:
        assert follow(spark, scratch, out) == totals
    last = max(int(f) for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        os.remove(os.path.join(ck, "commits", f))
    if partial:  # the data is there, in part, and no commit
        for f in glob.glob(os.path.join(out, "commits", f"*{last:012d}-*")):
            os.remove(f)
        assert len(vote_ids(S.read_accepted(spark, out))) < len(want)
    accept_sample(spark, src, out, ck)
    accept_sample(spark, src, out, ck)
    assert vote_ids(S.read_accepted(spark, out)) == want
    assert follow(spark, scratch, out) == totals


def test_a_new_checkpoint_over_an_old_table_fails_and_loses_nothing(spark, scratch):
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "accepted")
    lines = sample_lines()
    stage_text(src, [lines[:20], lines[20:]])
    accept_sample(spark, src, out, os.path.join(scratch, "ck"))
    before = vote_ids(S.read_accepted(spark, out))
    with pytest.raises(Exception, match="needs a new output folder"):
        accept_sample(spark, src, out, os.path.join(scratch, "ck_new"))
    assert vote_ids(S.read_accepted(spark, out)) == before
    assert os.listdir(os.path.join(scratch, "ck_new", "commits")) == []


def test_batch_word_counts_of_lines_table(spark):
    docs = spark.createDataFrame([(0, "x y\nx"), (0, "y"), (1, "")], "batch_id bigint, text string")
    got = {(r.batch_id, r.word, r.n) for r in
           words.word_counts(document_lines(docs, keep=("batch_id",))).collect()}
    assert got == {(0, "x", 2), (0, "y", 2)}


def test_lenient_line_stream_routes_rejects(spark, scratch):
    src = os.path.join(scratch, "in")
    stage_text(src, [["1 5 3 0", "oops", "2 5 7 0"], ["3 6 1 0 extra", "4 x 1 0"]])
    acc_dir, rej_dir = os.path.join(scratch, "accepted"), os.path.join(scratch, "rejects")
    calls = S.call_line_stream(spark, src, 1, strict=False)
    S.start_acceptance(S.accept_calls(calls, "arrival", 1, 6), acc_dir,
                       os.path.join(scratch, "ck"), ONCE).awaitTermination()
    rejects = S.rejected_line_stream(spark, src, 1)
    q = (rejects.writeStream.format("parquet").option("path", rej_dir)
         .option("checkpointLocation", os.path.join(scratch, "ck_rej")).trigger(availableNow=True)
         .start())
    q.awaitTermination()
    assert vote_ids(S.read_accepted(spark, acc_dir)) == [1, 3]
    assert sorted(r.value for r in spark.read.parquet(rej_dir).collect()) == ["4 x 1 0", "oops"]


@pytest.mark.parametrize("max_votes", [1, 2])
def test_vote_pipeline_once(spark, scratch, max_votes):
    from tallyline.operators.kv import kv_rows
    from tallyline.streaming.app import start_vote_pipeline
    src = os.path.join(scratch, "in")
    lines = sample_lines()
    stage_text(src, [lines[i:i + 10] for i in range(0, 40, 10)])
    printed = []
    pipe = start_vote_pipeline(spark, src, os.path.join(scratch, "out"), variant="batch",
                               max_votes=max_votes, once=True, max_files_per_trigger=1, show=printed.append)
    pipe.await_all()
    fixture = sample_calls(10)
    want = model.batch_quota(fixture, max_votes, 6)
    accepted = S.read_accepted(spark, os.path.join(pipe.root, "accepted"))
    assert vote_ids(accepted) == want
    board = S.Leaderboard(spark, os.path.join(pipe.root, "accepted"), os.path.join(pipe.root, "leaderboard")).read()
    last = board.agg(F.max("batch_id")).first()[0]
    final = {r.contestant_number: r.total for r in board.where(F.col("batch_id") == last).collect()}
    assert final == dict(model.totals(fixture, want))
    windows = S.WindowCounts(spark, os.path.join(pipe.root, "accepted"), os.path.join(pipe.root, "windows"), 5000, 1000)
    windows.step(flush=True)
    assert window_rows(windows.read()) == window_rows(boards.sliding_window_counts(accepted, "ts", 5, 1))
    recorded = sorted((r.batch_id, r.n) for r in
                      S.read_metric_series(spark, os.path.join(pipe.root, "metrics")).collect())
    assert recorded == [(0, 10), (1, 10), (2, 10), (3, 10)]
    votes = S.VoteStore(spark, os.path.join(pipe.root, "accepted"), os.path.join(pipe.root, "votes"))
    assert sorted(votes.read().collect()) == sorted(kv_rows(accepted).select("key", "value").collect())
    # the lines of each batch: its records and rate, and the board
    assert printed[:4] == ["records: 10 rate: 10.0"] * 4
    assert f"{max(final.values())} {min(c for c in final if final[c] == max(final.values()))}" in printed


def test_vote_pipeline_prints_from_the_command_line(spark, scratch, capsys):
    from tallyline.streaming import app
    src = os.path.join(scratch, "in")
    stage_text(src, [sample_lines()])
    app.main(["votes", src, "--variant", "arrival", "--out", os.path.join(scratch, "out"), "--once", "--print"])
    lines = capsys.readouterr().out.splitlines()
    assert "records: 40 rate: 40.0" in lines
    want = model.totals(sample_calls(), model.arrival_quota(sample_calls(), 1, 6))
    assert [f"{n} {c}" for c, n in sorted(want.items(), key=lambda x: (-x[1], x[0]))] == lines[1:1 + len(want)]
    app.main(["words", src, "--out", os.path.join(scratch, "words"), "--once", "--print"])
    assert len(capsys.readouterr().out.splitlines()) == 10


@pytest.mark.parametrize("variant", ["batch", "arrival"])
def test_single_calls_without_python_workers(spark, scratch, variant):
    """A quota of one as an aggregate: equal to the model over batches and a restart."""
    src, out, ck = (os.path.join(scratch, n) for n in ("in", "accepted", "ck"))
    lines = sample_lines()
    plans = []

    def run():
        calls = S.call_line_stream(spark, src, max_files_per_trigger=1)
        q = S.start_acceptance(S.accept_single_calls(calls, variant, 6), out, ck, ONCE, mode="update")
        q.awaitTermination()
        plans.append(q._jsq.explainInternal(True))

    stage_text(src, [lines[:10], lines[10:20]])
    run()
    stage_text(src, [lines[20:30], lines[30:], [f"90 {HOT_PHONE} 1 0", "91 1 1 0", "92 1 2 0", "93 1 9 0"]], 2)
    run()
    fixture = sample_calls(10)
    want = (model.batch_quota(fixture, 1, 6) if variant == "batch" else model.arrival_quota(fixture, 1, 6))
    assert vote_ids(S.read_accepted(spark, out)) == sorted(want + ([91] if variant == "arrival" else []))
    assert not any("Python" in p or "Arrow" in p for p in plans)
    with pytest.raises(ValueError):
        S.accept_single_calls(spark.range(1), "other", 6)


@pytest.mark.parametrize("variant", ["batch", "arrival"])
@pytest.mark.parametrize("pretrim", [True, False])
def test_hot_phone_in_one_micro_batch(spark, scratch, variant, pretrim):
    calls = []
    for i in range(120):
        phone = 77 if i % 3 else 1000 + i          # phone 77 places two thirds of the calls
        calls.append({"vote_id": i, "phone_number": phone, "contestant_number": 1 + i % 7,
                      "timestamp": 0, "batch_id": i // 60})
    src = os.path.join(scratch, "in")
    stage_text(src, [[f"{c['vote_id']} {c['phone_number']} {c['contestant_number']} 0"
                      for c in calls if c["batch_id"] == b] for b in (0, 1)])
    out = os.path.join(scratch, "accepted")
    stream = S.call_line_stream(spark, src, 1).repartition(3)   # several map tasks per batch
    S.start_acceptance(S.accept_calls(stream, variant, 5, 6, order=("ts", "vote_id"),
                                      pretrim=pretrim),
                       out, os.path.join(scratch, "ck"), ONCE).awaitTermination()
    want = (model.batch_quota(calls, 5, 6) if variant == "batch"
            else model.arrival_quota(calls, 5, 6))
    assert vote_ids(S.read_accepted(spark, out)) == want


@pytest.mark.parametrize("variant", ["batch", "arrival"])
def test_trimming_keeps_calls_without_phone_and_large_numbers(spark, variant):
    big = 2**60 + 1
    rows = [(1, big, 1, 0, None), (2, None, 1, 0, None), (3, None, 2, 0, None), (4, big, 3, 0, None),
            (5, None, 1, 0, None), (6, 7, 1, 0, None)]
    calls = spark.createDataFrame(rows, S.CALL_STREAM_SCHEMA).coalesce(1)
    schema = S.TRIMMED_BATCH_SCHEMA if variant == "batch" else S.CALL_STREAM_SCHEMA
    kept = calls.mapInArrow(S.trim_calls(variant, 1), schema).collect()
    assert {(r.vote_id, r.phone_number) for r in kept if r.vote_id} == {(1, big), (2, None), (6, 7)}
    if variant == "batch":
        assert {(r.phone_number, r._calls) for r in kept if not r.vote_id} == {(big, 1), (None, 2)}


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_task_passes_few_calls_of_a_phone_whatever_its_chunks(spark, shuffled):
    """Chunks of 100 calls: the limit holds over a task, not over a chunk."""
    import random
    import pyarrow as pa

    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, 5 if i % 2 else i, 1, 0, at + datetime.timedelta(seconds=i)) for i in range(20_000)]
    if shuffled:
        random.Random(4).shuffle(rows)
    fields = [("vote_id", pa.int64()), ("phone_number", pa.int64()), ("contestant_number", pa.int32()),
              ("timestamp", pa.int32()), ("ts", pa.timestamp("us", "UTC"))]
    whole = pa.RecordBatch.from_pylist([dict(zip([n for n, _ in fields], r)) for r in rows], pa.schema(fields))
    chunks = [whole.slice(k, 100) for k in range(0, len(rows), 100)]
    out = pa.Table.from_batches(list(S.trim_calls("arrival", 30)(iter(chunks))))
    passed = sorted(v for v, p in zip(out["vote_id"].to_pylist(), out["phone_number"].to_pylist()) if p == 5)
    first = [i for i in range(20_000) if i % 2][:30]
    assert set(first) <= set(passed)
    assert len(passed) == 30 if not shuffled else len(passed) < 300
    assert out.num_rows - len(passed) == 10_000
    out = pa.Table.from_batches(list(S.trim_calls("batch", 30)(iter(chunks))))
    own = [c for c, p in zip(out["_calls"].to_pylist(), out["phone_number"].to_pylist()) if p == 5]
    assert sorted(own) == [1] * 30 + [9970] and sum(out["_calls"].to_pylist()) == 20_000


@pytest.mark.parametrize("variant", ["batch", "arrival"])
def test_replay_of_events_without_phone_or_time(spark, variant):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, None, "vote", 0.0, '{"k": 1}'), (2, None, None, "vote", 0.0, '{"k": 2}'),
            (3, None, 5, "vote", 0.0, '{"k": 3}'), (4, at + datetime.timedelta(days=9), 5, "vote", 0.0, '{"k": 1}'),
            (5, at + datetime.timedelta(days=9), None, "vote", 0.0, '{"k": 1}')]
    events = spark.createDataFrame(rows, S.EVENTS_SCHEMA)
    replay = stage_events(events, 5 * 86_400, ("accepted",))
    assert len(replay.arrivals) == 3

    def begin():
        stream = S.event_call_stream(spark, replay.source)
        return S.start_acceptance(S.accept_calls(stream, variant, 2, 6), replay.table("accepted"),
                                  replay.checkpoint("accepted"), ONCE)

    run_replay(spark, replay, [begin])
    accepted = S.read_accepted(spark, replay.table("accepted")).select("batch_id", "vote_id").collect()
    # one micro-batch for no time, one for day 0, one for day 9; a quota of two
    assert {tuple(r) for r in accepted} == {(0, 2), (0, 3), (1, 1), (2, 4)}


def test_replay_of_an_empty_table(spark):
    replay = stage_events(spark.createDataFrame([], S.EVENTS_SCHEMA), 86_400, ("accepted", "metrics", "windows"))
    run_replay(spark, replay, [])
    assert replay.arrivals == ()
    assert S.read_accepted(spark, replay.table("accepted")).count() == 0
    assert S.read_metric_series(spark, replay.table("metrics")).count() == 0
    assert S.WindowCounts(spark, replay.table("accepted"), replay.table("windows"), 5000, 1000).read().count() == 0


def test_idle_batches_are_counted_by_a_clock(spark, scratch):
    """Ticks without calls: the micro-batch runs, and records 0 under its own id."""
    src, ticks = os.path.join(scratch, "in"), os.path.join(scratch, "ticks")
    out, met = os.path.join(scratch, "accepted"), os.path.join(scratch, "metrics")
    lines = sample_lines()
    shown = []
    for k, part in enumerate([lines[:10], [], lines[10:25], [], [], lines[25:]]):
        stage_text(src, [part] if part else [], k)
        stage_text(ticks, [["tick"]], k)
        calls = S.counted(S.call_line_stream(spark, src), spark.readStream.text(ticks))
        S.start_acceptance(S.accept_calls(calls, "arrival", 1, 6), out, os.path.join(scratch, "ck"), ONCE,
                           metrics_dir=met, batch_ms=500, show=shown.append).awaitTermination()
    rows = [(r.batch_id, r.n, r.rate) for r in S.read_metric_series(spark, met).collect()]
    assert rows == [(0, 10, 20.0), (1, 0, 0.0), (2, 15, 30.0), (3, 0, 0.0), (4, 0, 0.0), (5, 15, 30.0)]
    assert shown == [f"records: {n} rate: {rate}" for _, n, rate in rows]
    assert vote_ids(S.read_accepted(spark, out)) == model.arrival_quota(sample_calls(), 1, 6)
    # metric batches are those of the accepted table, and a replayed one stays
    assert {c.first for c in S.Ledger(spark, out).commits()} == set(range(6))


def test_live_windows_end_by_the_clock(spark, scratch):
    """Without new calls the clock ends windows, and panes of the past are dropped."""
    table, out = S.Ledger(spark, os.path.join(scratch, "accepted")), os.path.join(scratch, "windows")
    windows = S.WindowCounts(spark, table.table, out, 3000, 1000)
    second = 1_000_000
    held, every = [], []
    for k in range(12):
        if k not in (5, 6, 7, 8, 9):  # five seconds without calls
            rows = [(100 * k + i, i, 1 + i % 2, 0, datetime.datetime.fromtimestamp(1000 + k)) for i in range(3)]
            every += rows
            table.append(spark.createDataFrame(rows, S.CALL_STREAM_SCHEMA), k)
        windows.step((1000 + k) * second + 500_000)
        held.append(windows.panes.read().count())
    assert max(held) <= 2 * 5  # the panes of a window and of the batches just read
    before = windows.read().count()
    windows.step(1100 * second)
    assert windows.read().count() > before
    windows.step(1200 * second)
    batch = boards.sliding_window_counts(spark.createDataFrame(every, S.CALL_STREAM_SCHEMA), "ts", 3, 1)
    assert window_rows(windows.read()) == window_rows(batch)
