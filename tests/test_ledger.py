"""Committed batches and the keyed store: lost attempts, merges, bounded files, write order."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyline import streaming as S
from tallyline.operators import metrics
from tallyline.streaming import ledger, store
from tallyline.streaming.follow import merge_moments

ROWS = "v bigint, batch_id bigint"


def values(table, **limits):
    return sorted(tuple(r) for r in table.read(ROWS, **limits).collect())


def batch(spark, k):
    return spark.createDataFrame([(10 * k + i,) for i in range(k % 3)], "v bigint").coalesce(1)


class NoRename(ledger.Folder):
    """A folder of a store that cannot rename."""

    def move_to(self, target):
        raise AssertionError("nothing may be renamed")


def test_a_lost_attempt_is_never_read(spark, scratch, monkeypatch):
    monkeypatch.setattr(ledger, "Folder", NoRename)
    table = S.Ledger(spark, scratch)
    table.make()
    assert values(table) == [] and table.last() is None
    table.append(batch(spark, 2), 0)
    # an attempt that wrote its data, or part of it, and ended before the commit
    _, path = table.new_folder()
    batch(spark, 5).withColumn("batch_id", F.lit(1).cast("bigint")).write.parquet(path)
    assert values(table) == [(20, 0), (21, 0)] and not table.has(1)
    assert table.append(batch(spark, 4), 1) and not table.append(batch(spark, 5), 1)
    assert values(table) == [(20, 0), (21, 0), (40, 1)]
    # deleted once it is old enough, the committed ones are not
    assert table.vacuum(3600) == 0 and table.vacuum(0) == 1
    assert values(table) == [(20, 0), (21, 0), (40, 1)]


def test_merges_bound_files_and_keep_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 4)
    monkeypatch.setattr(ledger, "LEVELS", 2)
    table = S.Ledger(spark, scratch)
    want, most = [], 0
    for k in range(38):
        table.append(batch(spark, k), k, source=2 * k)
        want += [(10 * k + i, k) for i in range(k % 3)]
        if k % 4 == 3:
            table.compact()
            table.vacuum(0)
        most = max(most, len(glob.glob(os.path.join(scratch, "data", "*"))))
    assert values(table) == sorted(want)
    assert most <= 3 + 3 + 38 // 16 + 4  # of each level fewer than four, and the batches before a merge
    assert [(c.first, c.last) for c in table.commits()] == [(0, 15), (16, 31), (32, 35), (36, 36), (37, 37)]
    assert table.last().source == 74 and table.has(20) and not table.has(38)
    # ranges cut through merged folders
    assert values(table, after=9, upto=33) == sorted(w for w in want if 9 < w[1] <= 33)
    assert values(table, after=37) == []


def test_a_merge_that_was_lost_or_half_cleaned_changes_nothing(spark, scratch, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 4)
    table = S.Ledger(spark, scratch)
    for k in range(4):
        table.append(batch(spark, k + 1), k)
    want = values(table)
    kept = {n: table.folder("commits", n).read() for n in table.folder("commits").listed()}
    with monkeypatch.context() as m:
        m.setattr(S.Ledger, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.compact()
    assert values(table) == want and len(table.commits()) == 4
    assert table.compact() == 1 and table.compact() == 0
    assert values(table) == want and len(table.commits()) == 1 and len(table.all_commits()) == 5
    # some of the covered commits are gone, others not yet
    table.folder("commits", sorted(kept)[1]).delete()
    assert values(table) == want
    table.vacuum(0)
    assert values(table) == want and len(glob.glob(os.path.join(scratch, "data", "*"))) == 1


def test_effective_commits_hide_covered_ones():
    commits = [ledger.Commit(a, b, -1, f"{a}x{b}") for a, b in [(0, 0), (1, 1), (0, 3), (2, 2), (4, 4), (4, 4)]]
    assert [(c.first, c.last) for c in ledger.effective(commits)] == [(0, 3), (4, 4)]
    assert ledger.Commit.of(commits[0].name) == commits[0]
    assert ledger.Commit.of("_temporary") is None
    assert ledger.Commit.of(ledger.Commit(3, 9, 17, "abc").name) == ledger.Commit(3, 9, 17, "abc")


def last_writes(spark, folder, buckets=8):
    return S.KeyedStore(spark, folder, "key string, value string, batch bigint, position bigint", ["key"],
                        store.last_write(["value"], ["batch", "position"]), buckets)


def test_store_keeps_the_last_write_of_a_key(spark, scratch):
    rng = random.Random(6)
    votes, want = last_writes(spark, scratch), {}
    for b in range(6):
        # keys repeat within a batch and over batches, and rows come in any order
        rows = [(f"k{rng.randrange(30)}", f"v{b}.{i}", b, i) for i in range(40 if b != 3 else 0)]
        want.update({k: v for k, v, _, _ in rows})
        rng.shuffle(rows)
        assert votes.update(spark.createDataFrame(rows, votes.schema), b, source=b)
    assert {r.key: r.value for r in votes.read().collect()} == want
    # a replayed batch changes nothing, whatever it brings
    assert not votes.update(spark.createDataFrame([("k1", "late", 99, 0)], votes.schema), 5)
    assert {r.key: r.value for r in votes.read().collect()} == want and votes.source == 5
    assert votes.vacuum(0) > 0 and len(votes.ledger.all_commits()) == 1
    assert {r.key: r.value for r in votes.read().collect()} == want


def test_store_rewrites_only_touched_buckets(spark, scratch):
    votes = last_writes(spark, scratch, 16)
    votes.update(spark.createDataFrame([(f"k{i}", "a", 0, i) for i in range(200)], votes.schema), 0)
    first = votes._places()
    votes.update(spark.createDataFrame([("k7", "b", 1, 0)], votes.schema), 1)
    changed = [b for b, a in votes._places().items() if first[b] != a]
    assert len(first) == 16 and len(changed) == 1
    assert {r.key: r.value for r in votes.read().collect()} == {**{f"k{i}": "a" for i in range(200)}, "k7": "b"}


def test_store_after_a_lost_version(spark, scratch, monkeypatch):
    votes = last_writes(spark, scratch)
    votes.update(spark.createDataFrame([("a", "1", 0, 0), ("b", "1", 0, 1)], votes.schema), 0)
    with monkeypatch.context() as m:
        m.setattr(S.Ledger, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            votes.update(spark.createDataFrame([("a", "2", 1, 0)], votes.schema), 1)
    assert {r.key: r.value for r in votes.read().collect()} == {"a": "1", "b": "1"}
    votes.update(spark.createDataFrame([("a", "3", 1, 0)], votes.schema), 1)
    assert {r.key: r.value for r in votes.read().collect()} == {"a": "3", "b": "1"}


def test_rate_summary_equals_the_batch_form_after_every_batch(spark, scratch):
    series = S.Ledger(spark, os.path.join(scratch, "metrics"))
    summary = S.RateSummary(spark, series.table, os.path.join(scratch, "summary"))
    rates = [0.0, 3.0, 0.0, 5.5, 7.25, 0.0, 0.0, 1e9, 2.5, 0.0, 0.0, 0.0, 0.0, 4.0]
    at = "timestamp_seconds({}) AS batch_start, {} AS n, CAST({} AS DOUBLE) AS rate"
    for k, rate in enumerate(rates):
        series.append(spark.sql("SELECT " + at.format(k, int(rate), rate)), k)
        summary.step()
        summary.step()
        got = summary.read().first()
        want = metrics.rate_summary(S.read_metric_series(spark, series.table)).first()
        assert got[0] == want[0]
        for a, b in zip(got[1:], want[1:]):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12)
        assert summary.idle() == (k >= 3 and sum(rates[k - 2:k + 1]) == 0)


def test_moments_merge_in_any_split():
    rng = random.Random(2)
    data = [rng.uniform(-5, 50) for _ in range(40)]

    def moments(xs):
        mean = sum(xs) / len(xs) if xs else None
        return (len(xs), mean, sum((x - mean) ** 2 for x in xs) if xs else None, min(xs, default=None), max(xs, default=None))

    for cut in (0, 1, 17, 40):
        assert merge_moments(moments(data[:cut]), moments(data[cut:])) == pytest.approx(moments(data))
