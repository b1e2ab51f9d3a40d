"""SimHash classes, sharding and chunk fingerprints against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixture import clashing, folder, frame, rows, same_rows
from pyspark.sql import functions as F

from tallyline.llm import fingerprints, queries, sharding, simhash
from tallyline.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\t\n\x0b\x0c\r ":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    """Root (smallest member) of every fingerprint, by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_op6_equals_brute_force(spark, scratch):
    got = queries.op6_simhash(spark, folder(spark, scratch)).collect()
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    roots = slow_classes([f for _, f in fps])
    least = {}
    for doc, f in fps:
        if doc is not None:
            least[roots[f]] = min(doc, least.get(roots[f], doc))
    want = [(doc, f"{f:016x}", least.get(roots[f])) for doc, f in fps]
    same_rows([tuple(r) for r in got], want)


@pytest.mark.parametrize("cell_limit", [1, 4, 1000])
def test_links_lose_no_pair_in_light_or_dense_cells(spark, cell_limit):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:6]:  # dense clouds and chains
        for _ in range(60):
            flips = rng.sample(range(64), rng.randint(1, 4))
            for b in flips:
                base ^= 1 << b if rng.random() < 0.5 else 0
            fps.add(base)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), cell_limit=cell_limit)
    found = {r.node: r.root for r in components(edges).collect()}
    slow = slow_classes([f % (1 << 64) for f in fps])
    groups = collections.defaultdict(set)
    for f in signed:
        groups[found.get(f, f)].add(f % (1 << 64))
    want = collections.defaultdict(set)
    for f, r in slow.items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@given(st.integers(0, 2 ** 64 - 1), st.lists(st.integers(0, 63), max_size=4))
@settings(deadline=None)
def test_counts_never_differ_by_more_than_bits(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f

    def counts(x):
        return [(x >> i & 3).bit_count() for i in range(0, 64, 2)]

    distance = sum(abs(x - y) for x, y in zip(counts(a), counts(b)))
    assert distance <= (a ^ b).bit_count()
    if distance <= 2:
        same = sum(counts(a)[i:i + 8] == counts(b)[i:i + 8] for i in range(0, 32, 8))
        assert same >= 2


def test_embedding_is_the_counts_in_unary(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(50)] + [0, 2 ** 64 - 1]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    for r in df.select("fp", simhash.bit_counts(F.col("fp")).alias("c")).collect():
        for i in range(0, 64, 2):
            assert (r.c % (1 << 64)) >> i & 3 == (1 << (r.fp % (1 << 64) >> i & 3).bit_count()) - 1


def test_keep_one_keeps_the_first_of_each_group_and_all_columns(spark):
    df = clashing(frame(spark))
    kept = simhash.keep_one(df)
    assert kept.dtypes == df.dtypes
    roots = slow_classes([slow_fingerprint(r[1]) for r in rows()])
    groups = collections.defaultdict(list)
    for r in rows():
        groups[roots[slow_fingerprint(r[1])]].append(r[0])
    want = [min(ids, key=lambda d: (d is None, d or 0)) for ids in groups.values()]
    same_rows([(r.doc_id,) for r in kept.collect()], [(d,) for d in want])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_op2_rows_law(spark, scratch):
    got = queries.op2_stratified_shards(spark, folder(spark, scratch)).collect()
    want = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "rows") for r in rows()]
    same_rows([(r.doc_id, r.size, r.text_crc32, r.law) for r in got], want)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert set(shards) == set(range(40))
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


@pytest.mark.parametrize("bucket_rows", [5, 100_000])
def test_interleaving_equals_one_sort(spark, bucket_rows):
    """The bucketed orders give the order of one sort by fractional rank."""
    data = [(i, f"s{min(i % 11, 4)}" if i % 50 else None) for i in range(600)]
    df = spark.createDataFrame(data, "id bigint, source string").repartition(5)
    got = sharding.interleave(df, "id", "source", 7, bucket_rows=bucket_rows).collect()
    mix = {r.id: r.m for r in df.select("id", F.xxhash64(
        F.lit(sharding.SEED), "id", F.struct("id", "source")).alias("m")).collect()}
    salt = {r.source: r.h for r in df.select("source").distinct().select(
        "source", F.xxhash64(F.lit(sharding.SEED), "source").alias("h")).collect()}
    by_source = collections.defaultdict(list)
    for i, s in data:
        by_source[s].append(i)
    order = []
    for s, ids in by_source.items():
        ids.sort(key=lambda i: mix[i] % (1 << 64))
        order += [((2 * r + 1) / (2 * len(ids)), salt[s], i) for r, i in enumerate(ids)]
    order = [i for *_, i in sorted(order)]
    placed = {r.id: (r.shard, r.slot) for r in got}
    want = {}
    for at, i in enumerate(order):
        shard = at * 7 // len(order)
        want[i] = (shard, at - -(-shard * len(order) // 7))
    assert placed == want
    for s, ids in by_source.items():  # the mixture holds in every shard
        per = collections.Counter(placed[i][0] for i in ids)
        assert all(abs(per[k] - len(ids) / 7) <= 2 for k in range(7))


def test_sharding_of_few_rows_and_clashes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, source string")
    assert sorted(r.slot for r in sharding.interleave(df, "id", "source", 5).collect()) == [0, 0]
    with pytest.raises(ValueError):
        sharding.interleave(df.withColumn("slot", F.lit(1)), "id", "source", 5)


def test_rare_sources_are_spread_over_all_shards(spark, scratch):
    docs = [(i, f"text {i}", "en", f"rare{i}" if i % 2 else "large", 1) for i in range(4000)]
    got = queries.op2_stratified_shards(spark, folder(spark, scratch, docs)).collect()
    rare = collections.Counter(r.shard for r in got if r.source != "large")
    assert sum(rare.values()) == 2000 and len(rare) == queries.SHARDS
    assert all(25 <= rare[k] <= 80 for k in range(queries.SHARDS))  # 50 on average
    assert set(collections.Counter(r.shard for r in got).values()) == {100}


def slow_ends(raw, sizes):
    """Chunk ends byte by byte, hashing one byte at a time."""
    bits = sizes.normal.bit_length() - 1
    hashes, h = [], 0
    for b in raw:
        h = ((h << 1) + int(fingerprints.GEAR[b])) % (1 << 16)
        hashes.append(h)
    ends, start = [], 0
    while start < len(raw):
        end = len(raw)
        for e in range(start + sizes.least, min(start + sizes.most, len(raw)) + 1):
            zeros = bits + 1 if e - start < sizes.normal else bits - 1
            if hashes[e - 1] >> (16 - zeros) == 0 or e - start == sizes.most:
                end = e
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("seed", range(6))
def test_chunk_ends_equal_a_byte_by_byte_scan(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(97, 97 + (2 if seed == 5 else 20), [0, 1, 33, 700, 9000, 9000][seed]).astype(np.uint8).tobytes()
    sizes = fingerprints.Chunking()
    assert fingerprints.chunk_ends(raw, sizes) == slow_ends(raw, sizes)


def test_blocks_do_not_show(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 255, 20_000).astype(np.uint8).tobytes()
    whole = fingerprints.chunk_ends(raw)
    monkeypatch.setattr(fingerprints, "BLOCK", 777)
    assert fingerprints.chunk_ends(raw) == whole


def test_chunks_resist_shifts():
    raw = np.random.default_rng(4).integers(97, 120, 20_000).astype(np.uint8).tobytes()
    a, b = fingerprints.chunk_set(raw), fingerprints.chunk_set(b"some new words " + raw)
    assert fingerprints.containment(a, b) > 0.95
    assert fingerprints.containment(a, fingerprints.chunk_set(raw[:10_000])) == pytest.approx(0.5, abs=0.06)
    assert fingerprints.from_string(fingerprints.to_string(a)) == a


@pytest.mark.parametrize("chars,least", [(100, 0.2), (220, 0.3), (450, 0.35), (2000, 0.4), (6000, 0.4)])
def test_edited_texts_of_any_length_are_like_their_own(chars, least):
    rng = random.Random(chars)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(chars))[:chars + i] for i in range(60)]
    near = [fingerprints._compare(0, a, fingerprints.chunk_set(a.encode()), b, fingerprints.chunk_set(b.encode()),
                                  fingerprints.Chunking())[5:] for a, b in zip(texts, texts[1:])]
    assert sum(a == 0 for a, _ in near) <= 6
    assert np.mean([a for a, _ in near]) > least and np.mean([b for _, b in near]) < 0.02


@pytest.mark.parametrize("size,least", [(120, 0.4), (300, 0.7)])
def test_a_text_is_found_within_texts_of_any_length(size, least):
    """Half and more of a short text's bytes, whether it lies in a text of 500 or 50,000 characters."""
    rng = random.Random(size)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    for length in (500, 2040, 2060, 9000, 50_000):
        likeness = []
        for _ in range(25):
            long = " ".join(rng.choices(words, k=length // 3))[:length]
            at = rng.randrange(length - size)
            likeness.append(fingerprints.containment(*(fingerprints.chunk_set(t.encode())
                                                       for t in (long[at:at + size], long))))
        assert sum(v > 0 for v in likeness) >= 24 and sum(likeness) / 25 > least


@pytest.mark.parametrize("bucket_docs", [3, 1024])
def test_op7_equals_brute_force(spark, scratch, monkeypatch, bucket_docs):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", bucket_docs)
    got = queries.op7_chunk_fingerprints(spark, folder(spark, scratch)).collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, row in enumerate(order):
        text, after = row[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, new, nxt = (fingerprints.chunk_set(t.encode()) for t in (text, edited, after))
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_string(own),
                     fingerprints.to_string(new), fingerprints.containment(own, new),
                     fingerprints.containment(own, nxt)))
    same_rows([tuple(r) for r in got], want)
    plain = fingerprints.fingerprints(clashing(frame(spark)), "doc_id").collect()
    same_rows([(r.doc_id, r.fingerprint) for r in plain], [(w[0], w[3]) for w in want])


def test_empty_tables(spark, scratch):
    path = folder(spark, scratch, [])
    for query in (queries.op2_stratified_shards, queries.op6_simhash, queries.op7_chunk_fingerprints):
        assert query(spark, path).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []
