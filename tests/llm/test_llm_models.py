"""Quality rules, weak classifier, toxicity, HMM and the pipeline."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixture import clashing, folder, frame, rows, same_rows

import corpus_pipeline
from tallyline.llm import hmm, quality_rules, queries, toxicity, weak_classifier

SMALL = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- quality rules

def slow_measures(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    n = len(words)
    windows = [tuple(words[i:i + 3]) for i in range(n - 2)]
    times = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def quality_rows():
    rng = random.Random(9)
    out = rows()
    for k in range(25):  # repeats that overlap, touch and nest
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        out.append((3000 + k, " ".join(words), "en", "s0", 1))
    return out


def test_op8_measures_equal_brute_force(spark, scratch):
    got = queries.op8_quality_rules(spark, folder(spark, scratch, quality_rows())).collect()
    want = []
    for doc, text, *_ in quality_rows():
        m = slow_measures(text)
        want.append((doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same_rows([tuple(r)[:7] for r in got], want)
    assert all(not r.kept or (not r.base_failed and r.posterior >= 0.5) for r in got)


def test_label_model_equals_plain_em(spark):
    rng = random.Random(3)
    data = []
    for _ in range(400):
        good = rng.random() < 0.8
        data.append([None if rng.random() < 0.3 else int((rng.random() < 0.85) == good) for _ in range(4)])
    model = quality_rules.fit(spark.createDataFrame([(v,) for v in data], "v array<int>"), "v",
                              quality_rules.RULES[:4], steps=6, tolerance=0)
    pi, a, b, w = 0.7, [0.9] * 4, [0.4] * 4, 20.0
    for _ in range(6):
        up = []
        for votes in data:
            odds = math.log(pi / (1 - pi))
            for j, v in enumerate(votes):
                if v is not None:
                    odds += math.log(a[j] / (1 - b[j])) if v else math.log((1 - a[j]) / b[j])
            up.append(1 / (1 + math.exp(-odds)))
        pi = (sum(up) + 0.7 * w) / (len(data) + w)
        for j in range(4):
            on = [(p, v[j]) for p, v in zip(up, data) if v[j] is not None]
            a[j] = (sum(p for p, v in on if v) + 0.9 * w) / (sum(p for p, _ in on) + w)
            b[j] = (sum(1 - p for p, v in on if not v) + 0.4 * w) / (sum(1 - p for p, _ in on) + w)
    assert model.steps == 6
    assert np.allclose([model.prior, *model.good, *model.bad], [pi, *a, *b])


def test_keep_good_keeps_columns_and_agrees_with_the_report(spark):
    df = clashing(frame(spark, quality_rows()))
    kept = quality_rules.keep_good(df)
    assert kept.dtypes == df.dtypes
    report = quality_rules.quality_report(df).where("kept")
    same_rows([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in report.collect()])


def test_quality_rules_run_no_python(spark, capsys):
    df = frame(spark)
    df.select(quality_rules.measures(df["text"]).alias("m")).select(
        quality_rules.votes("m")).explain("simple")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|InArrow", plan)


def agreement(spark, query, column):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r.doc_id: r for r in query(spark, SMALL).collect()}
    known = [(got[d][column], q) for d, q in labels.items() if d in got]
    return known


def test_rules_agree_with_quality_labels(spark):
    known = agreement(spark, queries.op8_quality_rules, "posterior")
    right = sum((p >= 0.5) == bool(q) for p, q in known) / len(known)
    assert right > 0.85


def test_weak_classifier_agrees_with_quality_labels(spark):
    known = agreement(spark, queries.op9_weak_classifier, "kept")
    right = sum(k == bool(q) for k, q in known) / len(known)
    assert right > 0.85


# ---------------------------------------------------------------- weak classifier

def test_op9_rows_votes_and_equal_texts(spark, scratch):
    got = queries.op9_weak_classifier(spark, folder(spark, scratch)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows())
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= 0.5) for r in got)
    copies = {r.score for r in got if r.doc_id in range(1000, 1006)}
    assert len(copies) == 1
    assert weak_classifier.label(b"") == [0] + [None] * 8


def test_sampled_texts_are_sent_as_bucket_counts(spark):
    text = "some word " * 30_000
    got = weak_classifier.bucket_counts(frame(spark, [(1, text, "en", "s", 1), (2, None, "en", "s", 1)])).collect()
    long, empty = sorted(got, key=lambda r: -len(r.buckets))
    assert len(long.buckets) <= 4 and sum(long.times) == 2 * 60_000
    buckets, times = np.unique(weak_classifier.Features()(text.encode()), return_counts=True)
    assert long.buckets == buckets.tolist() and long.times == times.tolist()
    assert empty.buckets == empty.times == []


def slow_label(text):
    """The labellers' votes, character by character."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n = len(words)
    votes = [0 if n < 50 else 1 if n >= 100 else None]
    if not n:
        return votes + [None] * 8
    letters = [bool(re.match(rb"[A-Za-z\x80-\xff]", bytes([b]))) for b in range(256)]
    size = sum(len(w) for w in words)
    mean = size / n

    def vote(share, good, bad):
        return 1 if share <= good else None if share <= bad else 0

    votes.append(0 if mean < 2.5 or mean > 14 else 1 if 3.5 <= mean <= 11 else None)
    for chosen, by, good, bad in ((b"#*$%&|<>{}[]\\^~=+_@", n, 0.03, 0.15), (b"!?", n, 0.08, 0.3),
                                  (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", size, 0.15, 0.3), (b"0123456789", size, 0.1, 0.3)):
        votes.append(vote(sum(b in chosen for b in raw) / by, good, bad))
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    votes.append(vote((len(lines) - len(set(lines))) / len(lines), 0.02, 0.3) if len(lines) > 1 else None)
    variety = len(set(words)) / n ** 0.75
    votes.append(None if n < 50 else 0 if variety < 0.5 else 1 if variety > 1.0 else None)
    # words left when all but letters is taken out
    bare = [w for w in words if any(letters[b] for b in w)]
    votes.append(vote(1 - len(bare) / n, 0.05, 0.2))
    return votes


def slow_buckets(text):
    """How often a text has each bucket: of its words, and of their shapes with runs as one."""
    times = collections.Counter()
    for word in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()):
        if word:
            shape = bytearray()
            for b in word:
                kind = (ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57
                        else ord("a") if 97 <= b <= 122 or b >= 128 else b)
                if not shape or shape[-1] != kind:
                    shape.append(kind)
            for value in (word, b"\0" + bytes(shape)):
                times[zlib.crc32(value) % (1 << weak_classifier.HASH_BITS)] += 1
    return times


def slow_scorer(data, passes=8, rate=1.0, decay=1e-5, seed=5):
    """AdaGrad over dictionaries: (text's bucket counts, soft label) in order."""
    weights, squares, bias, bias_square = collections.Counter(), collections.defaultdict(lambda: 1e-6), 0.0, 1e-6
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(data)):
            times, target = data[k]
            values = {b: c / max(1, sum(times.values()) // 2) for b, c in times.items()}
            total = bias + sum(weights[b] * v for b, v in values.items())
            error = 1 / (1 + math.exp(-max(-30, min(30, total)))) - target
            for b, v in values.items():
                gradient = error * v + decay * weights[b]
                squares[b] += gradient * gradient
                weights[b] -= rate * gradient / math.sqrt(squares[b])
            bias_square += error * error
            bias -= rate * error / math.sqrt(bias_square)
    return weights, bias


@pytest.mark.parametrize("sample", [40, 10_000])
def test_op9_equals_the_slow_scorer_however_rows_are_dealt(spark, sample):
    some = rows(4, 150) + rows(4, 150)[:30]  # some rows twice
    results = []
    for partitions in (1, 5):
        df = clashing(frame(spark, some, partitions)).withColumnRenamed("kept", "pick")
        results.append(sorted(map(tuple, weak_classifier.classify(df, sample_rows=sample).collect()), key=repr))
    assert results[0] == results[1]
    for doc, text, *_ in some:
        assert weak_classifier.label((text or "").encode()) == slow_label(text)
    # the sample: the different rows with the smallest hashes, in their order
    picked = weak_classifier.sampled(weak_classifier._texts(frame(spark, some), "doc_id", "text"), sample)
    order = {r["pick"]: (r["doc_id"], r["text"]) for r in picked.collect()}
    posteriors = {}
    for doc, posterior, *_ in results[0]:
        posteriors.setdefault(doc, []).append(posterior)
    by_votes = {tuple(slow_label(t)): p for t, p in zip([r[1] for r in some], [None] * len(some))}
    table = spark.createDataFrame([(list(v),) for v in by_votes], "votes array<int>")
    model = weak_classifier.fit(weak_classifier.vote_patterns(frame(spark, some)), "votes", weak_classifier._RULES,
                                counted=True)
    found = table.select("votes", weak_classifier.posterior("votes", model).alias("p")).collect()
    by_votes = {tuple(r["votes"]): r["p"] for r in found}
    data = [(slow_buckets(t), by_votes[tuple(slow_label(t))]) for _, (_, t) in sorted(order.items())][:sample]
    weights, bias = slow_scorer(data)
    want = []
    for doc, text, *_ in some:
        times = slow_buckets(text)
        words = sum(times.values()) // 2
        total = bias + (sum(weights[b] * c for b, c in times.items()) / words if words else 0.0)
        want.append((doc, 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))))
    got = sorted(((r[0], r[2]) for r in results[0]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-9


def test_op9_of_very_long_texts(spark):
    long = "Plain words and more of them, " * 20_000
    got = weak_classifier.classify(frame(spark, rows(2, 40) + [(7777, long, "en", "s", 0)])).collect()
    assert len(got) == len(rows(2, 40)) + 1 and weak_classifier.label(long.encode()) == slow_label(long)


def test_vote_patterns_count_every_text(spark):
    df = frame(spark)
    got = {tuple(r.votes): r.n for r in weak_classifier.vote_patterns(df).collect()}
    assert got == collections.Counter(tuple(weak_classifier.label((r[1] or "").encode())) for r in rows())


# ---------------------------------------------------------------- toxicity

def test_gradients_equal_differences():
    net = toxicity.Network.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, at, mask = toxicity._laid_out([[b"ab", b"cde", b"ab", b"f"], [b"xyz"], [b"cde", b"q"]])
    x, target = toxicity.WordInputs.of(words), np.array([1.0, 0.0, 1.0])
    _, g = net.gradients(x, at, mask, target)
    rng = np.random.default_rng(0)
    for name, array in net.p.items():
        live = np.argwhere(g[name] != 0)
        for place in map(tuple, live[rng.choice(len(live), min(4, len(live)), replace=False)]):
            kept, step = array[place], 1e-3
            array[place] = kept + step
            up, _ = net.gradients(x, at, mask, target)
            array[place] = kept - step
            down, _ = net.gradients(x, at, mask, target)
            array[place] = kept
            assert g[name][place] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-6), name


def test_scores_equal_one_window_at_a_time():
    net = toxicity.Network.new(2)
    net.scale, net.shift = 3.0, 0.1
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "bbb", "Cé", "idiot."]) for _ in range(n)) for n in (1, 5, 64, 65, 200, 1000)]
    got = toxicity.Scorer(net).scores([*texts, "", " \n"])
    for text, score in zip(texts, got):
        words = toxicity.words_of(text)
        starts = toxicity.window_starts(len(words))
        assert starts[-1] + toxicity.WINDOW >= len(words)
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))
        each = [toxicity.Scorer(net).logits([b" ".join(words[s:s + toxicity.WINDOW]).decode()])[0] for s in starts]
        assert score == pytest.approx(1 / (1 + math.exp(-(3.0 * max(each) + 0.1))), abs=1e-5)
    assert got[-2:] == [0.0, 0.0]


def toxic_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    out, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(text) // 20):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "rotten", "scoundrel"])
        out.append((i, " ".join(text), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return out, labels


def test_op5_learns_from_allowed_labels_only(spark, scratch):
    docs, labels = toxic_rows()
    held = [d for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    # wrong labels on rows that must not be used change nothing
    labels = [(d, q, 1 - t if d in set(held) else t) for d, q, t in labels]
    path = folder(spark, scratch, docs + rows()[-22:], labels)
    got = queries.op5_toxicity(spark, path).collect()
    assert len(got) == len(docs) + 22
    by_id = {r.doc_id: r for r in got}
    right = [by_id[d].predicted == int(d % 4 == 0) for d in held]
    assert sum(right) / len(right) > 0.9
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_no_labels_no_toxicity(spark, scratch):
    path = folder(spark, scratch)
    assert {r.score for r in queries.op5_toxicity(spark, path).collect()} == {0.0}
    df = clashing(frame(spark))
    assert toxicity.keep_clean(df, None).count() == len(rows())


# ---------------------------------------------------------------- hidden Markov model

def test_forward_recursion_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    k, c = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    sequences = [rng.integers(0, c, n).astype("<u2") for n in (1, 4, 2, 6)]

    def total(seq):
        paths = [((s,), model.start[s] * model.emit[seq[0], s]) for s in range(k)]
        for w in seq[1:]:
            paths = [((*p, s), q * model.move[p[-1], s] * model.emit[w, s]) for p, q in paths for s in range(k)]
        return paths

    assert np.allclose(hmm.log_likelihoods(model, sequences),
                       [math.log10(sum(q for _, q in total(s))) for s in sequences])
    start, move, emit = hmm.expected_counts(model, sequences, c)
    want_start, want_move, want_emit = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for seq in sequences:
        paths = total(seq)
        whole = sum(q for _, q in paths)
        for p, q in paths:
            want_start[p[0]] += q / whole
            for t, s in enumerate(p):
                want_emit[seq[t], s] += q / whole
                if t:
                    want_move[p[t - 1], s] += q / whole
    assert np.allclose(start, want_start) and np.allclose(move, want_move) and np.allclose(emit, want_emit)


def hmm_counts(docs):
    held = {d for d, *_ in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2}
    count = collections.Counter()
    for d, text, *_ in docs:
        if d not in held:
            count.update([*(text or "").encode().lower().split(), b""])
    return held, count


SHAPES = [hmm.Shape(), hmm.Shape(states=3, own_classes=5, shared_classes=4, known_words=9, steps=2, train_piece=7)]


@pytest.mark.parametrize("shape", SHAPES)
def test_op3_base_and_model_probabilities(spark, scratch, shape):
    docs = rows()
    df = frame(spark)
    from tallyline.llm.common import held_out

    got = hmm.score(clashing(df), ~held_out("doc_id", 7, 2), shape).collect()
    held, count = hmm_counts(docs)
    n, v = sum(count.values()), len(count)
    want = []
    for d, text, *_ in docs:
        words = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        want.append((d, d in held, len(words), sum(count[w] > 0 for w in words), n, round(base, 6)))
    same_rows([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got],
              want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_one_step_of_the_model_is_a_distribution(spark):
    """Continuations of an empty history: all words, and one unseen word per
    shared class, add up to 1."""
    shape = SHAPES[1]
    words = "a a a b b c c d e f g h i j k".split()
    counts = collections.Counter(words + [""])
    table = spark.createDataFrame(list(counts.items()), "word string, c bigint")
    vocab = hmm.vocabulary(table, shape)
    model = hmm.Model.new(vocab)
    total, unseen = 0.0, {}
    for word in [*counts, *[f"new{i}" for i in range(200)]]:
        raw = word.encode()
        rank = vocab.place.get(raw, -1)
        cls = rank if 0 <= rank < shape.own_classes else vocab.shared_class(raw)
        p = 10 ** hmm.log_likelihoods(model, [np.array([cls])])[0]
        if cls >= shape.own_classes:
            p *= (counts.get(word, 0) + 1) / 10 ** vocab.share_logs[cls - shape.own_classes]
        if word in counts:
            total += p
        else:
            unseen[cls] = p
    assert len(unseen) == shape.shared_classes
    assert total + sum(unseen.values()) == pytest.approx(1.0, abs=1e-6)


def brute_force_words(docs, shape):
    """Expected counts of every word after ``shape.steps`` steps, and all scores, with
    one row of emissions per word, texts one at a time."""
    held, count = hmm_counts(docs)
    texts = [(d, [*(t or "").encode().lower().split(), b""]) for d, t, *_ in docs]
    ranks = sorted(count, key=lambda w: (-count[w], w))
    own, k = shape.own_classes, shape.states
    place = {w: i for i, w in enumerate(ranks[:own])}

    def class_of(w):
        return place.get(w, own + zlib.crc32(w) % shape.shared_classes)

    n, v = np.zeros(shape.classes), np.zeros(shape.classes)
    for w in count:
        n[class_of(w)] += count[w]
        v[class_of(w)] += 1
    weights = np.where(np.arange(shape.classes) < own, n, n + 1)
    vocab = hmm.Vocabulary(shape, {}, np.zeros(0), np.zeros(0), weights, sum(count.values()), len(count))
    model, gamma, classes = hmm.Model.new(vocab), None, None

    def emission(w):
        c = class_of(w)
        if c < own:
            return model.emit[c]
        if gamma is None or w not in gamma:
            return model.emit[c] * (count[w] + 1) / (n[c] + v[c] + 1)
        q = (gamma[w] + count[w] / n[c]) / (classes[c] + 1)
        return model.emit[c] * (n[c] * q + 1) / (n[c] + v[c] + 1)

    def plain(words):
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        local = hmm.Model(model.start, model.move, np.array([emission(w) for w in ids]))
        return ids, local, np.array([ids[w] for w in words])

    for _ in range(shape.steps):
        start, move, new = np.zeros(k), np.zeros((k, k)), {w: np.zeros(k) for w in count}
        for d, words in texts:
            if d in held:
                continue
            for i in range(0, len(words), shape.train_piece):
                ids, local, sequence = plain(words[i:i + shape.train_piece])
                a, b, e = hmm.expected_counts(local, [sequence], len(ids))
                start, move = start + a, move + b
                for w, j in ids.items():
                    new[w] += e[j]
        classes = np.zeros((shape.classes, k))
        for w in new:
            classes[class_of(w)] += new[w]
        model, gamma = model.improved(vocab, start, move, classes), new
    scores = []
    for d, words in texts:
        _, local, sequence = plain(words)
        scores.append((d, len(words), float(hmm.log_likelihoods(local, [sequence])[0])))
    return gamma, scores


def test_every_training_word_has_counts_of_its_own(spark):
    """Words beyond the classes of their own, known and joined, as in brute force."""
    from tallyline.llm.common import held_out

    docs, shape = rows(), SHAPES[1]
    gamma, want = brute_force_words(docs, shape)
    got = hmm.score(frame(spark), ~held_out("doc_id", 7, 2), shape).collect()
    near = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for a, b in zip(near, sorted((str(d), n, s) for d, n, s in want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5)
    # words of one class lean to different states
    first = [gamma[w] / gamma[w].sum() for w in gamma if gamma[w].sum() >= 20]
    assert np.std(first, axis=0).max() > 0.01


def test_counts_of_words_in_many_blocks_and_buckets(spark, monkeypatch):
    """Sums of words of many blocks, words met once, and words of texts held out equal
    brute force, and only the tables that the scores are read from stay on disk."""
    from tallyline import session
    from tallyline.llm.common import held_out

    rng, docs = random.Random(31), rows()
    names = ["".join(rng.choices("klmnopq", k=4)) for _ in range(60)]
    docs += [(7000 + i, " ".join([*rng.choices(names, k=rng.randint(1, 40)), f"once{i}", "w" * 70]), "en", "s0", 1)
             for i in range(60)]
    shape = hmm.Shape(states=3, own_classes=5, shared_classes=4, known_words=9, steps=3, train_piece=7,
                      block_tokens=90, bucket_words=50)
    made = []
    monkeypatch.setattr(hmm, "materialize", lambda df, name: made.append(session.materialize(df, name)) or made[-1])
    _, want = brute_force_words(docs, shape)
    got = hmm.score(frame(spark, docs), ~held_out("doc_id", 7, 2), shape).collect()
    near = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for a, b in zip(near, sorted((str(d), n, s) for d, n, s in want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5)
    kept = [os.path.exists(os.path.dirname(t.inputFiles()[0]).removeprefix("file:")) for t in made]
    assert sum(kept) == 2


def test_model_beats_word_frequencies_on_held_out_texts(spark):
    got = [r for r in queries.op3_hmm_scores(spark, SMALL).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_every_step_of_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    shape = hmm.Shape(states=3, own_classes=8, shared_classes=1, smoothing=0)
    vocab = hmm.Vocabulary(shape, {}, np.zeros(0), np.zeros(1), np.ones(9), 10, 9)
    data = [rng.integers(0, 4, 30) if i % 2 else rng.integers(4, 9, 30) for i in range(40)]
    model, last = hmm.Model.new(vocab), -np.inf
    for _ in range(8):
        now = hmm.log_likelihoods(model, data).sum()
        assert now > last - 1.0  # the add-one of start and moves may cost a little
        last = now
        model = model.improved(vocab, *hmm.expected_counts(model, data, 9))
    assert last > hmm.log_likelihoods(hmm.Model.new(vocab), data).sum() + 10


# ---------------------------------------------------------------- pipeline

def test_stages_follow_the_operators(spark, scratch):
    docs, labels = toxic_rows()
    path = folder(spark, scratch, docs + rows(), labels)
    df = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_rules", "toxicity", "simhash", "packing"]
    good = by_name["quality_rules"](spark, df, path)
    clean = by_name["toxicity"](spark, df, path)
    single = by_name["simhash"](spark, df, path)
    assert good.dtypes == clean.dtypes == single.dtypes == df.dtypes
    report = queries.op8_quality_rules(spark, path).where("kept").collect()
    same_rows([(r.doc_id,) for r in good.collect()], [(r.doc_id,) for r in report])
    scores = queries.op5_toxicity(spark, path).where("score < 0.5").collect()
    same_rows([(r.doc_id,) for r in clean.collect()], [(r.doc_id,) for r in scores])
    packed = by_name["packing"](spark, single, path).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}


def test_run_chains_all_stages(spark, scratch):
    docs, labels = toxic_rows()
    path = folder(spark, scratch, docs + rows(), labels)
    step = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, path)
    same_rows([tuple(r)[:5] for r in corpus_pipeline.run(spark, path).collect()],
              [tuple(r)[:5] for r in step.collect()])


def test_empty_tables(spark, scratch):
    path = folder(spark, scratch, [])
    for query in (queries.op3_hmm_scores, queries.op5_toxicity, queries.op8_quality_rules,
                  queries.op9_weak_classifier, queries.pipeline):
        assert query(spark, path).collect() == []
