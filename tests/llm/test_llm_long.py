"""Queries on a text of over 60,000 characters beside short ones, against slow forms."""

import random

import numpy as np
import pytest
import xxhash
from llm_fixture import folder, frame, rows
from test_llm_models import brute_force_words, slow_measures

from tallyline.llm import fingerprints, hmm, queries, toxicity
from tallyline.llm.common import held_out

LONG = 9001


def long_rows():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(700)]
    text = " ".join(rng.choice(words) + ("\n" if k % 37 == 0 else "") for k in range(11_000))
    assert len(text) > 60_000
    return rows(3, 40) + [(LONG, text, "en", "s0", len(text)), (LONG + 1, text, "en", "s0", len(text)),
                          (LONG + 2, text + " more", "en", "s0", len(text) + 5)]


def of_long(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None and r["doc_id"] >= LONG}


def test_fingerprints_and_measures_of_a_long_text(spark, scratch):
    path, text = folder(spark, scratch, long_rows()), long_rows()[-1][1]
    words = text.lower().split()
    ones = np.zeros(64, int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42)
        ones += [(h >> b) & 1 for b in range(64)]
    bits = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    found = of_long(queries.op6_simhash(spark, path))
    assert found[LONG + 2]["fingerprint"] == f"{bits:016x}"
    assert found[LONG]["component_id"] == found[LONG + 1]["component_id"] == LONG
    near = of_long(queries.op7_chunk_fingerprints(spark, path))
    sets = [fingerprints.chunk_set(t.encode()) for t in (long_rows()[-2][1], text)]
    assert near[LONG + 1]["near_next"] == fingerprints.containment(*sets) > 0.99
    assert near[LONG]["near_next"] == 1.0 and 0.4 < near[LONG]["near_edited"] < 0.6 or near[LONG]["near_edited"] == 1.0
    measured = of_long(queries.op8_quality_rules(spark, path))
    n, chars, symbols, lines, repeats = slow_measures(text)
    row = measured[LONG + 2]
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (
        n, chars, symbols, lines, repeats)


def test_scores_of_a_long_text(spark):
    docs = long_rows()
    net = toxicity.Network.new(5)
    net.scale, net.shift = 0.7, -0.1
    scores = of_long(toxicity.score(frame(spark, docs), net))
    words = toxicity.words_of(docs[-1][1])
    each = [toxicity.Scorer(net).logits([b" ".join(words[s:s + toxicity.WINDOW]).decode()])[0]
            for s in toxicity.window_starts(len(words))]
    assert scores[LONG + 2]["score"] == pytest.approx(1 / (1 + np.exp(-(0.7 * max(each) - 0.1))), abs=1e-5)
    (best, window), = toxicity.Scorer(net).tops([docs[-1][1]])
    assert best == pytest.approx(max(each), abs=1e-5) and len(window) == toxicity.WINDOW
    shape = hmm.Shape(states=2, own_classes=5, shared_classes=3, known_words=9, steps=2, train_piece=64)
    got = of_long(hmm.score(frame(spark, docs), ~held_out("doc_id", 7, 2), shape))
    _, slow = brute_force_words(docs, shape)
    assert got[LONG + 2]["n_tokens"] == len(words) + 1
    (want,) = [score for d, _, score in slow if d == LONG + 2]
    assert got[LONG + 2]["score"] == pytest.approx(want, rel=1e-5)
