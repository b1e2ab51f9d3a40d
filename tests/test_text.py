from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import model
from tallyline.functions.text import space_tokens, split_lines
from tallyline.operators.words import word_counts
from tallyline.sources.text import document_lines


def tokens(spark, line):
    return spark.createDataFrame([(line,)], "line string").select(
        space_tokens(F.col("line")).alias("t")).first().t


@pytest.mark.parametrize("line,want", [
    ("a b  ", ["a", "b"]),
    ("  a", ["", "", "a"]),
    ("a  b", ["a", "", "b"]),
    ("", [""]),
    ("   ", []),
    ("a\tb c", ["a\tb", "c"]),
])
def test_space_tokens(spark, line, want):
    assert tokens(spark, line) == want


@pytest.mark.parametrize("text,want", [
    ("a\nb", ["a", "b"]),
    ("a\n", ["a"]),
    ("", []),
    ("\n", [""]),
    ("a\r\nb\rc", ["a", "b", "c"]),
    ("a\n\nb", ["a", "", "b"]),
    ("a\n\n", ["a", ""]),
])
def test_split_lines(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(
        split_lines(F.col("text")).alias("l")).first().l
    assert got == want


def py_lines(text):
    if text == "":
        return []
    out, cur, i = [], "", 0
    while i < len(text):
        ch = text[i]
        if ch in "\r\n":
            out.append(cur)
            cur = ""
            if ch == "\r" and i + 1 < len(text) and text[i + 1] == "\n":
                i += 1
        else:
            cur += ch
        i += 1
    if cur or not (text.endswith("\n") or text.endswith("\r")):
        out.append(cur)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \n\r", max_size=12), min_size=1, max_size=8))
def test_word_counts_match_model(spark, texts):
    docs = spark.createDataFrame([(i // 3, t) for i, t in enumerate(texts)],
                                 "batch_id bigint, text string")
    got = {(r.batch_id, r.word): r.n for r in
           word_counts(document_lines(docs, keep=("batch_id",))).collect()}
    want = Counter()
    for i, t in enumerate(texts):
        for line in py_lines(t):
            for w in model.java_space_split(line):
                want[(i // 3, w)] += 1
    assert got == dict(want)
