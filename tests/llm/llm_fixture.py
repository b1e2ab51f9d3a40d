"""Small documents with the cases every operator must define a result for."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

#: As SCHEMA, with columns named like those the operators make.
CLASHING = ["fp", "row", "row_number", "votes", "measures", "place", "bucket", "group", "shard_", "kept",
            "score", "component_id", "fingerprint", "n_words"]


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(k: int) -> str:
        out = [rng.choice(words) for _ in range(k)]
        return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(out))

    out = []
    for i in range(n):
        text = prose(rng.choice([3, 40, 120, 300]))
        out.append((i * 3, text, "en", f"s{min(i % 7, 3)}", len(text)))
    base = prose(200)
    for k in range(12):  # exact copies and copies that differ in a word
        text = base if k < 6 else base + f" extra{k}"
        out.append((1000 + k, text, "en", "s0", len(text)))
    odd = [None, "", " \t\n ", "one", "Two WORDS", "same same same same same", "ünïcödé — 日本語 текст x\x1cy",
           "line one here\nline one here\n\nother line\nline one here", "a b  c\r\nd\x0be\x0cf",
           "x" * 5000, "word " * 6000, " " * 9000 + "end", "<|endoftext|> is text here", "it's they'll 'tis don't",
           "### $$$ %%% " * 40, "emoji 👩‍👩‍👧 done", "trailing space "]
    for k, text in enumerate(odd):
        out.append((2000 + k, text, None if k % 2 else "de", None if k % 3 == 0 else "s1", None))
    out.append((2001, "", "fr", None, 0))  # a repeated id, and a repeated row
    out.append((1000, base, "en", "s0", len(base)))
    out.append((None, "no id here " * 20, None, None, None))
    out.append((None, None, None, None, None))
    return out


def frame(spark, some=None, partitions: int = 3):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(partitions)


def clashing(df):
    from pyspark.sql import functions as F

    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"kept {name}"))
    return df


def folder(spark, path: str, some=None, labels=None) -> str:
    """A data folder with documents and labels, as the queries read it."""
    frame(spark, some).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def key(value):
    return (value is None, str(type(value)), value if value is not None else 0)


def same_rows(a, b):
    assert sorted(a, key=lambda r: [key(x) for x in r]) == sorted(b, key=lambda r: [key(x) for x in r])
