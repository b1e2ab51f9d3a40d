"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each text and vote good (1), bad (0) or
abstain. Expectation-maximisation over the counts of vote patterns of all texts
estimates their accuracies (the label model of :mod:`quality_rules`, over other
votes), and each text's posterior becomes a soft label. A linear scorer over hashed
words and word shapes is trained on soft labels and scores every whole text, so
that it also judges texts on which the labellers abstain.

The scorer is trained on at most ``sample_rows`` different rows, those with the smallest
hashes of id and text, in that order; everything else goes over all rows. The same rows give
the same scorer however they are partitioned.

Defined results: a NULL or empty text has no words; the labellers that need words
abstain, the length labeller votes bad, and the scorer gives its bias alone. Equal
texts get equal scores. NULL and repeated ids are rows like any other. Columns other than id
and text, whatever their names, are not read. Without any rows there is nothing to train and
the result is empty.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import batches_of, raw_texts
from tallyline.llm.quality_rules import LabelModel, Rule, fit, posterior

HASH_BITS = 17
SAMPLE_ROWS = 6000
MEMORY = 300_000  # words whose features a worker remembers

#: Fixed byte classes of the labellers.
SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@"
MARKS = b"!?"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
_LETTERS = frozenset([*range(65, 91), *range(97, 123), *range(128, 256)])
_GAPS = frozenset([*range(9, 14), 32])
_NEITHER = bytes(b for b in range(256) if b not in _LETTERS and b not in _GAPS)
_RUN = re.compile(rb"(.)\1+", re.S)

LABELLERS = ("length", "word_length", "symbols", "marks", "capitals", "digits", "repeated_lines",
             "variety", "bare_words")


def label(raw: bytes) -> list:
    """The votes of :data:`LABELLERS` on one text."""
    words = raw.split()
    n = len(words)
    votes: list = [0 if n < 50 else 1 if n >= 100 else None]
    if not n:
        return votes + [None] * (len(LABELLERS) - 1)
    size = sum(map(len, words))

    def among(chosen: bytes) -> int:
        return len(raw) - len(raw.translate(None, chosen))

    def below(share: float, good: float, bad: float):
        return 1 if share <= good else 0 if share > bad else None

    mean = size / n
    votes.append(0 if not 2.5 <= mean <= 14 else 1 if 3.5 <= mean <= 11 else None)
    votes.append(below(among(SYMBOLS) / n, 0.03, 0.15))
    votes.append(below(among(MARKS) / n, 0.08, 0.3))
    votes.append(below(among(CAPITALS) / size, 0.15, 0.3))
    votes.append(below(among(DIGITS) / size, 0.1, 0.3))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    votes.append(below(1 - len(set(lines)) / len(lines), 0.02, 0.3) if len(lines) > 1 else None)
    variety = len(set(words)) / n ** 0.75
    votes.append((0 if variety < 0.5 else 1 if variety > 1.0 else None) if n >= 50 else None)
    votes.append(below(1 - len(raw.translate(None, _NEITHER).split()) / n, 0.05, 0.2))
    return votes


_SHAPE = bytes(65 if b in CAPITALS else 48 if b in DIGITS else 97 if b in _LETTERS else b for b in range(256))


class Features:
    """Hashed word and word-shape buckets of a text's words."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 2), np.int32)

    @staticmethod
    def _new(word: bytes) -> tuple[int, int]:
        mask = (1 << HASH_BITS) - 1
        return zlib.crc32(word) & mask, zlib.crc32(b"\0" + _RUN.sub(rb"\1", word.translate(_SHAPE))) & mask

    def __call__(self, raw: bytes) -> np.ndarray:
        """One row of two bucket numbers per word."""
        words = raw.split()
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > MEMORY:
            self._forget()
            new = set(words)
        if new:
            at = len(self.place)
            if at + len(new) > len(self.table):
                more = np.zeros((max(at + len(new) - len(self.table), len(self.table)), 2), np.int32)
                self.table = np.concatenate([self.table, more])
            self.table[at:at + len(new)] = [self._new(w) for w in new]
            self.place.update(zip(new, range(at, at + len(new))))
        return self.table[np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))]


@dataclass
class LinearScorer:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        total = self.bias + (float(self.weights[buckets].sum()) / len(buckets) if len(buckets) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 8, rate: float = 1.0,
          decay: float = 1e-5, seed: int = 5) -> LinearScorer:
    """AdaGrad on the logistic loss against soft labels. A row is a text's different
    buckets, how often it has each (two buckets a word), and its label."""
    weights = np.zeros(1 << HASH_BITS)
    squares = np.full(1 << HASH_BITS, 1e-6)
    bias, bias_square = 0.0, 1e-6
    data = []
    for index, times, target in rows:
        data.append((index, times / max(1, int(times.sum()) // 2), target))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(data)):
            index, values, target = data[k]
            p = 1 / (1 + np.exp(-np.clip(bias + weights[index] @ values, -30, 30)))
            gradient = (p - target) * values + decay * weights[index]
            squares[index] += gradient * gradient
            weights[index] -= rate * gradient / np.sqrt(squares[index])
            bias_square += (p - target) ** 2
            bias -= rate * (p - target) / np.sqrt(bias_square)
    return LinearScorer(weights, float(bias))


_RULES = tuple(Rule(name, "", "") for name in LABELLERS)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def vote_patterns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(votes, n): how often each pattern of votes occurs."""
    def run(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for raw in raw_texts(batch.column(0)):
                key = tuple(label(raw))
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())],
                names=["votes", "n"])

    counted = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "votes array<int>, n bigint")
    return counted.groupBy("votes").agg(F.sum("n").alias("n"))


def bucket_counts(df: DataFrame, text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """([key,] votes, buckets, times) of every text: its different buckets, at most
    2^HASH_BITS however long it is, and how often it has each; ``key_col`` is a BIGINT."""
    def run(batches):
        features = Features()
        out = pa.schema([("key", pa.int64()), ("votes", pa.list_(pa.int32())), ("buckets", pa.list_(pa.int32())),
                         ("times", pa.list_(pa.int64()))])
        for batch in batches:
            yield from batches_of(((key, label(raw), *np.unique(features(raw), return_counts=True))
                                   for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)))), out, 256)

    key = F.col(f"`{key_col}`") if key_col else F.lit(None).cast("bigint")
    counted = df.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "key bigint, votes array<int>, buckets array<int>, times array<bigint>")
    return counted if key_col else counted.drop("key")


_HASHES = 1 << 62


def sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """Rows (doc_id, text) with the smallest hashes of id and text, with the hash
    as ``pick``: about ``sample_rows`` and five standard deviations more."""
    total = rows.count()
    pick = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(_HASHES))
    share = min(1.0, (sample_rows + 5 * sample_rows ** 0.5) / max(1, total))
    return rows.withColumn("pick", pick).where(F.col("pick") <= int(share * _HASHES))


def fit_scorer(df: DataFrame, model: LabelModel, sample_rows: int = SAMPLE_ROWS,
               id_col: str = "doc_id", text_col: str = "text") -> LinearScorer:
    """Train on the ``sample_rows`` different rows with the smallest hashes, in order of
    the hashes: how the table is partitioned does not show. Tasks turn texts into
    bucket counts before anything is brought together, and equal rows count once."""
    counted = bucket_counts(sampled(_texts(df, id_col, text_col), sample_rows), "text", "pick")
    table = counted.dropDuplicates(["key"]).select(
        "key", posterior("votes", model).alias("target"), "buckets", "times").toArrow()
    table = table.sort_by("key").slice(0, sample_rows)
    return train([(b.values.to_numpy(), n.values.to_numpy(), t) for t, b, n in
                  zip(table.column("target").to_pylist(), table.column("buckets"), table.column("times"))])


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, posterior, score, predicted, kept): the label model's posterior,
    the scorer's probability of good quality, and whether it reaches ``threshold``."""
    model = fit(vote_patterns(df, text_col), "votes", _RULES, counted=True)
    scorer = df.sparkSession.sparkContext.broadcast(fit_scorer(df, model, sample_rows, id_col, text_col))
    rows = _texts(df, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("votes", T.ArrayType(T.IntegerType())),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        features, linear = Features(), scorer.value
        for batch in batches:
            out = pa.schema([("doc_id", batch.schema.field(0).type), ("votes", pa.list_(pa.int32())),
                             ("score", pa.float64())])
            yield from batches_of(((d, label(raw), linear.score(features(raw))) for d, raw in
                                   zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)))), out)

    return rows.mapInArrow(run, schema).select(
        "doc_id", posterior("votes", model).alias("posterior"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("kept"))
