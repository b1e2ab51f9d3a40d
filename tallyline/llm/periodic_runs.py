"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) that is at least ``Runs.least`` words (24 or more) and ``Runs.repeats``
periods (3 or more) long and that no neighbouring word extends. All runs of a text are found:

* Periods below ``FIRST`` are found by direct lag scans: where does word i equal
  word i + q?
* Scale K = FIRST, 2 FIRST, 4 FIRST, ... serves periods K <= q < 2K. Every block of
  K words is hashed; the minimizer of K neighbouring blocks is the one with the
  smallest hash, the leftmost of equal ones. Two windows q apart inside a run hold
  the same words (2K - 1 + q <= 3q), so their minimizers are equal and q apart.
  Equal minimizers K to 2K - 1 apart are the seeds; each is extended to both sides
  as long as words q apart agree, which also tells false seeds.
* A block that repeats with a period of at most K / 3 is no minimizer. Equal
  minimizers are then over K / 3 apart, so each is in at most six pairs however
  monotonous a text is. No run is lost: were all blocks in the first 2q words of a
  run such blocks, these words would have a period of at most K / 3 as well as q, and
  q would not be the smallest one. Whether a block is periodic depends on its words
  alone, and is known from the smaller scales.

A stretch found with several periods is one run, whose period is the smallest (the
others are multiples of it).

Defined results: a NULL, empty or blank text has no words and no runs. Words are
compared by their bytes. A text is one task's work; a text of any length is read
whole. Repeated rows and ids are separate rows. Columns of the input named like an
output column (in any case) are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import free_name, numbered, raw_texts

FIRST = 16  # the first scale; shorter periods are scanned directly
LEAST, REPEATS = 24, 3  # words and periods of the shortest run that the search finds
GROUP_WORDS = 1 << 17  # words of many texts looked at together

RUN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _needed(period: int) -> int:
    """The shortest stretch that the search takes for a run."""
    return max(LEAST, REPEATS * period)


@dataclass(frozen=True)
class Runs:
    """What counts as a run: at least ``least`` words and ``repeats`` periods."""
    least: int = LEAST
    repeats: int = REPEATS

    def __post_init__(self):
        if self.repeats < REPEATS or self.least < LEAST:
            raise ValueError(f"a run has at least {REPEATS} periods and {LEAST} words")


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True stretches of at least ``least`` places."""
    at = np.flatnonzero(same)
    if len(at) < least:
        return at[:0], at[:0]
    breaks = np.flatnonzero(np.diff(at) > 1)
    first = at[np.concatenate([[0], breaks + 1])]
    end = at[np.concatenate([breaks, [len(at) - 1]])] + 1
    long = end - first >= least
    return first[long], end[long]


def _mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (multiply, shift; fixed odd constants)."""
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def _seeds(hashes: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """(period, place) of equal minimizers k to 2k - 1 apart, by period and place."""
    n = len(hashes)
    bits = np.uint64(max(1, n.bit_length()))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    # hash first, place second: the smallest is the leftmost of the smallest hashes
    least = np.where(allowed, (hashes >> bits << bits) | np.arange(n, dtype=np.uint64), none)
    width = 1
    while width < k:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    least = least[least != none]
    if not len(least):
        return np.zeros((0, 2), dtype=np.int64)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    values = hashes[places]
    order = np.lexsort((places, values))
    places, values = places[order], values[order]
    found, step = [], 1
    while step < len(places):
        apart = places[step:] - places[:-step]
        near = (values[step:] == values[:-step]) & (apart < 2 * k)
        if not near.any():
            break
        take = near & (apart >= k)
        found.append(np.stack([apart[take], places[:-step][take]], axis=1))
        step += 1
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    return np.unique(np.concatenate(found), axis=0)


def _reach(words: np.ndarray, a: int, q: int) -> tuple[int, int]:
    """The first place and the end of the stretch around ``a`` where words q apart agree."""
    n, step, low = len(words), 64, a
    while low > 0:
        start = max(0, low - step)
        differ = np.flatnonzero(words[start:low] != words[start + q:low + q])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low, step = start, 2 * step
    high, step = a, 64
    while high + q < n:
        end = min(n - q, high + step)
        differ = np.flatnonzero(words[high:end] != words[high + q:end + q])
        if len(differ):
            high += int(differ[0])
            break
        high, step = end, 2 * step
    return low, high


def find_runs(words: np.ndarray, sizes: list[int], kind: Runs = Runs()) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``words``, by start and period.

    ``words`` holds the word numbers of texts one after another, longest text first,
    each followed by a number found nowhere else; ``sizes`` their lengths with it.
    """
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    short: list[tuple[int, int, int]] = []  # too short for a run, but periodic at the first scale
    n = len(words)

    def keep(start: int, end: int, period: int) -> None:
        found[start, end] = min(period, found.get((start, end), period))

    for q in range(1, min(FIRST, n)):
        least = FIRST if q <= FIRST // 3 else _needed(q)
        for start, end in zip(*(x.tolist() for x in _stretches(words[:-q] == words[q:], least - q))):
            if end + q - start >= _needed(q):
                keep(start, end + q, q)
            else:
                short.append((start, end + q, q))

    k, ends = FIRST, np.cumsum(sizes)
    hashes = _mixed(words.astype(np.uint64))
    width = 1
    while sizes and REPEATS * k < sizes[0]:
        # only texts of at least three times k words can hold such a run
        upto = int(ends[np.searchsorted(-np.array(sizes), -(REPEATS * k + 1), side="right") - 1])
        part = words[:upto]
        hashes = hashes[:upto]
        while width < k:
            hashes = _mixed(hashes[:-width] * np.uint64(3) + _mixed(hashes[width:]))
            width *= 2
        inside = np.zeros(len(hashes) + 1, dtype=np.int32)
        periodic = [(s, e) for (s, e), q in found.items() if q <= k // 3]
        periodic += [(s, e) for s, e, q in short if q <= k // 3]
        for start, end in periodic:
            if end - start >= k and start < len(hashes):
                inside[start] += 1
                inside[min(end - k + 1, len(hashes))] -= 1
        covered: tuple[int, int] = (0, 0)  # period and end of the last stretch
        for q, place in _seeds(hashes, np.cumsum(inside[:-1]) == 0, k).tolist():
            if covered[0] == q and place < covered[1]:
                continue
            start, end = _reach(part, place, q)
            covered = (q, end)
            if end + q - start >= _needed(q):
                keep(start, end + q, q)
        k *= 2
    runs = np.array([(s, e - s, q) for (s, e), q in found.items()
                     if e - s >= max(kind.least, kind.repeats * q)], dtype=np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _of_texts(split: list[list[bytes]], kind: Runs) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of texts split into words."""
    number: dict[bytes, int] = {}
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    words = np.zeros(sum(map(len, split)) + len(split), dtype=np.int64)
    at, starts = 0, []
    for i in order:
        size = len(split[i])
        starts.append(at)
        words[at:at + size] = np.fromiter(map(number.setdefault, split[i], count(at)), np.int64, size)
        words[at + size] = -1 - i
        at += size + 1
    runs = find_runs(words, [len(split[i]) + 1 for i in order], kind)
    repeats = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(repeats, runs[:, 0] + runs[:, 2], 1)
    np.add.at(repeats, runs[:, 0] + runs[:, 1], -1)
    repeated = np.cumsum(repeats[:-1]) > 0
    bounds = np.searchsorted(runs[:, 0], [*starts, len(words)])
    out: list = [None] * len(split)
    for j, i in enumerate(order):
        own = runs[bounds[j]:bounds[j + 1]]
        kept = split[i]
        if len(own):
            gone = repeated[starts[j]:starts[j] + len(kept)]
            kept = [kept[p] for p in np.flatnonzero(~gone).tolist()]
        out[i] = [(s - starts[j], length, q) for s, length, q in own.tolist()], b" ".join(kept)
    return out


def with_runs(df: DataFrame, text_col: str = "text", kind: Runs = Runs()) -> DataFrame:
    """``df`` with ``n_words`` long, ``runs`` (array of start, length, period; by
    start, then period) and ``collapsed`` (the words but those that lie in any run
    after its first period, joined by single spaces) of ``text_col``."""
    added = [("n_words", T.LongType()), ("runs", RUN_TYPE), ("collapsed", T.StringType())]
    kept = [c for c in df.columns if c.lower() not in {n for n, _ in added}]
    rows = df.select(*[F.col(f"`{c}`") for c in kept],
                     F.col(f"`{text_col}`").cast("string").alias(free_name(df, "words_of")))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in added)])
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(batch: pa.RecordBatch, end: int, split: list[list[bytes]]) -> pa.RecordBatch:
            done = _of_texts(split, kind)
            made = [pa.array([len(words) for words in split], pa.int64()),
                    pa.array([[dict(zip(names, r)) for r in runs] for runs, _ in done], _RUNS),
                    pa.array([text.decode() for _, text in done], pa.string())]
            same = batch.slice(end - len(split), len(split)).columns[:-1]
            return pa.RecordBatch.from_arrays([*same, *made], names=schema.fieldNames())

        for batch in batches:
            split, words = [], 0
            for end, raw in enumerate(raw_texts(batch.column(batch.num_columns - 1)), 1):
                # the white space of bytes is what sets words apart: space and 9 to 13
                split.append(raw.split())
                words += len(split[-1]) + 1
                if words >= GROUP_WORDS or end == batch.num_rows:
                    yield piece(batch, end, split)
                    split, words = [], 0

    return numbered(rows).mapInArrow(run, schema)
