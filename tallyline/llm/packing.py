"""Best-fit packing of token sequences under several capacities at once.

Every sequence has a residual vector: tokens, documents and attention cost (the
sum of squared piece lengths). A piece goes to the open sequence, among those that
can take it in every dimension, whose weighted score is best:

* ``norm``: the least weighted norm of the residual that would be left;
* ``dot``: the least weighted dot product of demand and residual.

Both are shares of the capacities, so that dimensions can be compared. Pieces are
taken from long to short. A document longer than the token capacity is cut from
its end into full pieces; its first piece takes the rest.

Pieces are dealt to groups of about ``group_size`` by a hash of document and piece
number, and each group is packed by one task: memory and time of a task stay
bounded, a document of any length spreads over the groups, and what a group can
lose against one large packing is its last open sequences, a few in thousands.

Defined results: a NULL or empty text is one piece with the end id alone. A
repeated row is packed again. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import batches_of, texts
from tallyline.llm.token_ids import encoder
from tallyline.session import materialize

GROUP_SIZE = 8192


@dataclass(frozen=True)
class Capacities:
    """Limits of one sequence and the weights of its three dimensions. The
    defaults bind tokens only: no 1024 tokens hold more documents or cost more."""
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"

    def __post_init__(self):
        if self.score not in ("norm", "dot"):
            raise ValueError(f"unknown score {self.score!r}")
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("capacities must be positive")

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, int(self.attention ** 0.5))


def piece_bounds(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % longest or min(n, longest)
    return [(0, first), *[(s, longest) for s in range(first, n, longest)]]


def best_fit(lengths: np.ndarray, limits: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weights = np.array(limits.weights)
    order = np.argsort(-lengths, kind="stable")
    smallest = float(lengths.min()) if len(lengths) else 0.0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residual = np.zeros((len(lengths), 3))
    number = np.zeros(len(lengths), np.int64)
    open_bins = made = 0
    full = np.array([smallest, 1.0, smallest * smallest])
    for at in order.tolist():
        size = float(lengths[at])
        demand = np.array([size, 1.0, size * size])
        left = residual[:open_bins]
        fits = np.flatnonzero((left[:, 0] >= size) & (left[:, 1] >= 1.0) & (left[:, 2] >= demand[2]))
        if len(fits):
            if limits.score == "norm":
                rest = (left[fits] - demand) / caps
                cost = (rest * rest) @ weights
            else:
                cost = (left[fits] / caps) @ (weights * demand / caps)
            row = int(fits[np.argmin(cost)])
        else:
            row = open_bins
            residual[row], number[row] = caps, made
            open_bins, made = open_bins + 1, made + 1
        bins[at] = number[row]
        offsets[at] = int(caps[0] - residual[row, 0])
        residual[row] -= demand
        if (residual[row] < full).any():  # nothing left to come fits: close it
            open_bins -= 1
            residual[row], number[row] = residual[open_bins], number[open_bins]
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, end_id: int, limits: Capacities,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids]).
    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers."""
    kind = dict(df.dtypes)[id_col]
    schema = (f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + (", ids binary" if keep_ids else ""))
    longest = limits.longest

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            out = pa.schema([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()),
                             ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                            + ([("ids", pa.binary())] if keep_ids else []))

            def rows():
                for doc, found in zip(batch.column(0).to_pylist(), encode.many(texts(batch.column(1)))):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for k, (start, size) in enumerate(piece_bounds(len(ids), longest)):
                        raw = ids[start:start + size].tobytes()
                        row = (doc, k, start, size, zlib.crc32(raw))
                        yield (*row, raw) if keep_ids else row

            yield from batches_of(rows(), out)

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def pack(rows: DataFrame, limits: Capacities = Capacities(), group_size: int = GROUP_SIZE) -> DataFrame:
    """``rows`` of :func:`pieces` (already written out) plus sequence_id and offset."""
    n = rows.count()
    groups = max(1, round(n / group_size))
    # the row number keeps repeated rows and NULL ids from meeting in one group
    row = F.monotonically_increasing_id()
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(groups)))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        group = table.column("group")[0].as_py()
        bins, offsets = best_fit(table.column("length").to_numpy(), limits)
        out = table.drop_columns(["group"])
        return (out.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    return dealt.groupBy("group").applyInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 2, limits: Capacities = Capacities(),
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
                   group_size: int = GROUP_SIZE) -> DataFrame:
    """Encode, cut and pack all rows of ``df``."""
    rows = materialize(pieces(df, tokenizer, end_id, limits, id_col, text_col, keep_ids), "pieces")
    return pack(rows, limits, group_size)
