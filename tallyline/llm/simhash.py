"""Near-duplicate documents by SimHash, found through segment bit counts.

A 64-bit fingerprint is embedded as 32 counts: the number of set bits of each
two-bit segment (0, 1 or 2). One flipped bit changes one count by one, so the
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, and pairs farther apart than the limit in counts need no look at
the bits. Counts are kept in unary inside one BIGINT (00, 01, 11), which makes
the Manhattan distance the number of differing bits of two such words.

The range join works on a grid: the 32 counts form four bands of eight. If two
embeddings are within distance 2, at least two of the four bands agree fully, so
both fingerprints fall into the same cell of one of six two-band grids. Pairs
inside a cell are checked by Manhattan distance, then by exact Hamming distance.

Equal fingerprints are one row before anything is compared. A cell with more than
``cell_limit`` different fingerprints is not paired: its members meet at hubs
instead. A hub is a fingerprint or one with a single bit flipped, so a hub has at
most 65 members, any two of them differ in at most 2 bits, and any two
fingerprints that differ in at most 2 bits share a hub. Each dense fingerprint
costs 65 rows whatever its cell's size, and no link is lost.

Defined results: NULL and empty texts, and texts of blanks only, have fingerprint
0 and link like any other. One or two words make one shingle. A repeated row gets
its own result row. A NULL id never becomes a component id unless its component
has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import free_name, raw_texts
from tallyline.llm.components import components
from tallyline.session import materialize

SHINGLE = 3
MAX_BITS = 2
CELL_LIMIT = 48
SEED = 42
LOW = 0x5555555555555555  # the lower bit of every two-bit segment
CHUNK = 200_000  # shingles hashed at a time

_digest = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    words = raw.lower().split()  # bytes: only A-Z change, only 9-13 and 32 split
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    left = n
    while left > 0:
        hashes = np.fromiter((_digest(g) for g, _ in zip(grams, range(min(left, CHUNK)))), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        left -= len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` plus the BIGINT column ``out_col``; rows keep their place."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(t, shingle) for t in raw_texts(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.LongType())]))


def bit_counts(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint, in unary inside one BIGINT."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _band_masks() -> list[int]:
    bands = [0xFFFF << (16 * b) for b in range(4)]
    return [_signed(a | b) for a, b in combinations(bands, 2)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of different
    fingerprints (column ``fp``, no repeats) within ``max_bits`` bits."""
    if max_bits not in (0, 1, 2):
        raise ValueError("the two-band grids hold for at most 2 bits")
    counts = fps.select("fp", bit_counts(F.col("fp")).alias("counts"))
    cells = counts.select("fp", F.posexplode(F.array(*[
        F.col("counts").bitwiseAND(F.lit(m)) for m in _band_masks()])).alias("grid", "cell"))
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(cells.join(sizes, ["grid", "cell"]), "shared-cells")

    def near(a: Column, b: Column) -> Column:
        return ((b > a) & (F.bit_count(bit_counts(a).bitwiseXOR(bit_counts(b))) <= max_bits)
                & (F.bit_count(a.bitwiseXOR(b)) <= max_bits))

    small = (shared.where(F.col("members") <= cell_limit).groupBy("grid", "cell")
             .agg(F.collect_list("fp").alias("fps")))
    pairs = small.select(F.explode(F.flatten(F.transform("fps", lambda a: F.transform(
        F.filter("fps", lambda b: near(a, b)),
        lambda b: F.struct(a.alias("u"), b.alias("v")))))).alias("e")).select("e.u", "e.v")

    dense = shared.where(F.col("members") > cell_limit).select("fp").distinct()
    if max_bits == 2:
        flips = F.concat(F.array(F.lit(0).cast("bigint")),
                         F.transform(F.sequence(F.lit(0), F.lit(63)), _one_bit))
        hubs = dense.select("fp", F.explode(flips).alias("flip")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
        met = hubs.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    elif max_bits == 1:
        # a partner within one bit is itself a hub of the fingerprint
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), _one_bit)
        near_one = dense.select(F.col("fp").alias("u"), F.explode(flips).alias("flip")).select(
            "u", F.col("u").bitwiseXOR(F.col("flip")).alias("v"))
        stars = near_one.join(dense.select(F.col("fp").alias("v")), "v").select("u", "v")
    else:
        return pairs.where(F.lit(False))
    return pairs.union(stars)


def _one_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def with_root(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``fps`` (column ``fp`` without repeats) with ``root``, which names the component."""
    roots = components(links(fps.select("fp"), max_bits, cell_limit)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(rows: DataFrame, fp: str, id_col: str, max_bits: int = MAX_BITS,
            cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``rows``: ``root``
    names the component, ``component_id`` is its smallest id."""
    fps = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("first_id")), "fingerprints")
    placed = with_root(fps, max_bits, cell_limit)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialize(placed.drop("first_id").join(least, "root").select("fp", "root", "component_id"),
                       "fingerprint-classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``df``."""
    rows = materialize(with_fingerprint(
        df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", "fp", shingle)
        .drop("text"), "simhash")
    found = classes(rows, "fp", "doc_id", max_bits)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every component of ``df`` (the smallest id, then the row read
    first), with the columns of ``df``.

    Rows are told apart by a number written beside them, so repeated rows and
    NULL ids are handled. The first row of every fingerprint, then of every component is
    found by partial aggregates, and joins are by fingerprint or number, so no
    component or group of copies meets in one task. Only the numbers of dropped
    rows are joined to the texts.
    """
    fp, row = free_name(df, "fp"), free_name(df, "row_number")
    rows = materialize(with_fingerprint(df, text_col, fp, shingle)
                       .withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    slim = rows.select(F.col(f"`{fp}`").alias("fp"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{row}`").alias("row"))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    fps = materialize(slim.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    kept = with_root(fps, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    losers = materialize(slim.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)),
                         "simhash-dropped")
    return rows.join(losers, row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
