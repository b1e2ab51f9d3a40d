"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources import read_table

#: Words are runs of anything but space and the control characters 9 to 13.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by number: ``mapInArrow`` takes no names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``, equals ``remainder``. A NULL
    id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.crc32(text) % modulus == remainder


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


#: Rows of a range, and most ranges, of :func:`range_bounds`.
RANGE_ROWS = 1024
MOST_RANGES = 10_000
MIN_LONG = -(1 << 63)


def range_bounds(places: DataFrame, column: str, rows: int = RANGE_ROWS) -> list[int]:
    """Lower bounds of ranges of a BIGINT column with about ``rows`` rows each, the
    first below everything. At most :data:`MOST_RANGES`. Only the column is read, while
    ``repartitionByRange`` reads whole rows to find its bounds."""
    n = places.count()
    ranges = max(1, min(MOST_RANGES, n // rows))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = places.agg(F.percentile_approx(column, shares, max(10_000, 20 * ranges))).first()[0]
    return [MIN_LONG, *sorted({c for c in cuts if c > MIN_LONG})]


def range_of(place: Column, bounds: list[int]) -> Column:
    """Number of the range that holds ``place``: a look into every k-th bound,
    then into the k bounds from there."""
    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= place)) - 1

    k = math.isqrt(len(bounds) - 1) + 1
    rows = [F.array(*[F.lit(b).cast("bigint") for b in bounds[i:i + k]]) for i in range(0, len(bounds), k)]
    row = upto(F.array(*[F.lit(b).cast("bigint") for b in bounds[::k]]))
    return (row * k + upto(F.get(F.array(*rows), row))).cast("int")


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one value at a time; NULL is empty."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def texts(column: pa.Array) -> Iterator[str]:
    """The values of a string column, one at a time; NULL is empty."""
    for value in column:
        yield value.as_py() or ""


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
