"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 16 bytes has a run of
zero bits at the top: more zeros are asked for below the normal chunk size and
fewer above it, so chunk sizes gather around the normal one; a smallest and a
largest size hold in any case. Boundaries depend on nearby bytes only, so an edit
moves the chunks around it and no others.

Chunks are small, about ``Chunking.normal`` = 16 bytes in texts of any length: half of a short
text still holds some of them, and a short text is found within a long one.

A fingerprint is the set of (digest, length) of a text's chunks as sorted 8-byte
records (48 bits of digest and 16 bits of length) in base64. Containment of one text in
another is the share of its chunk bytes whose chunks the other has too.

Defined results: a NULL or empty text has the empty fingerprint, which any
empty text contains fully (1.0) and no other text does (0.0). Equal texts have
equal fingerprints. For :func:`next_document_likeness`, NULL ids come first,
rows with equal ids follow each other by text, and a single row is its own next
document. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import MIN_LONG, batches_of, range_bounds, range_of, texts

#: Random 16-bit words by rule: the hash of the byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) >> 16 for b in range(256)], dtype=np.uint16)
BLOCK = 1 << 22  # bytes hashed at a time
BUCKET_DOCS = 1024
WORD = 16  # bits of a gear hash, and bytes that it depends on
REACH = WORD - 1  # earlier bytes that a gear hash depends on


@dataclass(frozen=True)
class Chunking:
    """Chunk sizes in bytes; ``normal`` is a power of two."""
    least: int = 4
    normal: int = 16
    most: int = 64

    def __post_init__(self):
        if not 0 < self.least < self.normal < self.most < 1 << 16 or self.normal >= 1 << (WORD - 1):
            raise ValueError("sizes must rise and stay below 65536, the normal one below 32768")


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum of GEAR[byte j back] << j, mod 2^16."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    return h


def _cut_places(raw: np.ndarray, sizes: Chunking) -> tuple[list[int], list[int]]:
    """Ends of chunks that the strict and the loose condition allow."""
    bits = sizes.normal.bit_length() - 1
    strict, loose = [], []
    for start in range(0, len(raw), BLOCK):
        back = min(start, REACH)
        h = gear_hashes(raw[start - back:start + BLOCK])[back:]
        at = np.flatnonzero(h >> np.uint16(WORD - bits + 1) == 0)
        loose += (at + (start + 1)).tolist()
        strict += (at[h[at] >> np.uint16(WORD - bits - 1) == 0] + (start + 1)).tolist()
    return strict, loose


def chunk_ends(raw: bytes, sizes: Chunking = Chunking()) -> list[int]:
    """Where the chunks of ``raw`` end, the last at its length."""
    n = len(raw)
    strict, loose = _cut_places(np.frombuffer(raw, np.uint8), sizes)
    strict.append(n + sizes.most)
    loose.append(n + sizes.most)
    ends, start = [], 0
    while n - start > sizes.least:
        end = strict[bisect_left(strict, start + sizes.least)]
        if end >= start + sizes.normal:
            end = min(loose[bisect_left(loose, start + sizes.normal)], start + sizes.most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(raw: bytes, sizes: Chunking = Chunking()) -> dict[int, int]:
    """Digest (48 bits) to length of every different chunk."""
    ends = chunk_ends(raw, sizes)
    digest = xxhash.xxh3_64_intdigest
    return {digest(raw[start:end]) >> 16: end - start for start, end in zip([0, *ends], ends)}


def to_string(chunks: dict[int, int]) -> str:
    records = np.sort(np.fromiter(((d << 16) | n for d, n in chunks.items()), dtype=np.uint64, count=len(chunks)))
    return base64.b64encode(records.astype(">u8").tobytes()).decode()


def from_string(fingerprint: str) -> dict[int, int]:
    records = np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").tolist()
    return {r >> 16: r & 0xFFFF for r in records}


def containment(of: dict[int, int], within: dict[int, int]) -> float:
    """Share of the chunk bytes of ``of`` that ``within`` has too."""
    if not of:
        return 0.0 if within else 1.0
    return sum(of[d] for d in of.keys() & within.keys()) / sum(of.values())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 sizes: Chunking = Chunking()) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            out = pa.schema([("doc_id", batch.schema.field(0).type), ("fingerprint", pa.string())])
            yield from batches_of(((d, to_string(chunk_set(t.encode(), sizes))) for d, t in
                                   zip(batch.column(0).to_pylist(), texts(batch.column(1)))), out)

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def next_document_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           sizes: Chunking = Chunking()) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half (in
    code points, rounded down) is replaced by the first as many of the next
    document by ascending id, the first after the last; with the containment of
    the document in its edited text and in the next document.

    Texts are shuffled once, by ranges of ids whose bounds are known beforehand,
    and pass through a task in order, two at a time. The first document of every
    range is also sent to the range before it.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(MIN_LONG)))
    bounds = range_bounds(rows.select("place"), "place", BUCKET_DOCS)
    dealt = rows.withColumn("bucket", range_of(F.col("place"), bounds))
    # ranges that hold rows, a few thousand at most, and the range before each
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min("place").alias("place")).collect())
    before = {place: firsts[i - 1][0] for i, (_, place) in enumerate(firsts)}
    ends = df.sparkSession.createDataFrame(list(before.items()), "place bigint, before int")
    heads = (dealt.join(F.broadcast(ends), "place").groupBy("before", "place")
             .agg(F.min("text").alias("text")))
    passing = (dealt.select("bucket", F.lit(0).alias("guest"), "place", "text", "doc_id")
               .union(heads.select("before", F.lit(1), "place", "text", F.lit(None).cast("bigint")))
               .repartition("bucket").sortWithinPartitions("bucket", "guest", "place", "text"))

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        def results():
            held = None
            for batch in batches:
                facts = zip(*[batch.column(i).to_pylist() for i in (0, 1, 4)])
                for (bucket, guest, doc), text in zip(facts, texts(batch.column(3))):
                    now = (bucket, guest, doc, text, chunk_set(text.encode(), sizes))
                    if held and not held[1]:
                        yield _compare(held[2], held[3], held[4], text, now[4], sizes)
                    held = now

        yield from batches_of(results(), schema)

    return passing.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def _compare(doc, text: str, chunks: dict, following: str, next_chunks: dict, sizes: Chunking) -> tuple:
    half = len(text) // 2
    edited = (text[:len(text) - half] + following[:half]).encode()
    edited_chunks = chunk_set(edited, sizes)
    return (doc, len(text), hashlib.sha256(edited).hexdigest(), to_string(chunks), to_string(edited_chunks),
            containment(chunks, edited_chunks), containment(chunks, next_chunks))
