"""Token-id files with fixed-width bit packing.

A file is one segment: the documents of a range of ids in ascending order.

========== ================================================================
8 bytes    magic ``TOKBITS1``
6 x u64    bits per id, vocabulary size, ids per block, documents, ids,
           number of the segment within its range
n x i64    document ids (0 where the id is NULL)
n x u8     1 where the document id is NULL
(n+1) x u64 first id of every document, then the number of ids
(b+1) x u64 first byte of every block, counted from the payload, then its size
payload    blocks of ids, the first id in the lowest bits, each block
           starting on a whole byte
1 byte     line feed: end of the segment
========== ================================================================

All numbers are little-endian. An id takes the fewest bits that hold the largest
id of the vocabulary. Any document is read by unpacking the blocks it touches.

Files are written by Spark's own text writer, one record per file, the record
being the raw bytes: they go to whatever store holds the folder, a retried task
leaves no second copy, and reading back is Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import batches_of, range_bounds, range_of, texts
from tallyline.llm.token_ids import encoder
from tallyline.session import checkpoint_root, materialize

MAGIC = b"TOKBITS1"
BLOCK_IDS = 4096
SEGMENT_IDS = 4 << 20


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, the first in the lowest bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little", count=count * bits)
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(
        axis=1, dtype=np.uint32).astype("<u4")


def write_segment(doc_ids: list, sizes: list[int], ids: np.ndarray, vocabulary: int,
                  number: int = 0, block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of one segment; ``ids`` holds all documents one after another."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside a vocabulary of {vocabulary}")
    bits = bits_for(vocabulary)
    blocks = [pack_bits(ids[i:i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    head = np.array([bits, vocabulary, block_ids, len(doc_ids), len(ids), number], dtype="<u8")
    return b"".join([
        MAGIC, head.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype("<u8").tobytes(),
        np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8").tobytes(),
        *blocks, b"\n"])


@dataclass
class Segment:
    """A read-only view of one segment's bytes."""
    raw: bytes | memoryview

    def __post_init__(self):
        view = memoryview(self.raw)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token-id segment")
        head = np.frombuffer(view, "<u8", 6, 8).tolist()
        self.bits, self.vocabulary, self.block_ids, n, self.n_ids, self.number = head
        blocks = -(-self.n_ids // self.block_ids)
        at = 56
        self.ids = np.frombuffer(view, "<i8", n, at)
        self.missing = np.frombuffer(view, np.uint8, n, at := at + 8 * n)
        self.starts = np.frombuffer(view, "<u8", n + 1, at := at + n).astype(np.int64)
        self.blocks = np.frombuffer(view, "<u8", blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        at += 8 * (blocks + 1)
        end = at + (int(self.blocks[-1]) if blocks else 0)
        if len(view) <= end or view[end] != 10:
            raise ValueError("the segment is cut short")
        self.payload = view[at:end]

    def __len__(self) -> int:
        return len(self.ids)

    def doc_id(self, k: int):
        return None if self.missing[k] else int(self.ids[k])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment, unpacking only their blocks."""
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        found = []
        for b in range(first, last + 1):
            count = min(self.block_ids, self.n_ids - b * self.block_ids)
            found.append(unpack_bits(self.payload[self.blocks[b]:self.blocks[b + 1]], count, self.bits))
        base = first * self.block_ids
        return np.concatenate(found)[start - base:stop - base]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(df: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text",
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every row of ``df`` and write it to files under ``folder``.

    Texts are dealt by ranges of ids, whose bounds are found from the ids alone, and
    sorted inside a range (equal ids by text), then encoded and packed as they pass; a
    task holds one segment of about ``segment_ids`` ids. NULL ids come first, a NULL text
    is the end id alone. Other columns, whatever their names, are not read. An empty
    table gives no segment, and reads back as an empty table.
    """
    def run(batches):
        encode = encoder(tokenizer)
        docs, sizes, held, size, number, now = [], [], [], 0, 0, None

        def segment():
            raw = write_segment(docs, sizes, np.concatenate(held), vocabulary, number)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])

        for batch in batches:
            places, ids_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for place, doc, found in zip(places, ids_of, encode.many(texts(batch.column(2)))):
                # a segment holds documents of neighbouring ranges only
                if docs and (size >= segment_ids or place - now > 1):
                    yield segment()
                    docs, sizes, held, size, number = [], [], [], 0, number + 1
                ids = np.append(found, np.uint32(end_id)).astype(np.uint32)
                docs.append(doc)
                sizes.append(len(ids))
                held.append(ids)
                size += len(ids)
                now = place
        if docs:
            yield segment()

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bounds = range_bounds(rows.select("doc_id"), "doc_id")
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds))
    # neighbouring ranges stay together, so files are few: about four groups of them a task
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = -(-len(bounds) // (4 * partitions))
    ordered = (rows.select(place.alias("place"), "doc_id", "text")
               .repartition(partitions, F.floor(F.col("place") / together)).sortWithinPartitions("place", "doc_id", "text"))
    (ordered.mapInArrow(run, "raw binary").select(F.col("raw").cast("string"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder))


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files under ``folder``: (doc_id, start,
    n_tokens, ids_crc32[, ids]). ``start`` counts the ids of all documents
    before it, over all files."""
    out = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64()), ("path", pa.string()), ("first", pa.int64()),
                     ("first_missing", pa.bool_()), ("number", pa.int64()), ("n_ids", pa.int64())]
                    + ([("ids", pa.binary())] if keep_ids else []))

    def run(batches):
        for batch in batches:
            def rows():
                for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    seg = Segment(memoryview(value.as_buffer()))
                    ids = seg.read(0, seg.n_ids)
                    facts = (path, int(seg.ids[0]), bool(seg.missing[0]), seg.number, seg.n_ids)
                    for k in range(len(seg)):
                        raw = ids[seg.starts[k]:seg.starts[k + 1]].tobytes()
                        row = (seg.doc_id(k), int(seg.starts[k]), len(raw) // 4, zlib.crc32(raw), *facts)
                        yield (*row, raw) if keep_ids else row

            yield from batches_of(rows(), out)

    schema = ("doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, path string, first bigint, "
              "first_missing boolean, number bigint, n_ids bigint" + (", ids binary" if keep_ids else ""))
    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("pathGlobFilter", "part-*").load(folder).where("length > 0"))
    rows = materialize(files.select("path", "content").mapInArrow(run, schema), "token-documents")
    # one row per file: a running sum over so few rows may be one task's work
    before = Window.orderBy(F.desc("first_missing"), "first", "number").rowsBetween(
        Window.unboundedPreceding, -1)
    files_in_order = (rows.where("local = 0").groupBy("path", "first_missing", "first", "number", "n_ids")
                      .agg(F.count(F.lit(1))).select(
                          "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")))
    kept = ["doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(files_in_order, "path").select(*kept, *(["ids"] if keep_ids else []))


def token_file_round_trip(df: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2,
                          id_col: str = "doc_id", text_col: str = "text",
                          segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write ``df`` to token files in the shared folder and read them back."""
    folder = os.path.join(checkpoint_root(df.sparkSession), "token_files", uuid.uuid4().hex)
    write_token_files(df, folder, tokenizer, vocabulary, end_id, id_col, text_col, segment_ids)
    return read_token_files(df.sparkSession, folder)
