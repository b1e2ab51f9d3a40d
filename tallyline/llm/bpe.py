"""Byte-level BPE with a local rank file, by the tiktoken library.

The splitting pattern never matches across a place where white space follows
something else, so a long text is cut at such places and its parts are encoded one
by one; the ids are those of the whole text. A very long run of white space is one
match but for its last character, and is merged as such, since the library's
pattern engine keeps a step for each character of it.

Ids travel as little-endian unsigned 32-bit numbers in a BINARY column; decoding
joins the bytes of the ranks, without any reading as text, so ids that end inside
a character come back exactly.

Defined results: a NULL or empty text has no ids and decodes to no bytes; NULL ids
decode to no bytes. Repeated rows are encoded again. Other columns pass through;
an output column that exists already is refused.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.common import texts
from tallyline.llm.token_ids import WHITE

PART_CHARS = 1 << 16
LONG_GAP = 4096

_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_GAP = re.compile(f"[{WHITE}]{{{LONG_GAP},}}")


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The library's encoder for a rank file (base64 bytes and rank per line)."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only where white
    space follows something else. A longer stretch without such a place stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


def encode_text(enc, text: str, limit: int = PART_CHARS) -> np.ndarray:
    """The ids of ``text`` as unsigned 32-bit numbers, without special tokens."""
    if len(text) <= min(limit, LONG_GAP):
        return enc.encode_to_numpy(text, disallowed_special=())
    found, start = [], 0
    for gap in _GAP.finditer(text):
        last = gap.end() if gap.end() == len(text) else gap.end() - 1
        found += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text[start:gap.start()], limit)]
        found.append(np.array(enc._encode_single_piece(text[gap.start():last]), dtype=np.uint32))
        start = last
    found += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text[start:], limit)]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
           ids_col: str = "token_ids", part_chars: int = PART_CHARS) -> DataFrame:
    """``df`` with the ids of ``text_col`` in the BINARY column ``ids_col``, in
    the place of the text."""
    def one(column):
        enc = encoding(rank_file, pattern)
        return [encode_text(enc, t, part_chars).astype("<u4").tobytes() for t in texts(column)]

    return _replace(df, text_col, ids_col, one)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids",
           bytes_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with the bytes that the ids stand for in the BINARY column ``bytes_col``."""
    def one(column):
        enc = encoding(rank_file, pattern)
        return [enc.decode_bytes(np.frombuffer(v.as_buffer(), "<u4").tolist()) if v.is_valid else b""
                for v in column]

    return _replace(df, ids_col, bytes_col, one, keep=keep_ids)


def _replace(df: DataFrame, source: str, target: str, compute, keep: bool = False) -> DataFrame:
    if target.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the column {target} exists already")
    at = df.columns.index(source)
    fields = [f for i, f in enumerate(df.schema.fields) if keep or i != at]

    def run(batches):
        for batch in batches:
            kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if keep or i != at]
            step = 256  # rows of raw values held beside the batch
            for i in range(0, batch.num_rows, step):
                made = pa.array(compute(batch.column(at).slice(i, step)), pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(i, step) for _, c in kept], made],
                                                 names=[*[n for n, _ in kept], target])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(target, T.BinaryType())]))
