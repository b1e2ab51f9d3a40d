"""Call record text format: ``"<vote_id> <phone_number> <contestant_number> <timestamp>"``.

One space separates fields; fields after the fourth are ignored. Types are
BIGINT, BIGINT, INT, INT (ten-digit phone numbers overflow INT).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL_FIELDS = (
    ("vote_id", "bigint"),
    ("phone_number", "bigint"),
    ("contestant_number", "int"),
    ("timestamp", "int"),
)


def parse_call_line(value: Column | str, strict: bool = True) -> Column:
    """Parse one text line into a struct of the four call fields.

    ``strict=True`` fails the task on a malformed line (too few fields, a
    non-numeric or out-of-range field), whatever the ANSI setting of the
    session. ``strict=False`` yields NULL for the whole struct instead, so
    the caller can route rejects to a side output.
    """
    value = F.col(value) if isinstance(value, str) else value
    parts = F.split(value, " ", -1)
    fields = [F.get(parts, i).try_cast(dtype).alias(name)
              for i, (name, dtype) in enumerate(CALL_FIELDS)]
    ok = None
    for f in fields:
        ok = f.isNotNull() if ok is None else (ok & f.isNotNull())
    parsed = F.struct(*fields)
    if strict:
        return F.when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("malformed call line: "), F.coalesce(value, F.lit("NULL"))))
        )
    return F.when(ok, parsed)


def render_call(vote_id: Column, phone_number: Column, contestant_number: Column,
                timestamp: Column) -> Column:
    """Space-joined record, the value stored per accepted vote."""
    return F.concat_ws(" ", vote_id.cast("string"), phone_number.cast("string"),
                       contestant_number.cast("string"), timestamp.cast("string"))


def render_call_line(vote_id: Column, phone_number: Column, contestant_number: Column,
                     timestamp: Column) -> Column:
    """Record with the trailing newline, as printed for debugging."""
    return F.concat(render_call(vote_id, phone_number, contestant_number, timestamp), F.lit("\n"))


# Fixed value: prefix of the debug form of a call record.
DEBUG_PREFIX = "call : "


def render_call_debug(vote_id: Column, phone_number: Column, contestant_number: Column,
                      timestamp: Column) -> Column:
    """Debug form: ``"call : <vote_id>-<phone>-<contestant>-<timestamp>"``."""
    return F.concat(F.lit(DEBUG_PREFIX), F.concat_ws(
        "-", vote_id.cast("string"), phone_number.cast("string"),
        contestant_number.cast("string"), timestamp.cast("string")))
