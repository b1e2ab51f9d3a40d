"""Readers: parquet tables, text lines, the call view and the metric table."""

from tallyline.sources.tables import read_table, spread
from tallyline.sources.calls import (
    CallViewSpec,
    call_view,
    call_lines,
    parse_calls,
    parse_calls_lenient,
    read_call_lines,
)
from tallyline.sources.text import document_lines, read_text_lines

__all__ = [
    "read_table",
    "spread",
    "CallViewSpec",
    "call_view",
    "call_lines",
    "parse_calls",
    "parse_calls_lenient",
    "read_call_lines",
    "document_lines",
    "read_text_lines",
]
