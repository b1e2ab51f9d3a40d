"""Column-level helpers: pure Spark SQL expressions, no Python UDFs."""

from tallyline.functions.calls import (
    parse_call_line,
    render_call,
    render_call_debug,
    render_call_line,
)
from tallyline.functions.text import split_lines, space_tokens
from tallyline.functions.time import (
    bucket_index,
    epoch_micros,
    ntz_from_micros,
    ltz_from_micros,
)
from tallyline.functions.rates import rate_per_second

__all__ = [
    "parse_call_line",
    "render_call",
    "render_call_line",
    "render_call_debug",
    "split_lines",
    "space_tokens",
    "bucket_index",
    "epoch_micros",
    "ntz_from_micros",
    "ltz_from_micros",
    "rate_per_second",
]
