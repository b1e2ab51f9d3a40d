"""Time arithmetic on epoch microseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970-01-01 of ``df[column]``.

    TIMESTAMP_NTZ values are taken as UTC wall-clock time; TIMESTAMP values
    are instants already.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.TimestampNTZType):
        # Built from the value's own fields: any cast to TIMESTAMP would go
        # through the session time zone and shift wall-clock times that fall
        # in a daylight-saving gap.
        ts = F.col(column)
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
        seconds = F.date_part(F.lit("SECOND"), ts)  # DECIMAL(8,6): seconds with micros
        return (days * F.lit(86_400_000_000) + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
                + F.minute(ts).cast("bigint") * F.lit(60_000_000)
                + (seconds * F.lit(1_000_000)).cast("bigint"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(column))
    raise TypeError(f"{column} is {dtype.simpleString()}, not a timestamp")


def ntz_from_micros(micros: Column) -> Column:
    """TIMESTAMP_NTZ holding the UTC wall-clock time of an epoch-micros value."""
    return F.timestamp_add("MICROSECOND", micros, F.expr(_NTZ_EPOCH))


def ltz_from_micros(micros: Column) -> Column:
    """TIMESTAMP (instant) of an epoch-micros value, e.g. for ``withWatermark``."""
    return F.timestamp_micros(micros)


def bucket_index(micros: Column, origin_seconds: int, width_seconds: int, width_us: int | None = None) -> Column:
    """``floor((t - origin) / width)``: the batch or slide bucket of a time;
    ``width_us`` for widths that are no whole seconds."""
    width_us = int(width_seconds) * 1_000_000 if width_us is None else width_us
    origin_us = int(origin_seconds) * 1_000_000
    since = micros - F.lit(origin_us)
    # whole numbers throughout: a DOUBLE quotient is not exact for far dates
    return F.call_function("div", since - F.pmod(since, F.lit(width_us)), F.lit(width_us))
