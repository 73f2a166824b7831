"""Parsing helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.geo import col


def try_double(c) -> Column:
    return F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")


def parse_slip_rate(text) -> Column:
    """First number of ``(best,min,max)`` or of a bare number; anything else is null."""
    number = F.regexp_extract(F.trim(col(text)), r"^\(?\s*([0-9]*\.?[0-9]+)", 1)
    return F.nullif(number, F.lit("")).try_cast("double")


def fields(line) -> Column:
    """Whitespace-delimited fields of a text line."""
    return F.split(F.trim(col(line)), r"\s+")


def stable_event_id(event_id, time, lat, lon) -> Column:
    """The id, or a key from time and position rounded to four decimals when it is missing."""
    def rounded(c):
        return F.format_string("%.4f", F.round(col(c), 4))

    made = F.concat_ws("|", F.date_format(col(time), "yyyy-MM-dd HH:mm:ss"), rounded(lat), rounded(lon))
    return F.coalesce(F.nullif(col(event_id), F.lit("")), made)


def parse_timestamp(text) -> Column:
    """Text to TIMESTAMP_NTZ; bad text becomes null."""
    return col(text).try_cast("timestamp_ntz")


def epoch_ms(c) -> Column:
    """Epoch milliseconds to a UTC wall-clock timestamp."""
    return F.timestamp_millis(col(c)).cast("timestamp_ntz")
