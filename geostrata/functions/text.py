"""Timestamps and replication addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats: the four that are read, in this order.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH-mm-ss", "yyyyMMdd")


def _epoch(ntz: Column) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    days = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)


def parse_timestamp(text: Column) -> Column:
    """F30. Epoch seconds in UTC; null if no format fits."""
    return F.coalesce(*[_epoch(F.call_function("try_to_timestamp", text, F.lit(f)).cast("timestamp_ntz")) for f in FORMATS])


def _parts(seconds: Column) -> list[Column]:
    """Date, hour, minute and second as text."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return [day, two(F.floor(rest / 3600)), two(F.floor(rest % 3600 / 60)), two(rest % 60)]


def timestamp_string(seconds: Column, separator: str = ":") -> Column:
    """yyyy-mm-ddThh:mm:ss in UTC; with '-' the form that file names use."""
    day, h, m, s = _parts(seconds)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.concat_ws(separator, h, m, s))


def date_string(seconds: Column) -> Column:
    return F.date_format(_parts(seconds)[0], "yyyyMMdd")


def _numbered(state: Column) -> Column:
    three = lambda n: F.lpad(n.cast("long").cast("string"), 3, "0")
    return F.concat_ws("/", three(F.floor(state / 1000000)), three(F.floor(state % 1000000 / 1000)), three(state % 1000))


def diff_url(prefix: str, state: Column) -> Column:
    return F.concat(F.lit(prefix), _numbered(state), F.lit(".osc.gz"))


def state_url(prefix: str, state: Column) -> Column:
    """The address of a state; without one, of the newest."""
    return F.when(state.isNull(), F.lit(prefix + "state.txt")).otherwise(F.concat(F.lit(prefix), _numbered(state), F.lit(".state.txt")))
