"""Time as whole microseconds, so that window frames are exact and don't depend on the session's time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def span_micros(span: str) -> int:
    """Of a span such as 30s, 5m, 1h, 2d."""
    m = re.fullmatch(r"(\d+)([smhd])", span)
    if not m:
        raise ValueError(f"not a time span: {span!r}")
    return int(m[1]) * _UNITS[m[2]] * 1_000_000


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, read as UTC."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), ts)
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (seconds * 1_000_000).cast("long")


def wall_clock(ts: Column, zone: str = "UTC") -> Column:
    """The time without a zone that clocks show in a zone at an instant (a timestamp); the session's zone plays no part, and F.hour and the like read it as it is."""
    seconds = (F.unix_micros(ts).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def iso(micros: Column) -> Column:
    """Microseconds since 1970 as ISO 8601 in UTC, with microseconds if there are any."""
    seconds = F.floor(micros / 1_000_000)
    rest = micros - seconds * 1_000_000
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    clock = F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = F.concat(day, F.lit("T"), two(F.floor(clock / 3600)), F.lit(":"), two(F.floor(clock % 3600 / 60)), F.lit(":"), two(clock % 60))
    return F.concat(text, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("long").cast("string"), 6, "0"))), F.lit("+00:00"))


def literal_micros(text: str) -> int:
    """Of an ISO 8601 time; without an offset it is UTC. Raises ValueError on anything else."""
    from datetime import UTC, datetime, timedelta

    at = datetime.fromisoformat(text.strip())
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
