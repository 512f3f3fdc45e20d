"""The shape of events: what every parser gives, whatever the format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of every event; extra holds what only some formats have, as text.
COLUMNS = {
    "path": "string", "line_number": "int", "timestamp_utc": "timestamp", "timestamp_raw": "string", "timezone_assumed": "boolean", "host": "string", "artifact_type": "string", "event_type": "string",
    "actor": "string", "src_ip": "string", "dst_ip": "string", "target": "string", "command": "string", "raw": "string", "tags": "array<string>", "extra": "map<string,string>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

# The kinds of events that parsers may give.
EVENT_TYPES = (
    "auth.login.success", "auth.login.failure", "auth.logout", "auth.sudo", "auth.su", "auth.session.open", "auth.session.close", "user.create", "user.delete", "user.modify", "group.modify",
    "password.change", "ssh.key.added", "ssh.key.present", "cron.exec", "cron.modify", "cron.entry", "config.entry", "service.start", "service.stop", "service.create", "process.exec",
    "package.install", "package.upgrade", "package.remove", "web.request", "web.error", "kernel.message", "system.boot", "system.shutdown", "log.gap", "log.cleared", "shell.command", "parse_error", "other",
)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group(text: Column, pattern: str, number: int) -> Column:
    """A group of the first match; null if there is no match or the group is empty."""
    return empty_to_null(F.regexp_extract(text, pattern, number))


def tags(*parts: Column | str) -> Column:
    """An array of those parts that aren't null."""
    return F.array_compact(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def labelled(label: str, value: Column) -> Column:
    """label:value, null if there is no value."""
    return F.concat(F.lit(f"{label}:"), value)


def extra(**values: Column) -> Column:
    """A map of those values that aren't null."""
    pairs = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in values.items()))
    return F.map_from_entries(F.array_compact(pairs))


def shaped(rows: DataFrame, artifact: str, parsed: Column | None = None, reason: str = "", **values: Column) -> DataFrame:
    """rows as events. Where parsed is false, a parse_error with the tag error:reason and no other value; unknown event types become other."""
    values = {"raw": F.col("line"), "timezone_assumed": F.lit(False)} | values
    ok = F.lit(True) if parsed is None else F.coalesce(parsed, F.lit(False))
    kind = values.pop("event_type")
    known = kind.isin(*EVENT_TYPES)
    given = values.get("tags", F.array().cast("array<string>"))
    values["tags"] = F.when(known, given).otherwise(F.concat(given, tags(labelled("unknown_event_type", kind))))
    values["event_type"] = F.when(known, kind).otherwise("other")
    fail = {"event_type": F.lit("parse_error"), "tags": F.array(F.lit(f"error:{reason}")), "raw": values["raw"], "timezone_assumed": F.lit(False)}
    out = []
    for name, kind in COLUMNS.items():
        if name in ("path", "line_number"):
            out.append(F.col(name).cast(kind))
        elif name == "artifact_type":
            out.append(F.lit(artifact).alias(name))
        else:
            value, none = values.get(name, F.lit(None)).cast(kind), F.lit(None).cast(kind)
            out.append((value if parsed is None else F.when(ok, value).otherwise(fail.get(name, none).cast(kind))).alias(name))
    return rows.select(*out)


def local_time(year: Column, month: Column, day: Column, clock: Column, zone: str) -> Column:
    """The instant of a wall clock's time (hh:mm:ss, with or without a fraction) in a zone; null if there is no such date.

    In a gap of summer time the clock goes on, of an hour that comes twice it is the first.
    """
    parts = F.split(clock, ":")
    return F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("decimal(8,6)"), F.lit(zone))


def stamp_time(text: Column, zone: str) -> Column:
    """Of yyyy-mm-dd hh:mm:ss (any separators of one character): the instant in a zone."""
    return local_time(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2), F.substring(text, 12, 20), zone)


# Months as logs write them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_number(name: Column) -> Column:
    """1 to 12; null if it is no month's name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)).cast("int")


def user_of(path: Column) -> Column:
    """Whose home a path is in, the innermost one."""
    home = F.regexp_extract(path, r".*/(?:home/([^/]+)|root)/", 0)
    return F.when(home != "", F.when(home.rlike(r"/home/[^/]+/$"), F.regexp_extract(home, r"/home/([^/]+)/$", 1)).otherwise("root"))


def with_ids(events: DataFrame) -> DataFrame:
    """events with id, which follows from the file, the line and what the line says, so it is the same in each run; and micros."""
    return events.withColumns({"id": F.xxhash64("path", "line_number", "event_type", "target"), "micros": F.unix_micros("timestamp_utc")})
