"""The timeline: events filtered, ordered and paged."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import from_python
from ..functions.times import iso


@dataclass(frozen=True)
class TimelineQuery:
    """What to show. start and end are inclusive micros; types match exactly or as a prefix before a dot; ids is None for all."""

    start: int | None = None
    end: int | None = None
    types: list[str] = field(default_factory=list)
    artifact: str | None = None
    actor: str | None = None
    ip: str | None = None
    host: str | None = None
    ids: list[int] | None = None
    grep: str | None = None
    limit: int = 200
    offset: int = 0

    def predicate(self) -> Column:
        tests = []
        if self.start is not None:
            tests.append(F.col("micros") >= self.start)
        if self.end is not None:
            tests.append(F.col("micros") <= self.end)
        if self.types:
            tests.append(reduce(lambda a, b: a | b, ((F.col("event_type") == t) | F.col("event_type").startswith(t + ".") for t in self.types)))
        for name, value in (("artifact_type", self.artifact), ("actor", self.actor), ("host", self.host)):
            if value is not None:
                tests.append(F.col(name) == value)
        if self.ip is not None:
            tests.append((F.col("src_ip") == self.ip) | (F.col("dst_ip") == self.ip))
        if self.ids is not None:
            tests.append(F.col("id").isin(self.ids) if self.ids else F.lit(False))
        if self.grep is not None:
            tests.append(F.col("raw").rlike(from_python(self.grep, ignore_case=True)))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def matching(events: DataFrame, query: TimelineQuery) -> DataFrame:
    """All events that match."""
    return events.where(query.predicate())


def page(events: DataFrame, query: TimelineQuery) -> DataFrame:
    """The page asked for, undated events last; limit 0 means all."""
    out = matching(events, query).orderBy(F.col("micros").asc_nulls_last(), "id").offset(query.offset)
    return out.limit(query.limit) if query.limit else out


def summary(command: str = "command", raw: str = "raw", width: int = 160, kind: str | None = None, target: str = "target") -> Column:
    """One line of an event: its command, else (with its kind's column) the state that it describes, else its raw text without a syslog prefix."""
    state = F.lit(None).cast("string") if kind is None else F.when(F.col(kind).isin("config.entry", "cron.entry", "ssh.key.present"), F.concat_ws(" ", F.col(kind), F.col(target)))
    plain = F.regexp_replace(F.col(raw), r"^(\w{3} +\d+ [\d:]{8}|\d{4}-\d\d-\d\d[T ]\S+) \S+ ", "")
    return F.substring(F.coalesce(F.nullif(F.col(command), F.lit("")), state, plain), 1, width)


def total(events: DataFrame, query: TimelineQuery) -> int:
    """How many events match, whatever the page."""
    return matching(events, query).count()


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """events with their file's rel_path and sha256, by path; files are few, and the join is broadcast if they are."""
    return events.join(files.select("path", "rel_path", "sha256"), "path", "left")


#: What an event shows of itself, in this order.
SHOWN = ("id", "host", "artifact_type", "event_type", "actor", "src_ip", "dst_ip", "target", "command", "raw", "tags", "extra", "timestamp_raw", "timezone_assumed")


def as_json(events: DataFrame) -> DataFrame:
    """(id, micros, json): each event with its time and its source as an object; nulls are left out, keys are sorted."""
    source = F.struct(*(c for c in ("line_number", "path", "rel_path", "sha256") if c in events.columns))
    fields = sorted(c for c in SHOWN if c in events.columns)
    named = sorted([*((c, F.col(c)) for c in fields), ("source", source), ("timestamp_utc", iso(F.col("micros")))], key=lambda x: x[0])
    return events.select("id", "micros", F.to_json(F.struct(*(v.alias(k) for k, v in named))).alias("json"))


def compact(events: DataFrame, width: int = 400) -> DataFrame:
    """(id, micros, json): events without empty fields, and at most `width` characters of the raw text."""
    texts = [c for c in ("host", "artifact_type", "event_type", "actor", "src_ip", "dst_ip", "target", "command") if c in events.columns]
    rows = events.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in texts} | {"raw": F.nullif(F.substring("raw", 1, width), F.lit(""))})
    tags = [F.when(F.size("tags") > 0, F.col("tags")).alias("tags")] if "tags" in events.columns else []
    return rows.select("id", "micros", F.to_json(F.struct("id", iso(F.col("micros")).alias("time"), *texts, *tags, "raw")).alias("json"))
