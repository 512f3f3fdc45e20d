"""Binary login records: fixed-size records of wtmp, btmp and lastlog files, as columns over each record's bytes.

Numbers are little-endian. The files' bytes come as (path, content); they are cut into pieces of whole records before records are
taken apart, so a task holds one file's bytes and a piece's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import canonical_ip
from .shape import empty_to_null, labelled, shaped, tags

# The layout of the records.
UTMP_SIZE, LASTLOG_SIZE = 384, 292
TYPES = ("EMPTY", "RUN_LVL", "BOOT_TIME", "NEW_TIME", "OLD_TIME", "INIT_PROCESS", "LOGIN_PROCESS", "USER_PROCESS", "DEAD_PROCESS", "ACCOUNTING")


def _number(data: Column, at: int, size: int) -> Column:
    """A signed number of 2 or 4 bytes."""
    hexed = F.array_join(F.transform(F.sequence(F.lit(size), F.lit(1), F.lit(-1)), lambda i: F.lpad(F.hex(F.substring(data, F.lit(at) + i, F.lit(1))), 2, "0")), "")
    value, top = F.conv(hexed, 16, 10).cast("long"), 1 << (8 * size - 1)
    return F.when(value >= top, value - 2 * top).otherwise(value)


def _text(data: Column, at: int, size: int) -> Column:
    """Up to the first zero byte."""
    return F.substring_index(F.decode(F.substring(data, at + 1, size), "UTF-8"), "\x00", 1)


def _address(data: Column, at: int) -> Column:
    hexed = F.hex(F.substring(data, at + 1, 16))
    v4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10)), ".")
    v6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(hexed, i * 4 + 1, F.lit(4))), ":")
    return F.when(F.length(hexed) < 32, None).when(hexed.rlike("^0{32}$"), None).when(hexed.rlike("^.{8}0{24}$"), v4).otherwise(canonical_ip(v6))


def _records(files: DataFrame, size: int, first: int, batch: int = 4096) -> DataFrame:
    """(path, line_number, rec): the records in order; the last may be cut short."""
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("content") / (size * batch)).cast("int") - 1))
    cut = files.where(F.length("content") > 0).select("path", F.explode(pieces).alias("p"), "content").select("path", "p", F.expr(f"substring(content, p * {size * batch} + 1, {size * batch})").alias("piece"))
    inside = F.sequence(F.lit(0), F.ceil(F.length("piece") / size).cast("int") - 1)
    each = cut.select("path", "p", F.explode(inside).alias("i"), "piece")
    return each.select("path", (F.col("p") * batch + F.col("i") + first).alias("line_number"), F.expr(f"substring(piece, i * {size} + 1, {size})").alias("rec"))


def _word(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")))


def utmp(files: DataFrame, zone: str = "UTC", artifact: str = "utmp.wtmp") -> DataFrame:
    """wtmp: logins, logouts, boots and shutdowns; btmp: every record is a failed login. line_number: the record's number, from 1."""
    rows = _records(files, UTMP_SIZE, 1)
    rec = F.col("rec")
    rows = rows.withColumns({
        "kind": _number(rec, 0, 2), "pid": _number(rec, 4, 4), "dev": _text(rec, 8, 32), "user": _text(rec, 44, 32), "remote": _text(rec, 76, 256),
        "sec": _number(rec, 340, 4), "usec": _number(rec, 344, 4), "ip": _address(rec, 348), "whole": F.length(rec) == UTMP_SIZE,
    })
    name = F.coalesce(F.get(F.array(*map(F.lit, TYPES)), F.when(F.col("kind").between(0, 9), F.col("kind").cast("int"))), F.col("kind").cast("string"))
    event = F.lit("auth.login.failure") if artifact == "utmp.btmp" else (
        F.when(F.col("kind") == 7, "auth.login.success").when(F.col("kind") == 8, "auth.logout").when(F.col("kind") == 2, "system.boot").when((F.col("kind") == 1) & (F.col("user") == "shutdown"), "system.shutdown").otherwise("other")
    )
    raw = F.when(F.col("whole"), F.concat_ws(" ", _word("type", name), _word("pid", F.col("pid")), _word("line", F.col("dev")), _word("user", F.col("user")), _word("host", F.col("remote")), _word("addr", F.col("ip")))).otherwise(F.lower(F.hex(rec)))
    return shaped(
        rows, artifact, F.col("whole"), "truncated_record", raw=raw, timestamp_utc=F.when(F.col("sec") != 0, F.timestamp_micros(F.col("sec") * 1_000_000 + F.col("usec"))), timestamp_raw=F.col("sec"), event_type=event,
        actor=empty_to_null(F.col("user")), src_ip=F.col("ip"), target=empty_to_null(F.col("dev")), tags=tags(labelled("utmp_type", name), labelled("remote_host", empty_to_null(F.col("remote")))),
    )


def lastlog(files: DataFrame, zone: str = "UTC", artifact: str = "lastlog") -> DataFrame:
    """The last login of each user number, which is the record's number; records without one are skipped."""
    rec = F.col("rec")
    rows = _records(files, LASTLOG_SIZE, 0).withColumns({"sec": _number(rec, 0, 4), "dev": _text(rec, 4, 32), "remote": _text(rec, 36, 256), "whole": F.length(rec) == LASTLOG_SIZE})
    rows = rows.where(~F.col("whole") | (F.col("sec") != 0))
    uid = F.col("line_number").cast("string")
    raw = F.when(F.col("whole"), F.concat_ws(" ", _word("uid", uid), _word("time", F.col("sec")), _word("line", F.col("dev")), _word("host", F.col("remote")))).otherwise(F.lower(F.hex(rec)))
    return shaped(
        rows, artifact, F.col("whole"), "truncated_record", raw=raw, timestamp_utc=F.timestamp_seconds("sec"), timestamp_raw=F.col("sec"), event_type=F.lit("auth.login.success"), actor=labelled("uid", uid),
        src_ip=canonical_ip(F.col("remote")), target=empty_to_null(F.col("dev")), tags=tags("lastlog", labelled("remote_host", empty_to_null(F.col("remote")))),
    )


#: Parsers of whole files by artifact type.
PARSERS = {"utmp.wtmp": utmp, "utmp.btmp": utmp, "lastlog": lastlog}
