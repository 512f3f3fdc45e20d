"""Queries that write events as lines or records of a format and read them again, so the events are the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import ntz_micros
from ..sources import parsers, records
from .queries import EV, _of, events


def _lines(ev: DataFrame, line: Column, path: str) -> DataFrame:
    return ev.select(F.lit(path).alias("path"), F.col("id").cast("int").alias("line_number"), line.alias("line"), F.lit("2024-12-31 23:00:00").cast("timestamp").alias("modified"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _read(df: DataFrame, *columns: str, **more: Column) -> DataFrame:
    """The id, the time in micros (of whole seconds if the format has no more) and what is asked for."""
    return df.select(F.col("line_number").cast("long").alias("id"), ntz_micros(F.col("timestamp_utc")).alias("micros"), *columns, *(v.alias(k) for k, v in more.items()))


def _extra(key: str, kind: str = "string") -> Column:
    return F.element_at("extra", F.lit(key)).cast(kind)


c = F.col


def syslog_round_trip(spark, d):
    ev = _of(events(spark, d), "auth.login.failure")
    line = _text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "Z ", c("host"), " sshd[1]: Failed password for ", c("actor"), " from ", c("src_ip"), " port 22 ssh2")
    return _read(parsers.syslog(_lines(ev, line, "auth.log")), "host", "actor", "src_ip", "event_type")


def syslog_without_years(spark, d):
    """Months and days only, in the order of time: the years come from the file's time of change and the turns of the months."""
    line = _text(F.date_format("ts", "MMM dd HH:mm:ss "), c("host"), " sudo: ", c("actor"), " : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/run ", c("k"))
    # a file for each user, its lines numbered in the order of time
    numbered = _of(events(spark, d), "auth.login.success").withColumn("id", F.row_number().over(Window.partitionBy("actor").orderBy("micros", "id")))
    lines = numbered.select(_text("/var/log/", c("actor")).alias("path"), c("id").alias("line_number"), line.alias("line"), F.max("ts").over(Window.partitionBy("actor")).cast("timestamp").alias("modified"))
    return _read(parsers.syslog(lines), "actor", "command", "event_type").drop("id")


def access_round_trip(spark, d):
    ev = _of(events(spark, d), "web.request")
    line = _text(c("src_ip"), " - ", c("actor"), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /p/', c("k"), ' HTTP/1.1" 200 ', c("k") * 10, ' "-" "agent"')
    return _read(parsers.access(_lines(ev, line, "access.log")), "src_ip", "actor", "target", method=_extra("method"), status=_extra("status", "int"), bytes=_extra("bytes", "long"))


def journal_round_trip(spark, d):
    ev = _of(events(spark, d), "user.create")
    line = _text('{"__REALTIME_TIMESTAMP":"', c("micros"), '","_HOSTNAME":"', c("host"), '","SYSLOG_IDENTIFIER":"useradd","MESSAGE":"new user: name=', c("actor"), ", UID=", c("k"), ', GID=1"}')
    return _read(parsers.journal_json(_lines(ev, line, "journal.json")), "host", "target", "event_type", uid=F.substring(F.get(F.filter("tags", lambda t: t.startswith("uid:")), F.lit(0)), 5, 20).cast("long"))


def audit_round_trip(spark, d):
    ev = _of(events(spark, d), "auth.login.success")
    seconds = F.floor(c("micros") / 1000)
    line = _text("type=USER_LOGIN msg=audit(", F.floor(seconds / 1000), ".", F.lpad((seconds % 1000).cast("string"), 3, "0"), ":", c("id"), "): pid=1 msg='op=login acct=\"", c("actor"), '" addr=', c("src_ip"), " terminal=ssh res=success'")
    return _read(parsers.audit(_lines(ev, line, "audit.log")), "actor", "src_ip", "event_type", serial=_extra("serial", "long"))


def dpkg_round_trip(spark, d):
    ev = _of(events(spark, d), "service.start")
    line = _text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " upgrade ", c("actor"), ":all 1.", c("k"), " 2.", c("k"))
    return _read(parsers.dpkg(_lines(ev, line, "dpkg.log")), "target", "event_type", version=_extra("version"))


def apache_error_round_trip(spark, d):
    ev = _of(events(spark, d), "web.request")
    line = _text("[", F.date_format("ts", "EEE MMM dd HH:mm:ss.SSSSSS yyyy"), "] [core:error] [pid ", c("k"), "] [client ", c("src_ip"), ":5000] not found: ", c("actor"))
    return _read(parsers.apache_error(_lines(ev, line, "error.log")), "src_ip", "event_type", pid=_extra("pid"), message=_extra("message"))


def nginx_error_round_trip(spark, d):
    ev = _of(events(spark, d), "web.request")
    line = _text(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), " [error] 7#8: *9 open() failed, client: ", c("src_ip"), ", server: ", c("host"), '.example, request: "GET /', c("k"), ' HTTP/1.1", host: "x"')
    return _read(parsers.nginx_error(_lines(ev, line, "error.log")), "host", "src_ip", "target")


def history_round_trip(spark, d):
    """Of one user's zsh history."""
    ev = _of(events(spark, d), "service.start")
    line = _text(": ", F.floor(c("micros") / 1_000_000), ":0;run ", c("k"), "; as ", c("actor"))
    return _read(parsers.zsh_history(_lines(ev, line, "/home/ann/.zsh_history")), "actor", "command", "event_type")


def dnf_round_trip(spark, d):
    ev = _of(events(spark, d), "user.create")
    line = _text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "+0000 SUBDEBUG Installed: ", c("actor"), "-1.", c("k"))
    return _read(parsers.dnf_rpm(_lines(ev, line, "dnf.rpm.log")), "target", "event_type")


def utmp_round_trip(spark, d):
    """Records of 384 bytes, made and read; a file for each host."""
    ev = _of(events(spark, d), "auth.login.success")
    little = lambda x, n: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.floor(x / F.pow(F.lit(256), i)).cast("long") % 256), 2, "0")), ""))
    padded = lambda x, n: F.rpad(x.cast("binary"), n, F.lit(bytearray(b"\0")))
    zeros = lambda n: F.lit(bytearray(n))
    address = F.unhex(F.array_join(F.transform(F.split("src_ip", "[.]"), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    seconds = F.floor(c("micros") / 1_000_000)
    record = F.concat(little(F.lit(7), 2), zeros(2), little(c("k"), 4), padded(F.lit("pts/0"), 32), zeros(4), padded(c("actor"), 32), zeros(256), zeros(8), little(seconds, 4), little(c("micros") - seconds * 1_000_000, 4), address, zeros(12), zeros(20))
    # hex, as strings sort and join; one file for each of a thousand ids, so no row grows with the table
    files = ev.withColumn("r", F.hex(record)).groupBy("host", F.floor(c("id") / 1000).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "r"))), lambda x: x["r"]), "").alias("h"))
    got = records.utmp(files.select(_text("wtmp.", c("host"), ".", c("part")).alias("path"), F.unhex("h").alias("content")))
    return got.select(ntz_micros(c("timestamp_utc")).alias("micros"), "actor", "src_ip", "event_type", "target")


QUERIES = {
    f.__name__: f
    for f in (syslog_round_trip, syslog_without_years, access_round_trip, journal_round_trip, audit_round_trip, dpkg_round_trip, apache_error_round_trip, nginx_error_round_trip, history_round_trip, dnf_round_trip, utmp_round_trip)
}


def _sql(kind: str, columns: str, micros: str = "micros") -> str:
    return f"{EV} SELECT id, {micros} AS micros, {columns} FROM ev WHERE event_type = '{kind}'"


_SECOND = "micros // 1000000 * 1000000"
ORACLE_SQL = {
    "syslog_round_trip": _sql("auth.login.failure", "host, actor, src_ip, event_type"),
    "syslog_without_years": f"{EV} SELECT {_SECOND} AS micros, actor, '/bin/run ' || k AS command, 'auth.sudo' AS event_type FROM ev WHERE event_type = 'auth.login.success'",
    "access_round_trip": _sql("web.request", "src_ip, actor, '/p/' || k AS target, 'GET' AS method, CAST(200 AS INTEGER) AS status, k * 10 AS bytes", _SECOND),
    "journal_round_trip": _sql("user.create", "host, actor AS target, event_type, k AS uid"),
    "audit_round_trip": _sql("auth.login.success", "actor, src_ip, event_type, id AS serial", "micros // 1000 * 1000"),
    "dpkg_round_trip": _sql("service.start", "actor || ':all' AS target, 'package.upgrade' AS event_type, '2.' || k AS version", _SECOND),
    "apache_error_round_trip": _sql("web.request", "src_ip, 'web.error' AS event_type, CAST(k AS VARCHAR) AS pid, 'not found: ' || actor AS message"),
    "nginx_error_round_trip": _sql("web.request", "host || '.example' AS host, src_ip, '/' || k AS target", _SECOND),
    "history_round_trip": _sql("service.start", "'ann' AS actor, 'run ' || k || '; as ' || actor AS command, 'shell.command' AS event_type", _SECOND),
    "dnf_round_trip": _sql("user.create", "actor || '-1.' || k AS target, 'package.install' AS event_type", _SECOND),
    "utmp_round_trip": f"{EV} SELECT micros, actor, src_ip, event_type, 'pts/0' AS target FROM ev WHERE event_type = 'auth.login.success'",
}
