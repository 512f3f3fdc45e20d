"""Findings that rules can't express: gaps, cut login records, rare sources, restarts of logging, unknown keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import is_public

# Logs that are written all the time; services that write them.
CONTINUOUS = ("linux.auth", "linux.syslog", "linux.kernel", "linux.cron", "journald.json", "linux.audit", "web.access")
LOGGING = ("rsyslogd", "systemd-journald")
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: A source's time is cut into buckets of this length; tasks order the events of one.
BUCKET = 7 * DAY


def _steps(events: DataFrame, by: str) -> DataFrame:
    """(by, id, micros, gap): each dated event of a source with the time since the one before, also where that lies in an earlier bucket."""
    dated = events.where("micros is not null").select(by, "id", "micros").withColumn("__b", F.floor(F.col("micros") / BUCKET))
    steps = dated.withColumn("__prev", F.lag("micros").over(Window.partitionBy(by, "__b").orderBy("micros", "id")))
    lasts = dated.groupBy(by, "__b").agg(F.max("micros").alias("__last"))
    lasts = lasts.withColumn("__before", F.lag("__last").over(Window.partitionBy(by).orderBy("__b"))).drop("__last")
    return steps.join(lasts, [by, "__b"]).select(by, "id", "micros", (F.col("micros") - F.coalesce("__prev", "__before")).alias("gap"))


def log_gaps(events: DataFrame, by: str, least: int = 6 * HOUR, times_median: float = 50.0, least_events: int = 20) -> DataFrame:
    """Gaps between neighbouring events of a source above both `least` micros and so many times its median interval.

    Where events have an artifact_type, only logs that are written all the time count. The median is found from the numbers of equal gaps.
    """
    if "artifact_type" in events.columns:
        events = events.where(F.col("artifact_type").isin(*CONTINUOUS))
    steps = _steps(events, by)
    counts = steps.groupBy(by, "gap").agg(F.count(F.lit(1)).alias("c"))
    usual = counts.groupBy(by).agg(F.expr("percentile(gap, 0.5, c)").alias("median_gap"), F.sum("c").alias("n")).where(F.col("n") >= least_events)
    return steps.join(usual, by).where((F.col("gap") > least) & (F.col("gap") > F.lit(times_median) * F.col("median_gap"))).select(by, "id", "micros", "gap", "median_gap")


def rare_sources(logins: DataFrame, least_logins: int = 5) -> DataFrame:
    """Logins from a public address that its actor used once, of actors with at least so many. The last logins of lastlog don't count."""
    rows = logins.where("actor is not null and src_ip is not null")
    if "artifact_type" in rows.columns:
        rows = rows.where("artifact_type != 'lastlog'")
    by_source = rows.groupBy("actor", "src_ip").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("micros").alias("micros"))
    total = by_source.groupBy("actor").agg(F.sum("n").alias("n_logins"))
    return by_source.where((F.col("n") == 1) & is_public(F.col("src_ip"))).join(total, "actor").where(F.col("n_logins") >= least_logins).select("actor", "src_ip", "id", "micros", "n_logins")


def without_near(events: DataFrame, others: DataFrame, by: str, window: int) -> DataFrame:
    """Events (with an id of their own) without one of others within `window` micros on either side, of the same key or if one of the two has none.

    Both are cut into buckets of a window's length, so the join has keys: another event is in the same bucket or in one beside it. Events with a key, and
    without one, have keys of their own: an event with a key meets those of its key and those without, an event without one meets all.
    """
    bucket = lambda c: F.floor(c / F.lit(window))
    key = F.col(by).cast("string")
    sides = F.array(*(bucket(F.col("micros")) + i for i in (-1, 0, 1)))
    dated = others.where("micros is not null").select(key.alias("k"), F.col("micros").alias("__m"), F.explode(sides).alias("__b"))
    # what each kind of event looks for: its own key (1), others without a key (2), any (3)
    named = lambda kind, k: F.struct(F.lit(kind).alias("t"), k.alias("k"))
    none = F.lit(None).cast("string")
    near = dated.withColumn("__w", F.explode(F.array(F.when(F.col("k").isNotNull(), named(1, F.col("k"))).otherwise(named(2, none)), named(3, none)))).select("__w", "__b", "__m").distinct()
    at = events.where("micros is not null").select("id", "micros", bucket(F.col("micros")).alias("__bucket"), F.when(key.isNull(), F.array(named(3, none))).otherwise(F.array(named(1, key), named(2, none))).alias("__looks"))
    looks = at.select("id", "micros", "__bucket", F.size("__looks").alias("__need"), F.explode("__looks").alias("__l"))
    met = (F.col("__l.t") == F.col("__w.t")) & F.col("__l.k").eqNullSafe(F.col("__w.k")) & (F.col("__bucket") == F.col("__b")) & (F.abs(F.col("micros") - F.col("__m")) <= window)
    # an event stays if it meets nothing in all that it looked for
    lonely = looks.join(near, met, "left_anti").groupBy("id", "__need").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") >= F.col("__need"))
    return events.join(lonely.select("id"), "id", "left_semi").select(*events.columns)


def logging_restarts(events: DataFrame, window: int = 900_000_000) -> DataFrame:
    """Starts and stops of logging services without a boot or shutdown near."""
    restarts = events.where(F.col("event_type").isin("service.start", "service.stop") & F.col("target").isin(*LOGGING))
    return without_near(restarts, events.where(F.col("event_type").isin("system.boot", "system.shutdown")), "host", window)


def first_of_type(events: DataFrame, event_type: str, but: str) -> DataFrame:
    """(id, micros): the earliest dated event of a type, outside the artifact types that start with `but`."""
    rows = events.where((F.col("event_type") == event_type) & F.col("micros").isNotNull() & ~F.col("artifact_type").startswith(but))
    return rows.agg(F.min(F.struct("micros", "id")).alias("f")).select("f.id", "f.micros").where("micros is not null")


def cut_login_records(events: DataFrame, files: DataFrame, most_lag: int = DAY) -> DataFrame:
    """(path, id, micros, other_id, other_micros, lag): wtmp and btmp files that are empty or start long after the logins that other logs have.

    files: (path, artifact_type). Both sides are one row a file at most, so the cross compare is small.
    """
    out = None
    for artifact, kind in (("utmp.wtmp", "auth.login.success"), ("utmp.btmp", "auth.login.failure")):
        own = files.where(F.col("artifact_type") == artifact).select("path")
        firsts = events.where((F.col("artifact_type") == artifact) & F.col("micros").isNotNull()).groupBy("path").agg(F.min(F.struct("micros", "id")).alias("f"))
        other = first_of_type(events, kind, "utmp.").select(F.col("id").alias("other_id"), F.col("micros").alias("other_micros"), F.lit(1).alias("__j"))
        met = own.join(firsts, "path", "left").withColumn("__j", F.lit(1)).join(F.broadcast(other), "__j")
        met = met.select("path", "f.id", "f.micros", "other_id", "other_micros", (F.col("f.micros") - F.col("other_micros")).alias("lag"))
        met = met.where("lag is null").unionByName(met.where(F.col("lag") > most_lag))
        out = met if out is None else out.unionByName(met)
    return out


def unknown_keys(logins: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Logins whose key isn't among the known ones; none if nothing is known."""
    known = known.select(key).where(F.col(key).isNotNull()).distinct()
    return logins.where(F.col(key).isNotNull()).join(known, key, "left_anti") if not known.isEmpty() else logins.limit(0)


def unknown_ssh_keys(events: DataFrame) -> DataFrame:
    """(actor, key, n_logins, first_micros, last_micros, src_ips): logins by keys that no collected authorized_keys file holds."""
    tagged = events.withColumn("key", F.explode(F.transform(F.filter("tags", lambda t: t.startswith("key:")), lambda t: F.substring(t, 5, 200))))
    logins = tagged.where("event_type = 'auth.login.success'")
    found = unknown_keys(logins, tagged.where("event_type = 'ssh.key.present'"), "key")
    ips = F.array_sort(F.collect_set("src_ip"))
    return found.groupBy(F.coalesce("actor", F.lit("?")).alias("actor"), "key").agg(F.count(F.lit(1)).alias("n_logins"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), ips.alias("src_ips"))
