"""What analytics find, as drafts of findings: with a rule's id, a text, severity, techniques and a fingerprint, like those of rules.

Events have id, micros, event_type, artifact_type, path (or the column named), actor, src_ip, host, target, raw and tags; files have path, artifact_type and, if it
is there, sha256. A draft names few events in event_ids; key_links() has those of unknown keys, which may be many.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso
from . import analytics
from .findings import COLUMNS, fingerprint
from .ordered import running
from .rules import LEVELS


@dataclass(frozen=True)
class Analytic:
    key: str
    title: str
    level: str
    confidence: float
    techniques: tuple[str, ...]
    about: str
    advice: str

    @property
    def rule_id(self) -> str:
        return f"analytic.{self.key}"


GAP = Analytic(
    "log_gap", "Silence in a log that is written all the time", "low", 0.4, ("T1070.002",),
    "Nothing was written for far longer than this log usually waits. The host or the service may have been down, there may have been nothing to write, or entries were taken out.",
    "See what other logs have for that time, and whether a shutdown explains it.",
)
LOGINS_CUT = Analytic(
    "utmp_truncation", "Login records begin after logins that other logs have", "high", 0.6, ("T1070.002",),
    "The binary records of logins hold every login since they were last rotated. These begin late or are empty, so they were probably cut or replaced.",
    "Take sessions from the text logs, and look for what emptied the file.",
)
RARE = Analytic(
    "unusual_login_ip", "Login from an address that the account used once", "medium", 0.5, ("T1078",),
    "The account usually comes from other addresses; from this public one it came a single time.",
    "Ask whose address it is; if nobody knows, look at all that the account did afterwards.",
)
RESTART = Analytic(
    "logging_restart_without_boot", "Logging stopped or started while the host ran", "medium", 0.5, ("T1562.006",),
    "A logging service stopped or started, and no boot or shutdown is near. So logging is paused, or another configuration is put in force.",
    "Read the service's configuration, and find out who restarted it.",
)
KEY = Analytic(
    "ssh_login_key_not_in_authorized_keys", "Login by a key that no collected file allows", "medium", 0.5, ("T1098.004", "T1078"),
    "The key is in none of the authorized_keys files that were collected: it was taken out since, a file is missing, or keys come from elsewhere.",
    "Collect the files of all accounts and what AuthorizedKeysCommand gives; a key that stays unknown was not allowed.",
)
ALL = (GAP, LOGINS_CUT, RARE, RESTART, KEY)


def _drafts(rows: DataFrame, a: Analytic, suffix: Column, said: Column, context: dict[str, Column], first: Column, last: Column, ids: Column, n: Column, *parts: Column) -> DataFrame:
    values = {
        "fingerprint": fingerprint(F.lit(a.rule_id), *parts), "rule_id": F.lit(a.rule_id), "title": F.concat(F.lit(f"{a.title} — "), suffix), "severity": F.lit(a.level), "severity_rank": F.lit(LEVELS.index(a.level)), "confidence": F.lit(a.confidence),
        "techniques": F.array(*map(F.lit, a.techniques)), "recommendation": F.lit(a.advice), "narrative": F.concat(F.lit(f"{a.about}\n\n"), said), "context": F.to_json(F.struct(F.lit(a.key).alias("analytic"), *(v.alias(k) for k, v in context.items()))),
        "first_micros": first, "last_micros": last, "n_events": n.cast("long"),
    }
    return rows.select(*(values[c].alias(c) for c in COLUMNS), F.array_compact(ids).alias("event_ids"))


def _with_sha(rows: DataFrame, files: DataFrame, by: str) -> DataFrame:
    sha = files.select(F.col("path").alias(by), F.col("sha256") if "sha256" in files.columns else F.lit(None).cast("string").alias("sha256")).dropDuplicates([by])
    return rows.join(sha, by, "left")


def gaps(events: DataFrame, files: DataFrame, by: str = "path", least: int = 6 * analytics.HOUR, times_median: float = 50.0, least_events: int = 20) -> DataFrame:
    """log_gaps() as drafts; each gap has the events at both its ends."""
    if "artifact_type" in events.columns:
        events = events.where(F.col("artifact_type").isin(*analytics.CONTINUOUS))
    steps = running(events.where("micros is not null").select(by, "id", "micros"), [by], [F.col("micros"), F.col("id")], previous=["id", "micros"])
    steps = steps.withColumn("gap", F.col("micros") - F.col("prev_micros"))
    # the median from the numbers of equal gaps
    usual = steps.groupBy(by, "gap").agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.expr("percentile(gap, 0.5, c)").alias("median"), F.sum("c").alias("dated")).where(F.col("dated") >= least_events)
    rows = _with_sha(steps.join(usual, by).where((F.col("gap") > least) & (F.col("gap") > F.lit(times_median) * F.col("median"))), files, by)
    hours = F.format_string("%.1f", F.col("gap") / analytics.HOUR)
    said = F.concat(F.col(by), F.lit(" has nothing from "), iso(F.col("prev_micros")), F.lit(" to "), iso(F.col("micros")), F.lit(", "), hours, F.lit(" hours; of its "), F.col("dated").cast("string"), F.lit(" dated events one usually follows another in "), F.format_string("%.0f", F.col("median") / 1_000_000), F.lit(" seconds."))
    context = {"file": F.col(by), "gap_seconds": F.floor(F.col("gap") / 1_000_000), "median_interval_seconds": F.round(F.col("median") / 1_000_000, 1)}
    return _drafts(rows, GAP, F.concat(F.col(by), F.lit(" silent for "), hours, F.lit(" h")), said, context, F.col("prev_micros"), F.col("micros"), F.array("prev_id", "id"), F.lit(2), F.coalesce("sha256", by), iso(F.col("prev_micros")))


def logins_cut(events: DataFrame, files: DataFrame) -> DataFrame:
    rows = _with_sha(analytics.cut_login_records(events, files), files, "path")
    days = F.floor(F.col("lag") / analytics.DAY)
    late = F.concat(F.lit("Its first record is of "), iso(F.col("micros")), F.lit(", "), days.cast("string"), F.lit(" days after logins that other logs have from "), iso(F.col("other_micros")), F.lit(" on."))
    said = F.when(F.col("lag").isNull(), F.concat(F.lit("It has no dated record, and other logs have logins from "), iso(F.col("other_micros")), F.lit(" on."))).otherwise(late)
    return _drafts(rows, LOGINS_CUT, F.col("path"), said, {"file": F.col("path"), "lag_days": days}, F.col("other_micros"), F.coalesce("micros", "other_micros"), F.array("other_id", "id"), F.when(F.col("id").isNull(), 1).otherwise(2), F.coalesce("sha256", "path"))


def rare_sources(events: DataFrame, least_logins: int = 5) -> DataFrame:
    logins = events.where("event_type = 'auth.login.success'")
    sources = logins.where("actor is not null and src_ip is not null and artifact_type != 'lastlog'").groupBy("actor").agg((F.count_distinct("src_ip") - 1).alias("others"))
    rows = analytics.rare_sources(logins, least_logins).join(sources, "actor")
    said = F.concat(F.lit("Of "), F.col("n_logins").cast("string"), F.lit(" logins of "), F.col("actor"), F.lit(" all but one came from "), F.col("others").cast("string"), F.lit(" other addresses; the one from "), F.col("src_ip"), F.lit(" was "), F.when(F.col("micros").isNull(), "at an unknown time").otherwise(F.concat(F.lit("at "), iso(F.col("micros")))), F.lit("."))
    return _drafts(rows, RARE, F.concat("actor", F.lit(" from "), "src_ip"), said, {"actor": F.col("actor"), "src_ip": F.col("src_ip"), "total_logins": F.col("n_logins")}, F.col("micros"), F.col("micros"), F.array("id"), F.lit(1), F.col("actor"), F.col("src_ip"))


def restarts(events: DataFrame, window: int = 900_000_000) -> DataFrame:
    rows = analytics.logging_restarts(events.where("micros is not null"), window).withColumn("did", F.when(F.col("event_type") == "service.start", "started").otherwise("stopped"))
    at = iso(F.col("micros"))
    said = F.concat("target", F.lit(" "), "did", F.lit(" at "), at, F.lit(" on "), F.coalesce("host", F.lit("an unknown host")), F.lit(f", and within {window // 60_000_000} minutes there is no boot or shutdown. Entry: "), F.coalesce("raw", F.lit("")))
    context = {"service": F.col("target"), "action": F.col("did"), "host": F.col("host")}
    return _drafts(rows, RESTART, F.concat("target", F.lit(" "), "did", F.lit(" at "), at), said, context, F.col("micros"), F.col("micros"), F.array("id"), F.lit(1), F.col("target"), at, F.coalesce("host", F.lit("None")))


def _unknown(events: DataFrame) -> DataFrame:
    tagged = events.withColumn("key", F.explode(F.transform(F.filter("tags", lambda t: t.startswith("key:")), lambda t: F.substring(t, 5, 200))))
    return analytics.unknown_keys(tagged.where("event_type = 'auth.login.success'"), tagged.where("event_type = 'ssh.key.present'"), "key").withColumn("actor", F.coalesce("actor", F.lit("?")))


def unknown_keys(events: DataFrame) -> DataFrame:
    rows = _unknown(events).groupBy("actor", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.min(F.struct("micros", "id")).alias("one"), F.max(F.struct("micros", "id")).alias("other"), F.count_distinct("src_ip").alias("ips"),
        F.min("src_ip").alias("ip"),
    )
    said = F.concat(F.col("n").cast("string"), F.lit(" logins as "), F.col("actor"), F.lit(" were by the key "), F.col("key"), F.lit(", from "), F.when(F.col("ips") == 1, F.col("ip")).otherwise(F.concat(F.col("ips").cast("string"), F.lit(" addresses"))), F.lit("."))
    context = {"actor": F.col("actor"), "fingerprint": F.col("key"), "n_addresses": F.col("ips")}
    return _drafts(rows, KEY, F.concat("actor", F.lit(" with "), "key"), said, context, F.col("first_micros"), F.col("last_micros"), F.array_distinct(F.array("one.id", "other.id")), F.col("n"), F.col("actor"), F.col("key"))


def key_links(events: DataFrame) -> DataFrame:
    """(fingerprint, event_id) of all logins by unknown keys."""
    return _unknown(events).select(fingerprint(F.lit(KEY.rule_id), F.col("actor"), F.col("key")).alias("fingerprint"), F.col("id").alias("event_id"))


def drafts(events: DataFrame, files: DataFrame, by: str = "path", least_gap: int = 6 * analytics.HOUR, times_median: float = 50.0) -> DataFrame:
    """The drafts of all five analytics: the columns of findings.from_hits() and event_ids."""
    return reduce(DataFrame.unionByName, (gaps(events, files, by, least_gap, times_median), logins_cut(events, files), rare_sources(events), restarts(events), unknown_keys(events)))
