"""The registered queries of the log operators: the events table as a timeline, pages and documents as texts; and the SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz_micros, span_micros
from ..operators import analytics, correlate, findings, iocs, timeline
from ..operators.rules import Rule, matches
from ..sources.evidence import digest

HOUR = span_micros("1h")
DAY = span_micros("1d")

KINDS = {"error": "auth.login.failure", "purchase": "auth.login.success", "signup": "user.create", "click": "web.request", "view": "service.start"}
_KINDS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
EV = f"""WITH ev AS (SELECT event_id AS id, ts, epoch_us(ts) AS micros, 'u' || user_id AS actor, 'h' || (user_id % 5) AS host,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
 CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 = 0 THEN '10.0.' ELSE '8.8.' END || (user_id % 7) || '.' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20) AS src_ip,
 {_KINDS_SQL} AS event_type, event_type || ' u' || user_id || ' ' || props AS raw FROM events)"""

RULES = [
    Rule("login_failure", "Failed login", {"s": {"event_type": "auth.login.failure"}, "condition": "s"}, "low", generate=False),
    Rule("login_success", "Login", {"s": {"event_type": "AUTH.LOGIN.SUCCESS"}, "condition": "s"}, "info", generate=False),
    Rule("odd_key", "Odd key", {"a": {"raw|re": '"k": [0-9]*7}'}, "b": {"event_type|startswith": "auth."}, "condition": "a and not b"}, "medium", 0.4, ("T1078",)),
    Rule("private_source", "Private source", {"a": {"src_ip|cidr": "10.0.0.0/8", "k|gte": 90}, "b": {"event_type": ["web.request", "service.*"]}, "condition": "all of a* and 1 of b*"}, "high", 0.6, ("T1190", "T1059")),
    Rule("new_account", "New account", {"s": [{"event_type": "user.create", "k|lt": 10}, {"event_type": "user.create", "actor|endswith": "7"}], "condition": "s"}, "critical", 0.7, ("T1136",)),
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of parsed log events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    user = F.col("user_id").cast("string")
    ip = F.concat(F.when(k % 3 == 0, "10.0.").otherwise("8.8."), (F.col("user_id") % 7).cast("string"), F.lit("."), (k % 20).cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), "ts", ntz_micros(F.col("ts")).alias("micros"), F.concat(F.lit("u"), user).alias("actor"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"),
        k.alias("k"), ip.alias("src_ip"), kind.alias("event_type"), F.concat_ws(" ", F.col("event_type"), F.concat(F.lit("u"), user), F.col("props")).alias("raw"),
    )


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("event_type") == kind)


def brute_force(spark, d):
    """Who failed to log in three times or more within a day."""
    return correlate.event_count(matches(events(spark, d), RULES[:1]), ["actor"], DAY, 3)


def timeline_filter(spark, d):
    q = timeline.TimelineQuery(types=["auth"], host="h2", start=1_704_500_000_000_000)
    return timeline.matching(events(spark, d), q).select("id", "micros", "actor", "event_type")


def timeline_grep(spark, d):
    return timeline.matching(events(spark, d), timeline.TimelineQuery(grep=r"^CLICK u[0-9]*3 ")).select("id", "raw")


def timeline_page(spark, d):
    return timeline.page(events(spark, d), timeline.TimelineQuery(types=["user.create"], limit=50, offset=10)).select("id", "micros", "actor")


def rule_matches(spark, d):
    return matches(events(spark, d), RULES).select("id", "rule_key")


def rule_off_hours(spark, d):
    return _of(events(spark, d), "auth.login.success").where((F.hour("ts") >= 22) | (F.hour("ts") < 5)).select("id", "actor")


def corr_value_count(spark, d):
    return correlate.value_count(_of(events(spark, d), "auth.login.failure"), ["actor"], "src_ip", DAY, 3)


def corr_temporal_ordered(spark, d):
    return correlate.temporal(matches(events(spark, d), RULES[:2]), ["actor"], ["login_failure", "login_success"], DAY, ordered=True)


def session_clusters(spark, d):
    return correlate.sessions(events(spark, d), ["actor"], 6 * HOUR)


def log_gaps(spark, d):
    return analytics.log_gaps(events(spark, d), "event_type", 0, 5.0)


def rare_source(spark, d):
    return analytics.rare_sources(_of(events(spark, d), "auth.login.success"), 5)


def start_without_create(spark, d):
    ev = events(spark, d)
    return analytics.without_near(_of(ev, "service.start"), _of(ev, "user.create"), "host", HOUR).select("id", "host")


def unknown_keys(spark, d):
    ev = events(spark, d)
    return analytics.unknown_keys(_of(ev, "auth.login.success"), _of(ev, "user.create").where("k < 60"), "k").select("id", "k")


def finding_drafts(spark, d):
    return findings.drafts(matches(events(spark, d), RULES), RULES, ["actor"], DAY).select("rule_key", "actor", "first_micros", "n_events", "severity", "severity_rank", "fingerprint")


def findings_upsert(spark, d):
    ev = _of(events(spark, d), "user.create")
    first = ev.where("id % 3 != 0").groupBy("actor").agg(F.count(F.lit(1)).alias("n_events")).select(findings.fingerprint("actor").alias("fingerprint"), "n_events", F.when(F.col("actor").endswith("1"), "accepted").otherwise("open").alias("status"))
    then = ev.where("id % 3 = 0").groupBy("actor").agg(F.count(F.lit(1)).alias("n_events")).select(findings.fingerprint("actor").alias("fingerprint"), "n_events")
    return findings.upsert(first, then)


def attack_coverage(spark, d):
    facts = spark.createDataFrame([(r.name, t) for r in RULES for t in r.techniques], "rule_key string, technique string")
    return matches(events(spark, d), RULES).join(F.broadcast(facts), "rule_key").groupBy("technique").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


def artifact_summary(spark, d):
    return events(spark, d).groupBy("event_type", "host").agg(F.count(F.lit(1)).alias("n"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))


def ioc_pages(spark, d):
    return iocs.rollup(iocs.extract(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "url", ("url",)).where("type = 'domain'"))


def ioc_documents(spark, d):
    return iocs.rollup(iocs.extract(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", ("ipv4", "md5")))


def evidence_digest(spark, d):
    """One digest over all events."""
    return digest(events(spark, d), "id", "raw")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        brute_force, timeline_filter, timeline_grep, timeline_page, rule_matches, rule_off_hours, corr_value_count, corr_temporal_ordered, session_clusters, log_gaps, rare_source,
        start_without_create, unknown_keys, finding_drafts, findings_upsert, attack_coverage, artifact_summary, ioc_pages, ioc_documents, evidence_digest,
    )
}


def _clusters(rows: str, peak: str, span: int, least: int) -> str:
    return f"""{EV}, m AS ({rows}), g AS (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY actor ORDER BY micros, id) <= {span} THEN 0 ELSE 1 END AS new FROM m),
 c AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY micros, id) AS cluster FROM g),
 w AS (SELECT *, {peak} OVER (PARTITION BY actor, cluster ORDER BY micros RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS n FROM c)
 SELECT actor, CAST(cluster AS BIGINT) AS cluster, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS n_events, max(n) AS peak FROM w GROUP BY actor, cluster HAVING max(n) >= {least}"""


_MATCHED = f"""{EV}, m AS (SELECT *, unnest(list_filter([
 CASE WHEN event_type = 'auth.login.failure' THEN 'login_failure' END, CASE WHEN event_type = 'auth.login.success' THEN 'login_success' END,
 CASE WHEN regexp_matches(raw, '"k": [0-9]*7}}') AND NOT starts_with(event_type, 'auth.') THEN 'odd_key' END,
 CASE WHEN starts_with(src_ip, '10.') AND k >= 90 AND (event_type = 'web.request' OR starts_with(event_type, 'service.')) THEN 'private_source' END,
 CASE WHEN event_type = 'user.create' AND (k < 10 OR ends_with(actor, '7')) THEN 'new_account' END], lambda x: x IS NOT NULL)) AS rule_key FROM ev)"""
_FAILED = "SELECT id, micros, actor, src_ip FROM ev WHERE event_type = 'auth.login.failure'"

ORACLE_SQL = {
    "brute_force": _clusters(f"SELECT min(id) AS id, micros, actor, src_ip FROM ({_FAILED}) GROUP BY ALL", "count(*)", DAY, 3),
    "timeline_filter": f"{EV} SELECT id, micros, actor, event_type FROM ev WHERE starts_with(event_type, 'auth.') AND host = 'h2' AND micros >= 1704500000000000",
    "timeline_grep": f"{EV} SELECT id, raw FROM ev WHERE regexp_matches(raw, '(?i)^CLICK u[0-9]*3 ')",
    "timeline_page": f"{EV} SELECT id, micros, actor FROM ev WHERE event_type = 'user.create' ORDER BY micros, id LIMIT 50 OFFSET 10",
    "rule_matches": f"{_MATCHED} SELECT id, rule_key FROM m",
    "rule_off_hours": f"{EV} SELECT id, actor FROM ev WHERE event_type = 'auth.login.success' AND (hour(ts) >= 22 OR hour(ts) < 5)",
    "corr_value_count": _clusters(_FAILED, "count(DISTINCT src_ip)", DAY, 3),
    "session_clusters": f"""{EV}, g AS (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY actor ORDER BY micros, id) <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM ev),
 c AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY micros, id) AS cluster FROM g)
 SELECT actor, CAST(cluster AS BIGINT) AS cluster, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS n_events FROM c GROUP BY actor, cluster""",
    "log_gaps": f"""{EV}, s AS (SELECT event_type, id, micros, micros - lag(micros) OVER (PARTITION BY event_type ORDER BY micros, id) AS gap FROM ev),
 u AS (SELECT event_type, CAST(median(gap) AS DOUBLE) AS median_gap FROM s GROUP BY event_type HAVING count(*) >= 20)
 SELECT event_type, id, micros, gap, median_gap FROM s JOIN u USING (event_type) WHERE gap > 0 AND gap > 5.0 * median_gap""",
    "rare_source": f"""{EV}, s AS (SELECT actor, src_ip, count(*) AS n, min(id) AS id, min(micros) AS micros FROM ev WHERE event_type = 'auth.login.success' GROUP BY actor, src_ip),
 -- private addresses count among an actor's logins, but aren't rare sources
 t AS (SELECT actor, CAST(sum(n) AS BIGINT) AS n_logins FROM s GROUP BY actor) SELECT actor, src_ip, id, micros, n_logins FROM s JOIN t USING (actor) WHERE n = 1 AND n_logins >= 5 AND NOT starts_with(src_ip, '10.')""",
    "start_without_create": f"{EV} SELECT id, host FROM ev a WHERE event_type = 'service.start' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'user.create' AND b.host = a.host AND abs(a.micros - b.micros) <= {HOUR})",
    "unknown_keys": f"{EV} SELECT id, k FROM ev WHERE event_type = 'auth.login.success' AND k NOT IN (SELECT k FROM ev WHERE event_type = 'user.create' AND k < 60)",
    "finding_drafts": f"""{_MATCHED}, r AS (SELECT * FROM m WHERE rule_key IN ('odd_key', 'private_source', 'new_account')),
 g AS (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY rule_key, actor ORDER BY micros, id) <= {DAY} THEN 0 ELSE 1 END AS new FROM r),
 c AS (SELECT *, sum(new) OVER (PARTITION BY rule_key, actor ORDER BY micros, id) AS cluster FROM g),
 f AS (SELECT rule_key, actor, min(micros) AS first_micros, count(*) AS n_events FROM c GROUP BY rule_key, actor, cluster)
 SELECT *, CASE rule_key WHEN 'odd_key' THEN 'medium' WHEN 'private_source' THEN 'high' ELSE 'critical' END AS severity, CASE rule_key WHEN 'odd_key' THEN 2 WHEN 'private_source' THEN 3 ELSE 4 END AS severity_rank,
 sha256(rule_key || chr(31) || actor || chr(31) || first_micros) AS fingerprint FROM f""",
    "findings_upsert": f"""{EV}, a AS (SELECT sha256(actor) AS fingerprint, count(*) AS n, CASE WHEN ends_with(actor, '1') THEN 'accepted' ELSE 'open' END AS status FROM ev WHERE event_type = 'user.create' AND id % 3 != 0 GROUP BY actor),
 b AS (SELECT sha256(actor) AS fingerprint, count(*) AS m FROM ev WHERE event_type = 'user.create' AND id % 3 = 0 GROUP BY actor)
 SELECT fingerprint, coalesce(m, n) AS n_events, coalesce(status, 'open') AS status, CASE WHEN status IS NULL THEN 'new' WHEN m IS NOT NULL THEN 'updated' ELSE 'stale' END AS change
 FROM a FULL JOIN b USING (fingerprint) WHERE NOT (status = 'open' AND m IS NULL) OR status IS NULL""",
    "attack_coverage": f"""{_MATCHED}, t AS (SELECT * FROM (VALUES ('odd_key', 'T1078'), ('private_source', 'T1190'), ('private_source', 'T1059'), ('new_account', 'T1136')) v(rule_key, technique))
 SELECT technique, count(*) AS n, count(DISTINCT actor) AS actors FROM m JOIN t USING (rule_key) GROUP BY technique""",
    "artifact_summary": f"{EV} SELECT event_type, host, count(*) AS n, min(micros) AS first_micros, max(micros) AS last_micros FROM ev GROUP BY event_type, host",
    "ioc_pages": r"""WITH h AS (SELECT page_id AS id, lower(regexp_extract(url, 'https?://([^/?#:\s]+)', 1)) AS value FROM pages)
 SELECT 'domain' AS type, value, count(DISTINCT id) AS n_rows, min(id) AS first_id, max(id) AS last_id, '' AS tags FROM h WHERE contains(value, '.') GROUP BY value""",
    "ioc_documents": r"""WITH t AS (SELECT DISTINCT doc_id AS id, 'ipv4' AS type, regexp_extract(w, '^([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:\.(?:\..*)?)?$', 1) AS value FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9.]')) AS w FROM documents)
 UNION ALL SELECT doc_id, 'md5', lower(w) FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9A-Fa-f]')) AS w FROM documents) WHERE length(w) = 32),
 n AS (SELECT *, CASE WHEN type = 'ipv4' THEN list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INTEGER)) END AS p FROM t WHERE value != ''),
 g AS (SELECT *, p[1] IN (0, 10, 127) OR p[1] >= 224 OR (p[1] = 100 AND p[2] BETWEEN 64 AND 127) OR (p[1] = 169 AND p[2] = 254) OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168)
  OR (p[1] = 192 AND p[2] = 0 AND p[3] IN (0, 2)) OR (p[1] = 198 AND p[2] IN (18, 19)) OR (p[1] = 198 AND p[2] = 51 AND p[3] = 100) OR (p[1] = 203 AND p[2] = 0 AND p[3] = 113) AS local FROM n
  WHERE type = 'md5' OR (list_max(p) <= 255 AND array_to_string(p, '.') = value AND p[1] != 127 AND value != '0.0.0.0' AND p[1] NOT BETWEEN 224 AND 239))
 SELECT type, value, count(DISTINCT id) AS n_rows, min(id) AS first_id, max(id) AS last_id, CASE WHEN bool_or(type = 'ipv4' AND local) THEN 'private' ELSE '' END AS tags FROM g GROUP BY type, value""",
    "evidence_digest": f"""{EV}, d AS (SELECT substr(sha256(CAST(id AS VARCHAR)), 1, 2) AS p, sha256(CAST(id AS VARCHAR) || chr(9) || raw) AS d FROM ev),
 s AS (SELECT p, count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(d, {at}, 12) AS HUGEINT)) AS s{at}" for at in range(1, 65, 12))} FROM d GROUP BY p)
 SELECT sha256(string_agg(concat_ws(':', p, {", ".join(f"s{at}" for at in range(1, 65, 12))}, n), ',' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM s""",
    "corr_temporal_ordered": f"""{EV.replace("WITH ev", "WITH RECURSIVE ev", 1)}, m AS (SELECT id, micros, actor, event_type = 'auth.login.failure' AS a FROM ev WHERE event_type IN ('auth.login.failure', 'auth.login.success')),
 g AS (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY actor ORDER BY micros, id) <= {DAY} THEN 0 ELSE 1 END AS new FROM m),
 c AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY micros, id) AS cluster FROM g),
 n AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY actor, cluster ORDER BY micros RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY} FOLLOWING) AS till FROM c WINDOW w AS (PARTITION BY actor, cluster ORDER BY micros, id)),
 f AS (SELECT *, min(CASE WHEN a THEN rn END) OVER w AS pa, min(CASE WHEN NOT a THEN rn END) OVER w AS pb FROM n WINDOW w AS (PARTITION BY actor, cluster ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ok AS (SELECT actor, cluster, rn, till FROM f WHERE pa < till AND pb < till AND pa < pb),
 pick AS (SELECT actor, cluster, min(rn) AS rn, min_by(till, rn) AS till FROM ok GROUP BY actor, cluster
  UNION ALL SELECT * FROM (SELECT p.actor, p.cluster, min(o.rn) AS rn, min_by(o.till, o.rn) AS till FROM pick p JOIN ok o ON o.actor = p.actor AND o.cluster = p.cluster AND o.rn >= p.till GROUP BY p.actor, p.cluster, p.rn))
 SELECT n.actor, CAST(n.cluster AS BIGINT) AS cluster, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS n_events FROM n JOIN pick p ON n.actor = p.actor AND n.cluster = p.cluster AND n.rn >= p.rn AND n.rn < p.till GROUP BY n.actor, n.cluster, p.rn""",
}
